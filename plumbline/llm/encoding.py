"""Garbled text from wrong character encodings: pair statistics, improbable runs, inverse mappings.

1. Every adjacent pair of characters that is not plain ASCII is scored by its share of the corpus's mutual information,
   p(x,y) * log(p(x,y) / (p(x) p(y))). Characters beyond the individually counted ranges stand for their block, so the table is bounded.
2. Maximum-scoring segments of improbability isolate the runs that can be garbled; notations (entities, escapes, percent signs) are read first.
3. Inside a run, inverse mappings are tested: encode as it was read, decode as it was meant, also repeatedly. A mapping counts if its
   result is well-formed and more probable than what stands there.
4. A frequent garbling is not improbable. So everything else that is not ASCII is read as single bytes too, and well-formed UTF-8 that hardly
   stands there by chance is restored whatever its frequency. Replacement characters inside words are losses that no mapping restores."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import spread

#: Characters counted one by one; all others by blocks of 256, beyond the basic plane by planes.
_SINGLE = 0x530
#: Texts whose copies hold at least this share of all rows count once, whatever the number of copies: at most 1 / HOT_SHARE hashes are collected.
HOT_SHARE = 1e-4

# Encodings that texts are wrongly read as, and those that they were in.
READ_AS = ("cp1252", "latin-1", "mac_roman", "cp437", "cp1250", "cp1251", "cp850", "koi8-r", "cp866", "cp1254", "iso8859-15", "iso8859-2", "mac_cyrillic", "cp1253", "shift_jis", "gbk", "euc_jp", "big5")
MEANT = ("utf-8", "cp1252", "cp1251", "koi8-r", "cp866", "shift_jis", "euc_jp", "gbk", "big5", "euc_kr", "mac_roman", "cp1250", "cp437", "cp850")
_WIDE = frozenset(("shift_jis", "euc_jp", "gbk", "big5", "euc_kr"))

# Signs that stand in well-formed texts of any language.
_SIGNS = frozenset("\u00a0\u202f“”‘’„‚—–…€£¥§©®™°µ«»¿¡№ºª±²³¹¼½¾×·•→←↑↓≤≥≈≠−′″")

_JOINERS = frozenset("“”‘’„‚«»‹›–—…·→←\u00a0\u00ad")

_NOTATION = re.compile(r"&(?:#\d{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z]{2,8});|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|\\[0-3][0-7]{2}|(?:%[0-9a-fA-F]{2})+|(?:=[0-9A-F]{2})+")
_ODD = re.compile(r"[^\x00-\x7f]")
_LOSS = re.compile("(?<![`\"'])�+|�+(?![`\"'])")


def _numbers() -> tuple[np.ndarray, int]:
    """The symbol of every code point, and how many there are: digits, blanks and letter cases of ASCII fold, box drawing is one, rare blocks share one."""
    o = np.arange(0x110000, dtype=np.int64)
    s = np.where(o < 0x10000, 0x10000 + (o >> 8), 0x10100 + (o >> 16))
    one = (o < _SINGLE) | (o >= 0x2000) & (o < 0x2500) | (o == 0xFFFD)
    s[one] = o[one]
    s[0x2500:0x25A0] = 0x2500
    s[ord("A") : ord("Z") + 1] += 32
    s[ord("0") : ord("9") + 1] = ord("0")
    for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f":
        s[ord(c)] = ord(" ")
    names, numbers = np.unique(s, return_inverse=True)
    return numbers.astype(np.int16), len(names)


_NUMBER, SYMBOLS = _numbers()
_LOST = int(_NUMBER[0xFFFD])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pairs(codes: np.ndarray) -> np.ndarray:
    """The number of each pair of adjacent symbols of which one at least is not ASCII."""
    odd = codes >= 128
    at = np.flatnonzero(odd[:-1] | odd[1:])
    return _NUMBER[codes[at]].astype(np.int64) * SYMBOLS + _NUMBER[codes[at + 1]]


def count_pairs(docs: DataFrame, text: str) -> DataFrame:
    """(pair, n) over all texts: numbers of adjacent symbols of which at least one is not ASCII, with partial sums in every batch; pair -1 counts all pairs.

    A text that holds a large share of the rows must not make its own garbling look normal: texts of which the copies hold HOT_SHARE of the rows count
    once. Hashes are counted for that, texts are not moved."""
    rows = docs.where(f"{text} is not null").select(text, F.xxhash64(text).alias("h"))
    least = max(2, math.ceil(HOT_SHARE * rows.count()))
    copies = {r["h"]: r["count"] for r in rows.groupBy("h").count().where(F.col("count") >= least).collect()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            counts: dict[float, list] = {}
            every, held = 0.0, []

            def flush() -> None:
                for weight in {w for w, _ in held}:
                    got = np.unique(_pairs(_codes("".join(f" {t} " for w, t in held if w == weight))), return_counts=True)
                    counts.setdefault(weight, []).append(got)
                held.clear()

            size = 0
            for t, h in pdf.itertuples(index=False, name=None):
                weight = 1.0 / copies.get(h, 1)
                every += weight * max(0, len(t) - 1)
                if not t.isascii():
                    held.append((weight, t))
                    size += len(t)
                    if size > 2_000_000:
                        flush()
                        size = 0
            flush()
            parts = [(k, n * w) for w, found in counts.items() for k, n in found]
            pair = np.concatenate([np.array([-1], np.int64), *(k for k, _ in parts)])
            n = np.concatenate([np.array([every]), *(n for _, n in parts)])
            yield pd.DataFrame({"pair": pair, "n": n}).groupby("pair", as_index=False).sum()

    part = spread(rows).mapInPandas(run, "pair bigint, n double")
    return part.groupBy("pair").agg(F.sum("n").alias("n"))


@dataclass
class PairTable:
    """Log shares of mutual information of all pairs of symbols, of a size that no corpus changes; ``floor`` for unseen pairs, ``cut`` below which a pair is improbable."""

    score: np.ndarray
    floor: float
    cut: float
    memo: dict = field(default_factory=dict)

    def of(self, text: str) -> np.ndarray:
        """The scores of the pairs of which one character at least is not ASCII."""
        return self.score[_pairs(_codes(text))]

    def unseen(self, text: str) -> float:
        """The share of scored pairs that the corpus does not have."""
        got = self.of(text)
        return float((got <= self.floor).mean()) if len(got) else 0.0

    def mean(self, text: str) -> float:
        """Mean score of the scored pairs; 0 for plain ASCII."""
        got = self.of(text)
        return float(got.sum()) / len(got) if len(got) else 0.0


def pair_table(pair: np.ndarray, n: np.ndarray, rare: float = 0.15) -> PairTable:
    """The table of count_pairs's rows. Improbable are the rarest pairs that together hold the share ``rare`` of all scored pairs, and those with a replacement character."""
    floor = np.float32(math.log(1e-10))
    score = np.full(SYMBOLS * SYMBOLS, floor, np.float32)
    every = max(1.0, float(n[pair < 0].sum()))
    n, pair = n[pair >= 0], pair[pair >= 0]
    x, y = pair // SYMBOLS, pair % SYMBOLS
    # Marginals of ASCII characters are known only next to others; their share there is what a pair is held against.
    p = n / every
    px, py = np.bincount(x, p, SYMBOLS)[x], np.bincount(y, p, SYMBOLS)[y]
    got = np.maximum(floor, np.log(p * np.log(np.maximum(p / (px * py), 1.01)))).astype(np.float32)
    score[pair] = got
    order = np.lexsort((pair, got))
    held = np.searchsorted(np.cumsum(n[order]), rare * n.sum(), "right")
    cut = float(got[order[held - 1]]) if held else float(floor)
    square = score.reshape(SYMBOLS, SYMBOLS)
    square[_LOST, :] = square[:, _LOST] = floor
    return PairTable(score, float(floor), cut)


def improbable_runs(text: str, table: PairTable, ascii_cost: float = 0.35) -> list[tuple[int, int]]:
    """Maximum-scoring segments of improbability as (start, end), in order: every pair below the cut counts for its segment, every other one against it."""
    if text.isascii():
        return []
    codes = _codes(f" {text} ")
    odd = codes >= 128
    scored = odd[:-1] | odd[1:]
    value = np.full(len(codes) - 1, -ascii_cost)
    s = table.score[_pairs(codes)].astype(np.float64)
    value[scored] = np.where(s <= table.cut, 1.0 + np.minimum(3.0, table.cut - s), -np.minimum(4.0, s - table.cut))
    total = np.concatenate([[0.0], np.cumsum(value)])
    # Ruzzo and Tompa's linear-time search for all maximal segments: start, end, cumulative before and after, and the last one with less before it.
    stack: list[tuple[int, int, float, float, int]] = []
    for i in np.flatnonzero(value > 0).tolist():
        begin, low, high = i, float(total[i]), float(total[i + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= high:
                stack.append((begin, i + 1, low, high, j))
                break
            begin, low = stack[j][0], stack[j][2]
            del stack[j:]
    # Pair i joins padded[i] and padded[i + 1], which is text[i - 1] and text[i].
    out: list[tuple[int, int]] = []
    for a, b, *_ in stack:
        start, end = max(0, a - 1), min(len(text), b)
        while start < end and text[start] < "\x80" and (text[start].isspace() or not _near(text, start)):
            start += 1
        if start < end:
            out.append((start, end))
    return out


def _near(text: str, i: int) -> bool:
    return i + 1 < len(text) and text[i + 1] >= "\x80"


def _sloppy(text: str, encoding: str) -> bytes | None:
    """Bytes of ``text`` in a single-byte or wide encoding; positions that cp125x leaves undefined stand for themselves."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if not encoding.startswith("cp125"):
            return None
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) < 0xA0:
                return None
            out.append(ord(c))
    return bytes(out)


def _tidy(text: str) -> bool:
    """Whether a decoded text has assigned characters only and no controls beside line ends and tabs."""
    return text.isprintable() or all(c.isprintable() or c in "\n\r\t" or unicodedata.category(c) not in ("Cc", "Cn", "Co", "Cs") for c in set(text))


def _plausible(got: str, wide: bool) -> bool:
    """Whether a remapped run reads as text: letters and common signs only, and letters of another script only several in a row; from a double-byte encoding also box drawing alone."""
    if wide and all("\u2500" <= c < "\u25a0" for c in set(got) if c >= "\x80"):
        return len(_ODD.findall(got)) >= 2
    for c in set(got):
        if c >= "\x80" and not (c in _SIGNS or c.isalpha() or 0x3000 <= ord(c) < 0x3040 or 0xFF00 <= ord(c) < 0xFFF0):
            return False
    odd = _ODD.findall(got)
    foreign = sum(c >= "\u0370" and c.isalpha() for c in odd)
    return not foreign or foreign >= 3 and foreign >= 0.6 * len(odd)


def _misplaced(text: str) -> bool:
    """Whether a sign stands between two letters, or a Greek letter, box or operator beside a Latin one, as no well-formed text has it."""
    for a, c, b in zip(text, text[1:], text[2:]):
        if c >= "\x80" and c not in _JOINERS:
            if a.isalpha() and b.isalpha() and not c.isalpha() and not unicodedata.combining(c):
                return True
            if (0x370 <= ord(c) < 0x400 or 0x2200 <= ord(c) < 0x2600) and (a < "\x80" and a.isalnum() or b < "\x80" and b.isalnum()):
                return True
    return False


def _margin(read: str, meant: str, run: str, misplaced: bool) -> float:
    """How much more probable the result must be. Well-formed UTF-8 hardly arises by chance, a remapped single byte easily."""
    if meant == "utf-8":
        return -1.5 if read not in _WIDE else 0.5
    if misplaced:
        return 0.0
    n = sum(c >= "\x80" for c in run)
    return 1.0 if n >= 4 else 2.0


def _readings(run: str, across: bool) -> list[tuple[str, str, str]]:
    """(read as, meant, text) of every inverse mapping of ``run`` whose result can be text, whatever stands around; mappings that agree once. ``across``: only from
    double-byte encodings, whose trail bytes stand among ASCII."""
    out: list[tuple[str, str, str]] = []
    signs_only = all(c in _SIGNS for c in set(run) if c >= "\x80")
    raws: set[tuple[bytes, bool]] = set()  # encodings differ in few characters, so most readings are the same
    tried: set[tuple[str, bool]] = set()
    for read in READ_AS:
        wide = read in _WIDE
        if across and wide:
            continue
        raw = _sloppy(run, read)
        if raw is None or raw.isascii() or (raw, wide) in raws:
            continue
        raws.add((raw, wide))
        for meant in MEANT:
            if meant == read or meant != "utf-8" and (wide or signs_only) or across and meant not in _WIDE:
                continue
            try:
                got = raw.decode(meant)
            except UnicodeDecodeError:
                continue
            if got == run or meant == "utf-8" and len(got) == len(raw):
                continue
            if meant != "utf-8":
                key = got, meant in _WIDE
                if key in tried:
                    continue
                tried.add(key)
                if not _tidy(got) or not _plausible(got, meant in _WIDE):
                    continue
            out.append((read, meant, got))
    return out


def invert(run: str, table: PairTable, before: str = " ", after: str = " ", across: bool = False) -> str | None:
    """The most probable well-formed reading of a garbled run, or None if no inverse mapping improves it. Repeated garbling is undone to its end: every reading as
    UTF-8 is shorter than what it is read from."""
    key = run, before, after, across
    known = table.memo.get(key, run)
    if known is run:
        known = _invert(run, table, before, after, across)
        if len(table.memo) < 400_000:  # runs repeat; the memo only saves time
            table.memo[key] = known
    return known


def _invert(run: str, table: PairTable, before: str, after: str, across: bool) -> str | None:
    readings = table.memo.get((run, across))
    if readings is None:
        readings = _readings(run, across)
        if len(table.memo) < 400_000:
            table.memo[run, across] = readings
    if not readings:
        return None
    best: tuple[float, str] | None = None
    now, misplaced = table.mean(before + run + after), _misplaced(before + run + after)
    for read, meant, got in readings:
        if meant == "utf-8":
            if not _tidy(got):
                got = invert(got, table, before, after)
                if got is None:
                    continue
            elif _ODD.search(got):
                got = invert(got, table, before, after) or got
        scores = table.of(before + got + after)
        mean = float(scores.sum()) / len(scores) if len(scores) else 0.0
        gain = mean - now - _margin(read, meant, run, misplaced)
        if gain <= 0:
            continue
        if meant != "utf-8" and (scores <= table.floor).sum() > 0.25 * len(scores) and (meant not in _WIDE or len(_IDEOGRAPH.findall(got)) < 4):
            continue
        gain += 2 if meant == "utf-8" else 0
        if best is None or gain > best[0]:
            best = (gain, got)
    return best[1] if best else None


_IDEOGRAPH = re.compile("[\u3040-\u9fff]")
_PIECE = re.compile(r"[^\x00-\x7f]+")


def _mends(text: str, table: PairTable, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, replacement) for every garbled stretch: whole runs first, else the words and the pieces of them that invert on their own."""
    tried, mended = (0, 0), False  # the last stretch of a line that was tried whole
    for start, end in runs:
        if mended and tried[0] <= start and end <= tried[1]:
            continue
        got = invert(text[start:end], table, text[max(0, start - 1) : start] or " ", text[end : end + 1] or " ")
        if got is not None:
            yield start, end, got
            continue
        # Wide encodings have trail bytes among ASCII: try the stretch of the line, up to characters that no single byte stands for.
        known = tried[0] <= start and end <= tried[1]
        a, b = tried if known else (start, end)
        while a > 0 and text[a - 1] < "\u2e80" and text[a - 1] not in "\n`":
            a -= 1
        while b < len(text) and text[b] < "\u2e80" and text[b] not in "\n`":
            b += 1
        if not known:
            tried, mended = (a, b), False
            got = invert(text[a:b], table, across=True) if len(_ODD.findall(text, a, b)) >= 4 else None
            mended = got is not None
            if got is not None:
                yield a, b, got
                continue
        for m in _PIECE.finditer(text, start, end):
            a, b = m.span()
            got = invert(m[0], table, text[max(0, a - 1) : a] or " ", text[b : b + 1] or " ")
            while got is None and a < b and (text[a] in _JOINERS or text[b - 1] in _JOINERS):  # quotes and fixed blanks around may be as they were meant
                a, b = a + (text[a] in _JOINERS), b - (text[b - 1] in _JOINERS)
                got = invert(text[a:b], table, text[max(0, a - 1) : a] or " ", text[b : b + 1] or " ") if a < b else None
            if got is not None:
                yield a, b, got


_SEQUENCE = "[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
_UTF8 = re.compile(f"(?:{_SEQUENCE})+")
_ONE = re.compile(_SEQUENCE)


class _Bytes(dict):
    """The byte of each character in a single-byte encoding as a character, for str.translate; NUL for characters that it has not."""

    def __init__(self, encoding: str) -> None:
        super().__init__()
        self.encoding = encoding

    def __missing__(self, o: int) -> str:
        raw = _sloppy(chr(o), self.encoding)
        got = self[o] = chr(raw[0]) if raw and len(raw) == 1 else "\0"
        return got


_AS_BYTES = {e: _Bytes(e) for e in READ_AS if e not in _WIDE}


def _common(c: str) -> bool:
    """Whether ``c`` is a sign or a letter of a living script, as restored texts have; phonetic letters and rare scripts arise by chance."""
    o = ord(c)
    return c in _SIGNS or o >= 0x1F000 or 0x2190 <= o < 0x2800 or 0x3000 <= o < 0x3040 or 0xFF00 <= o < 0xFFF0 or c.isalpha() and (o < 0x180 or 0x370 <= o < 0x530 or 0x5D0 <= o < 0x700 or 0x900 <= o < 0xE80 or 0x1E00 <= o < 0x2000 or 0x3040 <= o < 0xD7B0)


def _utf8_in(piece: str, table: PairTable) -> list[tuple[str, list[tuple[int, int, str]], list[str]]]:
    """(encoding, mends, sequences) of every single-byte reading by which all of a piece but signs around is well-formed UTF-8, also repeatedly."""
    got = table.memo.get(piece)
    if got is not None:
        return got
    got = []
    # A word of a script of its own, cased as words are, is one.
    word = all(ord(c) >= 0x370 and c.isalpha() for c in piece) and (piece.islower() or piece.istitle() or piece.isupper())
    for encoding, as_bytes in () if word else _AS_BYTES.items():
        raw = piece.translate(as_bytes)
        spans = [m.span() for m in _UTF8.finditer(raw)]
        if not spans or any(c not in _SIGNS for c in _UTF8.sub("", raw) and [c for i, c in enumerate(piece) if not any(a <= i < b for a, b in spans)]):
            continue
        mends, sequences = [], []
        for a, b in spans:
            now = raw[a:b].encode("latin-1").decode("utf-8")
            while _UTF8.fullmatch(again := now.translate(as_bytes)):
                now = again.encode("latin-1").decode("utf-8")
            mends.append((a, b, now))
            sequences += [piece[a + m.start() : a + m.end()] for m in _ONE.finditer(raw[a:b])]
        if all(_common(c) for *_, now in mends for c in now):
            got.append((encoding, mends, sequences))
    if len(table.memo) < 200_000:
        table.memo[piece] = got
    return got


def _well_formed(text: str, table: PairTable, done: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of stretches outside ``done`` that are UTF-8 read as single bytes, judged by their form and not by their frequency.

    Counted for a reading: two-byte sequences as one, longer ones and those with a sign between letters as enough; the former need two kinds and three
    sequences in the text, or a result of frequent pairs. Box drawing alone says nothing."""
    by: dict[str, list[tuple[int, int, str, bool]]] = {}
    weight: Counter = Counter()
    kinds: dict[str, set[str]] = {}
    at = 0
    for m in _PIECE.finditer(text):
        a, b = m.span()
        while at < len(done) and done[at][1] <= a:
            at += 1
        if b - a < 2 or at < len(done) and done[at][0] < b:
            continue
        around = text[max(0, a - 1) : a], text[b : b + 1]
        for encoding, mends, sequences in _utf8_in(m[0], table):
            drawn = all(0x2500 <= ord(c) < 0x25A0 for c in "".join(sequences))
            cased = not all(ord(c) >= 0x370 and c.isalpha() for c in m[0])
            if not drawn:
                weight[encoding] += len(sequences)
                kinds.setdefault(encoding, set()).update(sequences)
            sure = cased and not drawn and (max(map(len, sequences)) > 2 or _misplaced(around[0] + m[0] + around[1]))
            if not sure and not drawn:
                restored = m[0]
                for x, y, now in reversed(mends):
                    restored = restored[:x] + now + restored[y:]
                whole = (around[0] or " ") + restored + (around[1] or " ")
                sure = not restored.isascii() and table.unseen(whole) == 0 and table.mean(whole) >= table.cut
            by.setdefault(encoding, []).extend((a + x, a + y, now, sure) for x, y, now in mends)
    out: dict[tuple[int, int], str] = {}
    for encoding in sorted(by, key=lambda e: -weight[e]):
        enough = weight[encoding] >= 3 and len(kinds[encoding]) >= 2
        for x, y, now, sure in by[encoding]:
            if (enough or sure) and not any(x < d and c < y for c, d in out):
                out[x, y] = now
    return [(x, y, now) for (x, y), now in sorted(out.items())]


def _expand(text: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """Text with notations of non-ASCII characters read, and their places: (start, end) there and in ``text``."""
    if not ("&" in text or "\\" in text or "%" in text or "=" in text):
        return text, []
    out, places, at, size = [], [], 0, 0
    for m in _NOTATION.finditer(text):
        raw = m[0]
        if raw[0] == "&":
            got = html.unescape(raw)
        elif raw[0] == "\\":
            got = chr(int(raw[2:], 16)) if raw[1] in "ux" else chr(int(raw[1:], 8))
        else:
            try:
                got = bytes(int(x, 16) for x in re.findall("[0-9A-Fa-f]{2}", raw)).decode("utf-8")
            except UnicodeDecodeError:
                continue
        if got == raw or got.isascii():
            continue
        out.append(text[at : m.start()])
        size += m.start() - at
        out.append(got)
        places.append((size, size + len(got), m.start(), m.end()))
        size += len(got)
        at = m.end()
    if not places:
        return text, []
    return "".join([*out, text[at:]]), places


def _back(i: int, places: list[tuple[int, int, int, int]], end: bool) -> int:
    """Position in the original text of position ``i`` in the expanded one."""
    shift = 0
    for a, b, c, d in places:
        if i < a or i == a and end:
            break
        if i < b or i == b and end:
            return d if end else c
        shift = d - b
    return i + shift


def examine(text: str | None, table: PairTable) -> tuple[list[tuple[int, int]], str | None]:
    """Garbled stretches of ``text`` as (start, end), and the text with them restored; None where some cannot be. ([], text) if nothing is garbled."""
    if not text:
        return [], text
    whole, places = _expand(text)
    if whole.isascii():
        return [], text
    found, parts, at = [], [], 0
    mends: list[tuple[int, int, str]] = []
    runs = improbable_runs(whole, table)
    for a, b, got in _mends(whole, table, runs):
        if not mends or a >= mends[-1][1]:  # else in a stretch that is mended already
            mends.append((a, b, got))
    mends = sorted([*mends, *_well_formed(whole, table, [(a, b) for a, b, _ in mends])])
    for a, b, got in mends:
        s, e = _back(a, places, False), _back(b, places, True)
        if s < at:  # in a stretch that is mended already
            continue
        found.append((s, e))
        parts += [text[at:s], got]
        at = e
    # A replacement character makes its pairs improbable: every one is in a run.
    lost = [(_back(m.start(), places, False), _back(m.end(), places, True)) for a, b in runs for m in _LOSS.finditer(whole, max(0, a - 1), min(len(whole), b + 1)) if a < m.end() and m.start() < b] if "�" in whole else []
    fixed = "".join([*parts, text[at:]])
    return sorted([*found, *lost]), None if lost or "�" in fixed else fixed


def find_garbled(docs: DataFrame, key: str = "doc_id", text: str = "text", rare: float = 0.15) -> DataFrame:
    """(key, stretches, restored) for every text with at least one stretch garbled by a wrong decoding; restored is null where characters are lost.

    Two passes: pair counts of all texts (partial sums per batch; at most SYMBOLS squared pairs, some 100 MB, are ever collected, and 32 MB sent to the executors), then a
    narrow pass that examines every text whole. Texts of plain ASCII without notations do not reach Python. Null and empty texts are never garbled; equal texts give
    equal results; other columns are ignored."""
    spark = docs.sparkSession
    counts = count_pairs(docs, text).toPandas()
    sent = spark.sparkContext.broadcast(pair_table(counts["pair"].to_numpy(np.int64), counts["n"].to_numpy(float), rare))
    schema = docs.select(key).schema.simpleString()[len("struct<") : -1] + ",stretches:int,restored:string"
    odd = F.col(text).rlike(r"[^\x00-\x7f]|&(?:#|[A-Za-z]{2,8};)|\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[0-3][0-7]{2})|%[0-9a-fA-F]{2}|=[0-9A-F]{2}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, body in pdf.itertuples(index=False, name=None):
                found, fixed = examine(body, sent.value)
                if found:
                    rows.append((k, len(found), fixed))
            yield pd.DataFrame(rows, columns=[key, "stretches", "restored"])

    return spread(docs.select(key, text).where(odd)).mapInPandas(run, schema)

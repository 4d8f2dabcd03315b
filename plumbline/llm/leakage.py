"""Evaluation passages that leak into a corpus: pigeonhole edit matching with bit-parallel verification.

Every test item is cut into windows of WINDOW tokens that start at multiples of the piece length, each of BUDGET + 1 pieces. A window that
occurs with at most BUDGET token edits leaves one piece intact, so exact piece hits find every candidate; each is verified by Myers'
bit-parallel edit distance over tokens. Any passage of 25 words holds a whole window. A verified window is then extended to the
passage's ends, which must span the required number of the item's words."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage, spread

BUDGET = 3
PIECE = 5
WINDOW = PIECE * (BUDGET + 1)
#: Equal tokens that a differing one costs at a passage's ends.
MATCHES = 4
#: The largest share of differing tokens of a whole passage: texts made from the same phrases differ in more.
MOST_DIFFERENT = 0.16
#: Items of one broadcast block, by characters of text; larger test sets are matched in several passes, a block each.
BLOCK_CHARS = 16_000_000

_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8});")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|[nrt]|(.))", re.S)
_TAG = re.compile(r"(?i)</?(?:a|abbr|b|blockquote|br|code|dd|del|div|dl|dt|em|h[1-6]|hr|html|body|head|i|img|ins|li|mark|ol|p|pre|s|small|span|strong|sub|sup|table|tbody|td|th|thead|title|tr|tt|u|ul)(?:\s[^<>]{0,200})?/?>")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
#: Scripts written without blanks: each character is a token, and PER_WORD of them in a row count as a word.
_BARE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
PER_WORD = 2
_TOKEN = re.compile(rf"[{_BARE}]|[^\W{_BARE}]+")
_ASCII_TOKEN = re.compile(r"\w+", re.A)
_IS_BARE = re.compile(f"[{_BARE}]")


def _unescape(m: re.Match) -> str:
    return chr(int(m[1], 16)) if m[1] else m[2] if m[2] else " "


def plain(text: str) -> str:
    """Text without escapes, entities, tags and invisible signs, in one case; what is left differs in punctuation and layout only."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
        if "&" in text:
            text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return text.lower()


def tokens(text: str) -> list[str]:
    """Runs of letters, digits and inner underscores; of scripts without blanks, single characters."""
    if not text:
        return []
    text = plain(text)
    found = (_ASCII_TOKEN if text.isascii() else _TOKEN).findall(text)
    return [t for t in (w.strip("_") for w in found) if t] if "_" in text else found


def tokens_and_words(text: str) -> tuple[list[str], list[int]]:
    """Tokens, and for each the ordinal of the word that it is from: white-space separated, in scripts without blanks PER_WORD characters."""
    out, at, ordinal = [], [], -1
    for word in plain(text).split():
        run, before = 0, None
        for t in _TOKEN.findall(word):
            if t := t.strip("_"):
                bare = _IS_BARE.match(t) is not None
                if bare is not before:
                    ordinal, run = ordinal + 1, 0
                elif bare and run % PER_WORD == 0:
                    ordinal += 1
                run, before = run + 1, bare
                out.append(t)
                at.append(ordinal)
    return out, at


def edit_distance_within(pattern: list[int], text: list[int], budget: int) -> tuple[int, int] | None:
    """Myers' bit-parallel search: the least edit distance of ``pattern`` to any stretch of ``text`` and the stretch's end, if within ``budget``."""
    m = len(pattern)
    if m == 0:
        return (0, 0)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        if c >= 0:
            peq[c] |= 1 << i
    pv, mv, score, best = mask, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & mask  # the pattern may begin anywhere
        mh = (mh << 1) & mask
        pv = mh | ~(xv | ph) & mask
        mv = ph & xv
        if score <= budget and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


@dataclass
class Index:
    """Pieces of a block of items; sent to the executors, its size is bounded by BLOCK_CHARS."""

    vocabulary: dict[str, int] = field(default_factory=dict)
    items: list[np.ndarray] = field(default_factory=list)
    lists: list[list[int]] = field(default_factory=list)
    words: list[np.ndarray] = field(default_factory=list)
    ids: list[int] = field(default_factory=list)
    hashes: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    places: np.ndarray = field(default_factory=lambda: np.empty((0, 2), np.int64))
    #: All items behind each other, apart by more than a window, and where each begins.
    flat: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    starts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    #: Pieces of items that are shorter than a window, by length: hashes, and places (item, first token).
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _grams(ids: np.ndarray, n: int = PIECE) -> np.ndarray:
    """64-bit mixes of every n tokens in a row; candidates are verified, so a collision costs time only."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    x, size = ids.astype(np.uint64), len(ids) - n + 1
    h = np.zeros(size, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h ^ (h >> np.uint64(31))) * _MIX[i % 5] + x[i : i + size] * _MIX[(i + 2) % 5]
    return h


def _sorted(hashes: list, places: list) -> tuple[np.ndarray, np.ndarray]:
    h = np.array(hashes, np.uint64)
    order = np.argsort(h, kind="stable")
    return h[order], np.array(places, np.int64).reshape(-1, 2)[order]


def build_index(items: list[tuple[int, str]]) -> Index:
    """Index of (item_id, text). Items with fewer tokens than a window are matched whole, with an edit per PIECE + 1 tokens: they are cut into one piece more
    than that."""
    ix, hashes, places = Index(), [], []
    short: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
    flat, starts, size = [np.full(WINDOW, -2, np.int32)], [], WINDOW
    for item_id, text in items:
        toks, word = tokens_and_words(text or "")
        if not toks:
            continue
        ids = np.array([ix.vocabulary.setdefault(t, len(ix.vocabulary)) for t in toks], np.int32)
        n = len(ix.items)
        ix.items.append(ids)
        ix.lists.append(ids.tolist())
        ix.words.append(np.array(word, np.int32))
        ix.ids.append(item_id)
        starts.append(size)
        flat += [ids, np.full(WINDOW, -2, np.int32)]
        size += len(ids) + WINDOW
        if len(ids) < WINDOW:
            pieces = len(ids) // (PIECE + 1) + 1
            length = len(ids) // pieces
            g = _grams(ids, length)
            for q in range(0, pieces * length, length):
                short[length][0].append(g[q])
                short[length][1].append((n, q))
            continue
        g = _grams(ids)
        for q in [*range(0, len(g), PIECE), len(g) - 1]:
            hashes.append(g[q])
            places.append((n, q))
    ix.flat, ix.starts = np.concatenate(flat), np.array(starts, np.int64)
    ix.hashes, ix.places = _sorted(hashes, places)
    ix.short = {length: _sorted(*x) for length, x in short.items()}
    return ix


def _extend(doc: list[int], item: list[int], p: int, q: int, step: int) -> tuple[int, int]:
    """Tokens by which a match at doc[p], item[q] goes on in direction ``step``, and how many of them differ. Each differing token must be
    outweighed by MATCHES equal ones; the best-scoring end counts."""
    n = score = best = kept = missed = miss = 0
    left = min(len(doc) - p, len(item) - q) if step > 0 else min(p, q) + 1
    while n < left and score > best - 3 * MATCHES:
        n += 1
        if doc[p] == item[q]:
            score += 1
            if score >= best:
                best, kept, missed = score, n, miss
        else:
            score -= MATCHES
            miss += 1
        p += step
        q += step
    return kept, missed


def match(ids: np.ndarray, ix: Index, min_words: int = 25, slack: int = 3) -> list[tuple[int, int, int, int]]:
    """Leaked items of one document, given as vocabulary ids (-1: not in any item): (item_id, words, edits, first token)."""
    found: dict[int, tuple[int, int, int, int]] = {}
    for length, (hashes, places) in ix.short.items():
        for p, at in _hits(ids, hashes, length):
            for x, (n, q) in zip(p, places[at]):
                if n in found:
                    continue
                item, budget = ix.items[n], len(ix.items[n]) // (PIECE + 1)
                a = max(0, x - q - budget)
                if hit := edit_distance_within(item.tolist(), ids[a : x - q + len(item) + budget].tolist(), budget):
                    found[n] = (ix.ids[n], int(ix.words[n][-1]) + 1, hit[0], int(max(0, a + hit[1] - len(item))))
    if len(ids) >= WINDOW - BUDGET and len(ix.hashes):
        _match_windows(ids, ix, found, min_words, slack)
    return list(found.values())


def _hits(ids: np.ndarray, hashes: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the document, places in the index) of equal pieces, in parts of bounded size for documents of any length."""
    g = _grams(ids, length)
    if not len(g):
        return
    left = np.searchsorted(hashes, g, "left")
    count = np.searchsorted(hashes, g, "right") - left
    count[ids[: len(g)] < 0] = 0
    at = np.flatnonzero(count)
    ends = np.cumsum(count[at])
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 8192, "right")))
        part, r = at[lo:hi], count[at[lo:hi]]
        yield np.repeat(part, r), np.repeat(left[part], r) + np.arange(r.sum()) - np.repeat(np.cumsum(r) - r, r)
        lo = hi


_OFF = np.arange(PIECE - WINDOW, WINDOW)


def _match_windows(ids: np.ndarray, ix: Index, found: dict, min_words: int, slack: int) -> None:
    reach = WINDOW + BUDGET
    doc = np.concatenate([np.full(reach, -3, np.int32), ids, np.full(reach, -3, np.int32)])
    whole: list[int] | None = None
    taken: dict[int, list[tuple[int, int, int]]] = {}  # passages that count: first and last token, and their distance to the item's
    for p, at in _hits(ids, ix.hashes, PIECE):
        places = ix.places[at]
        # A window within the budget matches on diagonals at most BUDGET away from its piece's: a necessary condition, cheap to test.
        it = ix.flat[(ix.starts[places[:, 0]] + places[:, 1])[:, None] + _OFF]
        same = np.zeros(it.shape, bool)
        base = p[:, None] + (_OFF + reach)
        for shift in range(-BUDGET, BUDGET + 1):
            same |= doc[base + shift] == it
        near = np.flatnonzero(same.sum(1) >= WINDOW - BUDGET)
        if not len(near):
            continue
        run = np.concatenate([np.zeros((len(near), 1), np.int32), np.cumsum(same[near], 1, dtype=np.int32)], 1)
        near = near[(run[:, WINDOW:] - run[:, :-WINDOW] >= WINDOW - BUDGET).any(1)]
        whole = ids.tolist() if whole is None else whole
        for row in near:
            n, p0, q0 = int(places[row, 0]), int(p[row]), int(places[row, 1])
            if any(a <= p0 < b and abs(p0 - q0 - d) <= BUDGET for a, b, d in taken.get(n, ())):
                continue
            if got := _verify(whole, ix, n, p0, q0, found, min_words, slack):
                taken.setdefault(n, []).append((*got, p0 - q0))


def _verify(ids: list[int], ix: Index, n: int, p: int, q: int, found: dict, min_words: int, slack: int) -> tuple[int, int] | None:
    """The passage (first token and the one behind its last) around a window that holds the piece at ids[p] and the item's q, if it counts."""
    item, word = ix.lists[n], ix.words[n]
    for start in range(max(0, q - (WINDOW - PIECE)), min(q, len(item) - WINDOW) + 1):
        a = max(0, p - (q - start) - BUDGET)
        hit = edit_distance_within(item[start : start + WINDOW], ids[a : p - (q - start) + WINDOW + BUDGET], BUDGET)
        if hit is None:
            continue
        end = a + hit[1]  # just behind the window in the document
        back, ahead = (0, 0), _extend(ids, item, end, start + WINDOW, 1)
        for shift in range(-hit[0], hit[0] + 1):  # where the window begins, as tokens may have come in or gone missing within it
            if end - WINDOW + shift > 0:
                back = max(back, _extend(ids, item, end - WINDOW + shift - 1, start - 1, -1), key=lambda x: x[0])
        first, last = start - back[0], start + WINDOW + ahead[0] - 1
        edits, span = hit[0] + back[1] + ahead[1], last - first + 1
        words = int(word[last] - word[first]) + 1
        need = min(min_words - slack, int(word[-1]) + 1)
        if words >= need and edits <= max(1, MOST_DIFFERENT * span):
            begin = max(0, end - WINDOW - back[0])
            if n not in found or words > found[n][1]:
                found[n] = (ix.ids[n], words, edits, begin)
            return begin, end + ahead[0]
    return None


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", min_words: int = 25) -> DataFrame:
    """(key, item_id, words, edits, first_token) for every document that holds at least ``min_words`` words in a row of an item, or the whole item, apart
    from case, punctuation, markup, escapes, layout and up to BUDGET replaced, missing or added tokens per WINDOW.

    The corpus is read once per block of items and never shuffled; only the items travel, in blocks of about BLOCK_CHARS characters, of which the driver holds
    one at a time: usual test sets are one block. Null and empty texts match nothing. Equal documents each give their rows; a repeated item id with several
    texts gives a row per matching text."""
    spark = docs.sparkSession
    slim = items.select(F.col(item_key).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    blocks = 1 + int((slim.agg(F.sum(F.length("t"))).first()[0] or 0) // BLOCK_CHARS)
    schema = docs.select(key).schema.simpleString()[len("struct<") : -1] + ",item_id:bigint,words:int,edits:int,first_token:bigint"
    source = spread(docs.select(key, text).where(f"{text} is not null"))
    out = None
    for block in range(blocks):
        rows = slim if blocks == 1 else slim.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast(build_index([(r[0], r[1]) for r in rows.collect()]))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ix = sent.value
            get = ix.vocabulary.get
            for pdf in batches:
                rows = []
                for k, body in pdf.itertuples(index=False, name=None):
                    ids = np.array([get(t, -1) for t in tokens(body)], np.int32)
                    rows += [(k, *m) for m in match(ids, ix, min_words)]
                yield pd.DataFrame(rows, columns=[key, "item_id", "words", "edits", "first_token"])

        part = source.mapInPandas(run, schema)
        if blocks > 1:  # written before the next block is read, so that one index is held at a time
            part = cut_lineage(part)
            sent.unpersist()
        out = part if out is None else out.unionByName(part)
    return out

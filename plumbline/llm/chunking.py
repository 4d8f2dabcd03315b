"""Splitting oversized texts: content-defined chunks whose cuts snap to natural boundaries.

A rolling hash over the last WINDOW characters marks landmarks; they depend on nearby text only, so an edit moves the cuts next to it
and leaves the others. Each cut is the first landmark of its piece's allowed range, snapped to the nearest natural boundary."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 48
_BASE = np.uint64(0x9E3779B97F4A7C15)

# Natural boundaries, the strongest first: before a paragraph or top-level definition, a line, after a sentence, a word.
_BOUNDARIES = (
    re.compile(r"(?<=\n)(?:[ \t]*\r?\n)+(?=\S)"),
    re.compile(r"\n(?=[^\s}\])])"),
    re.compile(r"\n"),
    re.compile(r"[.!?;][\"')\]]*[ \t]+|[。！？；]|[,}]"),
    re.compile(r"[ \t]+"),
)


def landmarks(text: str, spacing: int) -> np.ndarray:
    """Positions after which a rolling hash of WINDOW characters falls into one of ``spacing`` classes; ascending."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(x) < WINDOW:
        return np.empty(0, np.int64)
    n = len(x) - WINDOW + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            h = h * _BASE + x[i : i + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.flatnonzero(h % np.uint64(spacing) == 0) + WINDOW


def _snap(text: str, mark: int, low: int, high: int, reach: int) -> int:
    """The nearest boundary to ``mark`` within [low, high], of the strongest kind that has one within ``reach``; else the mark itself."""
    a, b = max(low, mark - reach), min(high, mark + reach)
    for kind in _BOUNDARIES:
        ends = [m.end() for m in kind.finditer(text, max(0, a - 2), min(len(text), b + 2)) if a <= m.end() <= b]
        if ends:
            return min(ends, key=lambda p: (abs(p - mark), p))
    return mark


def _whole(text: str, cut: int, low: int) -> int:
    """Step back from a cut inside CRLF or before a combining mark."""
    while low < cut < len(text) and (text[cut - 1] == "\r" and text[cut] == "\n" or 0x300 <= ord(text[cut]) < 0x370 or text[cut] in "\u200d\ufe0f"):
        cut -= 1
    return cut


def cut_points(text: str, limit: int = 8000, overlap: int = 200, minimum: int | None = None) -> list[int]:
    """Ascending cuts from 0 to len(text): piece i is text[max(0, cut[i] - overlap) : cut[i + 1]] and at most ``limit`` long."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half of the limit")
    most = limit - overlap
    least = max(1, minimum if minimum is not None else most // 4)
    n = len(text)
    if n <= limit:
        return [0, n]
    marks = landmarks(text, max(1, (most - least) // 3))
    cuts = [0]
    while n - cuts[-1] > (limit if len(cuts) == 1 else most):
        at = cuts[-1]
        low, high = at + least, at + most
        i = int(np.searchsorted(marks, low))
        mark = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        cut = _snap(text, mark, low, high, (most - least) // 4)
        cuts.append(max(_whole(text, cut, low), at + 1))
    return [*cuts, n]


def split_oversized(df: DataFrame, key: list[str], content: str, limit: int = 8000, overlap: int = 200) -> DataFrame:
    """Pieces of every text longer than ``limit`` code points: the ``key`` columns, piece (from 1), pieces, start, length, text.

    Each piece has at most ``limit`` characters, together they cover the text, and each begins ``overlap`` characters before the previous one ends.
    The length filter runs before Python; texts up to the limit, null and empty ones give no rows. Repeated rows give repeated pieces; other columns
    are ignored. Narrow: no shuffle."""
    schema = df.select(*key).schema.simpleString()[len("struct<") : -1] + ",piece:int,pieces:int,start:bigint,length:int,text:string"
    columns = [*key, "piece", "pieces", "start", "length", "text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for *k, text in pdf.itertuples(index=False, name=None):
                cuts = cut_points(text, limit, overlap)
                rows = []
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    a = max(0, a - overlap) if i else 0
                    rows.append((*k, i + 1, len(cuts) - 1, a, b - a, text[a:b]))
                yield pd.DataFrame(rows, columns=columns)

    return df.select(*key, content).where(F.char_length(content) > limit).mapInPandas(run, schema)

"""Filling fixed-capacity containers: documents along a space-filling curve, packed with their neighbours.

Each text becomes a hashed bag of words, projected to three dimensions; its place on the Hilbert curve through them is its sort key. Ranges of the
curve are packed independently, by best fit among a bounded number of open containers, so neighbours share containers and little space is left."""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage, spread

DIMENSIONS, BITS, BUCKETS = 3, 10, 256
#: Containers that stay open in a range; each range leaves at most the space of these half empty.
OPEN = 64
#: Tokens of one range of the curve at least, so that what its last containers leave is small against it.
RANGE_TOKENS = 1_000_000
_WORDS = re.compile(r"\w+")


def default_tokenizer() -> str:
    """Path of the default vocabulary, where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Where a text may be cut for encoding without a change of its tokens: no piece of the vocabulary's pattern goes on with a blank.
_SEAM = re.compile(r"(?<=\S)(?=[ \n])")
STRETCH = 100_000


def count_tokens(texts: list[str], path: str) -> list[int]:
    """Tokens of each whole text, as of its encoding in one piece. Long texts are encoded in stretches: they are cut only before a blank
    behind another sign, where one piece of the vocabulary's pattern always ends and the next begins; a stretch without such a place is encoded whole."""
    enc = _encoder(path)
    out = []
    for t in texts:
        t = t.encode("utf-8", "replace").decode("utf-8")
        n = at = 0
        while at < len(t):
            seam = _SEAM.search(t, at + STRETCH) if len(t) - at > 2 * STRETCH else None
            end = seam.start() if seam else len(t)
            n += len(enc.encode_ordinary(t[at:end]))
            at = end
        out.append(n)
    return out


@lru_cache(maxsize=2)
def _projection(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(BUCKETS, DIMENSIONS))


def coordinates(texts: list[str], seed: int = 7) -> np.ndarray:
    """Three coordinates of BITS bits for each text, from its hashed words."""
    x = np.zeros((len(texts), BUCKETS))
    for i, t in enumerate(texts):
        h = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in _WORDS.findall(t.lower())], np.int64)
        if len(h):
            np.add.at(x[i], h % BUCKETS, np.where(h >> 16 & 1, 1.0, -1.0))
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    p = (x / np.where(norm > 0, norm, 1)) @ _projection(seed)
    return np.clip((p + 2.5) / 5 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of rows of non-negative integer coordinates (Skilling's transpose form)."""
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            t = (x[:, 0] ^ x[:, i]) & p
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ t)
            x[:, i] = np.where(high, x[:, i], x[:, i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


class Packer:
    """Best fit among OPEN open containers; the fullest is closed when one more is needed."""

    def __init__(self, capacity: int, first: int) -> None:
        self.capacity, self.next = capacity, first
        self.free: list[int] = []
        self.ids: list[int] = []

    def put(self, size: int) -> int:
        """The container that takes an item of ``size``."""
        best = -1
        for i, f in enumerate(self.free):
            if f >= size and (best < 0 or f < self.free[best]):
                best = i
                if f == size:
                    break
        if best < 0:
            if len(self.free) >= OPEN:
                i = min(range(len(self.free)), key=self.free.__getitem__)
                del self.free[i], self.ids[i]
            self.free.append(self.capacity)
            self.ids.append(self.next)
            self.next += 1
            best = len(self.free) - 1
        self.free[best] -= size
        out = self.ids[best]
        if not self.free[best]:
            del self.free[best], self.ids[best]
        return out


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str | None = None, seed: int = 7) -> DataFrame:
    """(key, piece, start, tokens, container): every text in containers of ``capacity`` tokens. A text is cut only if it is longer than a container: then
    into full containers and one remainder, which is packed like a text. Pieces are numbered from 1, start counts tokens.

    Null texts give no row, empty ones a piece of no tokens. Repeated keys are items of their own. One shuffle of (key, size, curve key); equal texts
    and equal curve keys spread over ranges by a hash, so no range is unbounded. Containers are numbered without gaps only within a range."""
    path = tokenizer or default_tokenizer()
    schema = docs.select(key).schema.simpleString()[len("struct<") : -1] + ",tokens:bigint,place:bigint"

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = list(pdf[text])
            yield pd.DataFrame({key: pdf[key], "tokens": count_tokens(texts, path), "place": hilbert(coordinates(texts, seed))})

    sized = cut_lineage(spread(docs.select(key, text).where(f"{text} is not null")).mapInPandas(measure, schema))
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    ranges = int(max(1, min(total // RANGE_TOKENS, 1_000_000)))
    full = F.floor(F.greatest(F.col("tokens") - 1, F.lit(0)) / capacity)
    pieces = sized.select(key, "place", "tokens", F.explode(F.sequence(F.lit(0), full)).alias("i"))
    pieces = pieces.select(
        key,
        (F.col("i") + 1).cast("int").alias("piece"),
        (F.col("i") * capacity).alias("start"),
        F.least(F.lit(capacity), F.col("tokens") - F.col("i") * capacity).alias("tokens"),
        "place",
        F.xxhash64(F.col(key), F.col("i")).alias("tie"),
    )
    ranged = pieces.repartitionByRange(ranges, "place", "tie").sortWithinPartitions("place", "tie").withColumn("range", F.spark_partition_id())

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = None
        for pdf in batches:
            if packer is None and len(pdf):
                packer = Packer(capacity, int(pdf["range"].iloc[0]) << 40)
            yield pd.DataFrame({key: pdf[key], "piece": pdf["piece"], "start": pdf["start"], "tokens": pdf["tokens"], "container": [packer.put(int(s)) for s in pdf["tokens"]]})

    out = docs.select(key).schema.simpleString()[len("struct<") : -1] + ",piece:int,start:bigint,tokens:bigint,container:bigint"
    return ranged.select(key, "piece", "start", "tokens", "range").mapInPandas(fill, out)


def containers(packed: DataFrame) -> DataFrame:
    """Items and used tokens of every container."""
    return packed.groupBy("container").agg(F.count("*").alias("items"), F.sum("tokens").alias("used"))


def usage(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, and the share of their space that is used."""
    return packed.agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens")).withColumn("used", F.col("tokens") / (F.col("containers") * capacity))

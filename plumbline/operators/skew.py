"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

#: At most this many keys are ever treated as hot, whatever the size of the data: a hot key holds at least 1/HOT_KEYS of the rows.
HOT_KEYS = 1000


def hot_keys(df: DataFrame, key: str, rows: int, share: int = HOT_KEYS, least: int = 50_000) -> list:
    """Values of ``key`` that hold at least ``rows / share`` rows (and at least ``least``): no more than ``share`` of them, which
    bounds what is collected. Counted over all rows, with map-side partial counts."""
    found = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= max(least, rows / share))
    return [r[0] for r in found.select(key).collect()]


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: list | None = None) -> DataFrame:
    """Join ``left`` with ``right``, which holds at most one row per ``key``. Rows of hot keys are joined with a broadcast of the
    at most HOT_KEYS rows of ``right`` that they can meet; all others meet in a shuffle."""
    if not hot:
        return left.join(right, key, how)
    if len(hot) > HOT_KEYS:
        raise ValueError(f"{len(hot)} hot keys; at most {HOT_KEYS} can be broadcast")
    is_hot: Column = F.coalesce(F.col(key).isin(hot), F.lit(False))
    cold = left.where(~is_hot).join(right.where(~is_hot), key, how)
    warm = left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how)
    return cold.unionByName(warm)


def join_ends(edges: DataFrame, table: DataFrame, source: dict[str, str], target: dict[str, str], how: str = "inner") -> DataFrame:
    """``edges`` with columns of ``table`` (one row per ``id``) for both ends: ``source`` and ``target`` map columns of the table to their new names.
    Ends that hold a large share of the edges meet a broadcast of their few rows, all others a shuffle. Both inputs are computed once."""
    edges, table = cut_lineage(edges), cut_lineage(table)
    rows = edges.count()
    for end, names in (("source", source), ("target", target)):
        hot = hot_keys(edges, end, rows)
        edges = join_unique(edges, table.select(F.col("id").alias(end), *[F.col(a).alias(b) for a, b in names.items()]), end, how, hot)
    return edges

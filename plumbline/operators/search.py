"""Text and vector search over nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.scalars import cosine_distance, squash
from plumbline.session import cut_lineage


def query_tokens(query: str) -> list[str]:
    return query.lower().split()


def _tags() -> Column:
    return F.lower(F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "))


def _low(c: str) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


def token_search(nodes: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Nodes of which every token of the query stands in name, summary or tags, by id; none for a blank query."""
    tokens = query_tokens(query)
    hit = F.lit(bool(tokens))
    for t in tokens:
        hit = hit & (_low("name").contains(t) | _low("summary").contains(t) | _tags().contains(t))
    found = nodes.where(hit).select("id", "name", "type")
    return found if limit is None else found.orderBy("id").limit(limit)


def subsequence(token: str) -> str:
    """A pattern of the token's characters in order with anything between; every gap ends at the first next character, so it is matched in linear time."""
    chars = [c if c.isalnum() else "\\" + c for c in token]
    return chars[0] + "".join(f"[^{c}]*{c}" for c in chars[1:])


def raw_score(field: Column, token: str) -> Column:
    """16 for each character of a token that the field holds, 8 more at its beginning, 8 more if it is the whole. Where the characters stand in order but not
    together, 2 less and 1 less for each one between."""
    n = 16.0 * len(token)
    held = F.length(F.regexp_extract(field, f"(?s){subsequence(token)}", 0))
    apart = F.when(held > 0, F.greatest(F.lit(0.0), F.lit(n - 2 + len(token)) - held)).otherwise(0.0)
    return F.when(field == token, n + 16).when(field.startswith(token), n + 8).when(field.contains(token), n).otherwise(apart)


def ranked_search(nodes: DataFrame, query: str, limit: int = fixed.RANKED_LIMIT, node_type: str | None = None, cutoff: float = fixed.SEARCH_CUTOFF) -> DataFrame:
    """(id, score) of the best matches: a token scores by the weighted, squashed scores of the fields, a node by its best token; 1 - that is the score,
    the smaller the better, and ``cutoff`` and above are no matches. Ties by id."""
    fields = {"name": _low("name"), "tags": _tags(), "summary": _low("summary"), "language_notes": _low("language_notes")}
    best = F.lit(0.0)
    for t in query_tokens(query):
        total = F.lit(0.0)
        for f, weight in fixed.SEARCH_WEIGHTS.items():
            total = total + weight * squash(raw_score(fields[f], t))
        best = F.greatest(best, total)
    rows = nodes if node_type is None else nodes.where(F.col("type") == node_type)
    scored = rows.select("id", F.round(1 - best, 6).alias("score")).where(F.col("score") < cutoff)
    return scored.orderBy("score", "id").limit(limit)


def pooled_search(nodes: DataFrame, query: str, pool: int = fixed.POOL_LIMIT, limit: int = fixed.SEARCH_LIMIT) -> DataFrame:
    """Ranked search among the first ``pool`` token matches."""
    ids = token_search(nodes, query, max(pool, limit)).select("id")
    return ranked_search(nodes.join(F.broadcast(ids), "id", "left_semi"), query, limit)


def vector_top(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(vec_id, distance): the k nearest vectors to one row of ``query`` (v), exact, ties by id. k is at least 1."""
    row = query.select("v").first()
    if row is None or row["v"] is None:
        raise ValueError("no query vector")
    v = F.array(*[F.lit(float(x)) for x in row["v"]])
    scored = vectors.select("vec_id", F.round(cosine_distance(F.col("embedding"), v), 6).alias("distance"))
    return scored.orderBy("distance", "vec_id").limit(max(1, k))


def expand_hits(hits: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits and what is one step from them, among the nodes."""
    ids = hits.select("id")
    out = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    back = edges.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))
    return ids.unionByName(out).unionByName(back).distinct().join(nodes.select("id"), "id", "left_semi")


def batches(df: DataFrame, order: str, size: int, partitions: int | None = None) -> DataFrame:
    """Rows in batches of ``size`` by ``order``: each range is numbered on its own and shifted by the rows of the ranges before it, of which only
    the counts are collected."""
    ranged = (df.repartitionByRange(order) if partitions is None else df.repartitionByRange(partitions, order)).sortWithinPartitions(order)
    ranged = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = {r["_range"]: r["count"] for r in ranged.groupBy("_range").count().collect()}
    before, total = [], 0
    for i in range(max(counts, default=0) + 1):
        before.append(total)
        total += counts.get(i, 0)
    return ranged.withColumn("batch", F.floor((F.lit(before)[F.col("_range")] + F.col("_n")) / size)).drop("_range", "_n")

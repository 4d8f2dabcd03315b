"""Best representative of each duplicate group, field by field: fixed precedence, and iterative truth discovery."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ids import canonical_id, canonical_path, is_reference, squeeze
from plumbline.session import cut_lineage

# Remarks that stand in for a value, compared in lower case without surrounding signs.
STAND_INS = (
    "n/a",
    "na",
    "n.a",
    "none",
    "null",
    "nil",
    "unknown",
    "undefined",
    "untagged",
    "missing",
    "empty",
    "not available",
    "unavailable",
    "not applicable",
    "tbd",
    "tba",
    "tbc",
    "todo",
    "to do",
    "to be done",
    "to be determined",
    "to be defined",
    "fixme",
    "wip",
    "no summary",
    "no summary available",
    "no summary yet",
    "no summary provided",
    "no description",
    "no description available",
    "summary missing",
    "summary not available",
    "no tags",
    "no value",
    "no path",
    "no data",
)
FIELDS = ("summary", "tags", "file_path")
_EDGES = r"^[\s\p{P}\p{S}]+|[\s\p{P}\p{S}]+$"


def stand_in(c: Column) -> Column:
    """Whether a text is blank, nothing but signs, or a remark that the value is missing, unknown or still to be done."""
    bare = F.regexp_replace(F.lower(c), _EDGES, "")
    return (bare == "") | bare.isin(list(STAND_INS))


def usable_fields() -> dict[str, Column]:
    """For each field, whether a row's value is usable."""
    summary = F.col("summary").isNotNull() & ~stand_in(F.col("summary")) & ~F.coalesce(squeeze(F.col("summary")) == squeeze(F.col("name")), F.lit(False))
    tags = F.coalesce(F.exists("tags", lambda t: F.coalesce(~stand_in(t), F.lit(False))), F.lit(False))
    path = F.col("file_path").isNotNull() & ~stand_in(F.col("file_path"))
    return {"summary": summary, "tags": tags, "file_path": path}


def survivors(nodes: DataFrame) -> DataFrame:
    """One row per canonical id with two or more rows: node_id, rows, and for each field its surviving value and the pos it is from.

    Among rows with a usable value those whose origin is not ``guess`` (null counts as not) go first, then the latest updated_at (null is the earliest),
    then the largest pos. A field without a usable value gives null in both. One shuffle of partial maxima: a group of any size, also a hot one,
    is reduced to one row per task before it. Null and blank ids form no group; extra columns are ignored."""
    rank = F.struct(F.coalesce(F.col("origin") != "guess", F.lit(True)).alias("a"), F.col("updated_at").alias("b"), F.col("pos").alias("c"))
    ok = usable_fields()
    slim = nodes.where(is_reference(F.col("id"))).select(
        canonical_id(F.col("id")).alias("node_id"),
        *[F.when(ok[f], F.struct(rank.alias("rank"), (canonical_path(F.col(f)) if f == "file_path" else F.col(f)).alias("value"))).alias(f) for f in FIELDS],
    )
    best = slim.groupBy("node_id").agg(F.count("*").alias("rows"), *[F.max(f).alias(f) for f in FIELDS]).where("rows >= 2")
    return best.select(
        "node_id",
        "rows",
        *[c for f in FIELDS for c in (F.col(f"{f}.value").alias(f), F.col(f"{f}.rank.c").alias(f"{f}_pos"))],
    )


def survivor_positions(nodes: DataFrame) -> DataFrame:
    """survivors() as rows (node_id, field, pos); no row where a field has no usable value."""
    found = survivors(nodes)
    return (
        found.select("node_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_pos").alias("pos")) for f in FIELDS])).alias("x"))
        .select("node_id", "x.field", "x.pos")
        .where(F.col("pos").isNotNull())
    )


def claims(nodes: DataFrame) -> DataFrame:
    """Usable values as (entity, field, value, source, votes): source is the origin, value a comparable text. Repeated claims are counted, not kept."""
    ok = usable_fields()
    text = {"summary": squeeze(F.col("summary")), "tags": F.to_json(F.array_sort(F.array_distinct("tags"))), "file_path": canonical_path(F.col("file_path"))}
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.when(ok[f], text[f]).alias("value")) for f in FIELDS])
    flat = nodes.where(is_reference(F.col("id"))).select(
        canonical_id(F.col("id")).alias("entity"), F.coalesce("origin", F.lit("")).alias("source"), F.explode(rows).alias("x")
    )
    return (
        flat.where("x.value is not null").select("entity", "x.field", "x.value", "source").groupBy("entity", "field", "value", "source").agg(F.count("*").alias("votes"))
    )


class Truth(NamedTuple):
    """Chosen values (entity, field, value, support), reliabilities (source, trust), and how the iteration ended."""

    chosen: DataFrame
    trust: DataFrame
    rounds: int
    moved: float
    converged: bool


def discover_truth(votes: DataFrame, tolerance: float = 1e-4, max_rounds: int = 200, broadcast_sources: int = 100_000) -> Truth:
    """Iterative truth discovery over claims (entity, field, value, source, votes).

    Alternately, a value's support is the sum of its sources' log-odds weights, and a source's reliability is the smoothed share of
    support that its values hold within their (entity, field); until no reliability moves by more than ``tolerance``. Ties go to the
    smallest value. ``converged`` tells whether that was so within ``max_rounds``. Any number of sources: the reliabilities stay a table, which
    is broadcast while it has at most ``broadcast_sources`` rows. An empty input gives an empty result, which has converged."""
    votes = cut_lineage(votes)
    few = votes.select("source").distinct().limit(broadcast_sources + 1).count() <= broadcast_sources
    trust = cut_lineage(votes.select("source").distinct().withColumn("trust", F.lit(0.8)))
    moved, rounds = 0.0, 0
    while True:
        w = F.log(F.col("trust") / (1 - F.col("trust"))) + 3.0
        weighted = votes.join(F.broadcast(trust) if few else trust, "source").withColumn("w", w)
        support = weighted.groupBy("entity", "field", "value").agg(F.sum(F.col("w") * F.log1p("votes")).alias("support"))
        total = support.groupBy("entity", "field").agg(F.sum("support").alias("total"))
        supported = cut_lineage(support.join(total, ["entity", "field"]).withColumn("share", F.col("support") / F.col("total")))
        if rounds and moved <= tolerance or rounds >= max_rounds:
            break
        held = votes.join(supported, ["entity", "field", "value"]).groupBy("source").agg(F.sum("share").alias("hits"), F.count("*").alias("n"))
        fresh = cut_lineage(held.select("source", F.least(F.lit(0.99), F.greatest(F.lit(0.05), (F.col("hits") + 0.8) / (F.col("n") + 1.0))).alias("trust")))
        moved = fresh.join(trust.withColumnRenamed("trust", "before"), "source").agg(F.max(F.abs(F.col("trust") - F.col("before")))).first()[0] or 0.0
        trust, rounds = fresh, rounds + 1
    best = supported.groupBy("entity", "field").agg(F.min(F.struct((-F.col("support")).alias("neg"), "value")).alias("b"))
    return Truth(best.select("entity", "field", F.col("b.value").alias("value"), (-F.col("b.neg")).alias("support")), trust, rounds, moved, moved <= tolerance)


def agreement(nodes: DataFrame, truth: Truth) -> DataFrame:
    """(field, groups, same, rounds, converged): in how many groups of two or more rows truth discovery chooses the value that the fixed precedence keeps."""
    text = {"summary": squeeze(F.col("summary")), "tags": F.to_json(F.array_sort(F.array_distinct("tags"))), "file_path": F.col("file_path")}
    kept = survivors(nodes).select("node_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), text[f].alias("kept"), F.col(f"{f}_pos").alias("pos")) for f in FIELDS])).alias("x")).select(F.col("node_id").alias("entity"), "x.*").where("pos is not null")
    both = kept.join(truth.chosen, ["entity", "field"], "left")
    out = both.groupBy("field").agg(F.count("*").alias("groups"), F.sum(F.col("kept").eqNullSafe(F.col("value")).cast("bigint")).alias("same"))
    return out.withColumns({"rounds": F.lit(truth.rounds), "converged": F.lit(truth.converged)})


def build_records(chosen: DataFrame) -> DataFrame:
    """discover_truth's values as one record per entity, a column per field."""
    return chosen.groupBy("entity").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in FIELDS])

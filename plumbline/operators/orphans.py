"""References to records that do not exist: direct orphans, the cascade below them, and reports per table and period."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ids import canonical_id, is_reference
from plumbline.operators.skew import hot_keys, join_unique
from plumbline.session import cut_lineage


class OrphanReport(NamedTuple):
    direct: DataFrame
    cascade: DataFrame


def presence(nodes: DataFrame, external: DataFrame, tombstones: DataFrame) -> DataFrame:
    """One row per canonical id: ``seen`` (earliest first_seen_at), ``gone`` (earliest deleted_at), ``known`` (a row in nodes),
    ``external``. Null and blank ids give no row. A node whose first_seen_at is null in every row counts as always there."""
    none = F.lit(None).cast("timestamp_ntz")
    parts = [
        nodes.where(is_reference(F.col("id"))).select(
            canonical_id(F.col("id")).alias("ref"),
            F.col("first_seen_at").cast("timestamp_ntz").alias("seen"),
            none.alias("gone"),
            F.lit(1).alias("known"),
            F.lit(0).alias("external"),
        ),
        external.where(is_reference(F.col("id"))).select(canonical_id(F.col("id")).alias("ref"), none.alias("seen"), none.alias("gone"), F.lit(0).alias("known"), F.lit(1).alias("external")),
        tombstones.where(is_reference(F.col("id"))).select(
            canonical_id(F.col("id")).alias("ref"),
            none.alias("seen"),
            F.col("deleted_at").cast("timestamp_ntz").alias("gone"),
            F.lit(0).alias("known"),
            F.lit(0).alias("external"),
        ),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("ref").agg(F.min("seen").alias("seen"), F.min("gone").alias("gone"), F.max("known").alias("known"), F.max("external").alias("external"))


def references(edges: DataFrame) -> DataFrame:
    """Every endpoint of every edge as a row (pos, endpoint, ref, observed_at); null and blank endpoints are no references."""
    ends = F.explode(
        F.array(
            F.struct(F.lit("source").alias("endpoint"), F.col("source").alias("raw")),
            F.struct(F.lit("target").alias("endpoint"), F.col("target").alias("raw")),
        )
    )
    flat = edges.select("pos", F.col("observed_at").cast("timestamp_ntz").alias("observed_at"), ends.alias("e"))
    return flat.where(is_reference(F.col("e.raw"))).select("pos", "e.endpoint", canonical_id(F.col("e.raw")).alias("ref"), "observed_at")


def direct_orphans(edges: DataFrame, nodes: DataFrame, external: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Endpoints of ``edges`` that name nothing at the time the edge is observed: (pos, endpoint, ref, observed_at, reason).

    reason: ``missing`` (no such row), ``deleted`` (deleted at or before observed_at), ``later`` (first seen after it). External
    nodes are there at all times. Edges without observed_at can only miss their node. Repeated edges give a row each; other columns of the inputs
    are ignored, so they may have any names. Empty tables give the defined result: no edges, no rows; no nodes, all missing."""
    refs = references(edges)
    hot = hot_keys(refs, "ref", 2 * edges.count())
    j = join_unique(refs, presence(nodes, external, tombstones), "ref", "left", hot)
    at = F.col("observed_at")
    reason = (
        F.when(F.coalesce(F.col("external"), F.lit(0)) == 1, None)
        .when(F.coalesce(F.col("known"), F.lit(0)) == 0, "missing")
        .when(F.col("gone") <= at, "deleted")
        .when(F.col("seen") > at, "later")
    )
    return j.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("pos", "endpoint", "ref", "observed_at", "reason")


def orphan_report(direct: DataFrame) -> DataFrame:
    """Counts per referenced table, reason and month of observed_at. An id whose name begins with ``ext/`` refers to external_nodes."""
    table = F.when(F.substring_index("ref", ":", -1).startswith("ext/"), "external_nodes").otherwise("nodes")
    return (
        direct.select(table.alias("ref_table"), "reason", "endpoint", F.date_format("observed_at", "yyyy-MM").alias("month"))
        .groupBy("ref_table", "reason", "endpoint", "month")
        .agg(F.count("*").alias("orphans"))
    )


def cascade_report(cascaded: DataFrame) -> DataFrame:
    """Counts of cascade()'s rows per referenced table, kind (``direct`` or ``inherited``), endpoint and month of observed_at."""
    table = F.when(F.substring_index("ref", ":", -1).startswith("ext/"), "external_nodes").otherwise("nodes")
    kind = F.when(F.col("level") == 0, "direct").otherwise("inherited")
    return (
        cascaded.select(table.alias("ref_table"), kind.alias("kind"), "endpoint", F.date_format("observed_at", "yyyy-MM").alias("month"))
        .groupBy("ref_table", "kind", "endpoint", "month")
        .agg(F.count("*").alias("orphans"))
    )


def cascade(edges: DataFrame, nodes: DataFrame, external: DataFrame, tombstones: DataFrame, parent_type: str = "contains", max_rounds: int | None = None) -> DataFrame:
    """Direct and inherited orphans as (pos, endpoint, ref, observed_at, level): level 0 is direct, level n inherited in round n.

    Edges of ``parent_type`` are the foreign keys child -> parent. A node is indirectly orphaned when every container that its
    edges name is missing or itself orphaned; whatever refers to it is an inherited orphan. Fixpoint by semi-joins over
    distinct ids, each round cut by a checkpoint; only ids newly orphaned in a round are followed. A node in no container is not affected,
    nor are cycles that no orphan enters. Ends at the fixpoint only; exceeding ``max_rounds``, where it is given, raises, rather than giving a partial result."""
    direct = cut_lineage(direct_orphans(edges, nodes, external, tombstones))
    refs = references(edges)
    links = edges.where(F.col("type") == parent_type).select(canonical_id(F.col("source")).alias("parent"), canonical_id(F.col("target")).alias("child"), "pos")
    links = links.where((F.col("parent") != "") & (F.col("child") != "") & (F.col("parent") != F.col("child")))
    broken = direct.where(F.col("endpoint") == "source").select("pos", F.lit(1).alias("broken"))
    links = links.join(broken, "pos", "left")
    # One row per (parent, child); it holds as long as any of its edges does.
    links = cut_lineage(links.groupBy("parent", "child").agg(F.min(F.coalesce("broken", F.lit(0))).alias("broken")))
    alive = links.groupBy("child").agg(F.sum(1 - F.col("broken")).alias("alive"))
    lost = cut_lineage(alive.where("alive = 0").select(F.col("child").alias("ref"), F.lit(1).alias("level")))
    fresh, level = lost, 1
    while not fresh.isEmpty():
        if max_rounds is not None and level > max_rounds:
            raise RuntimeError(f"orphan cascade has not ended after {max_rounds} rounds")
        level += 1
        whole = links.where("broken = 0")
        touched = whole.join(fresh.select(F.col("ref").alias("parent")), "parent", "left_semi").select("child").distinct()
        state = whole.join(touched, "child", "left_semi").join(lost.select(F.col("ref").alias("parent"), F.lit(1).alias("dead")), "parent", "left")
        fresh = (
            state.groupBy("child")
            .agg(F.min(F.coalesce("dead", F.lit(0))).alias("all_dead"))
            .where("all_dead = 1")
            .select(F.col("child").alias("ref"), F.lit(level).alias("level"))
            .join(lost, "ref", "left_anti")
        )
        fresh = cut_lineage(fresh)
        lost = cut_lineage(lost.unionByName(fresh))
    inherited = refs.join(direct.select("pos", "endpoint"), ["pos", "endpoint"], "left_anti")
    hot = hot_keys(inherited, "ref", 2 * edges.count())
    inherited = join_unique(inherited, lost, "ref", "inner", hot).select("pos", "endpoint", "ref", "observed_at", "level")
    return direct.select("pos", "endpoint", "ref", "observed_at", F.lit(0).alias("level")).unionByName(inherited)

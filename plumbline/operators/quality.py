"""Validation of a graph: issue rows (severity, code, node_id, edge_id), statistics, and lenient loading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.ids import squeeze
from plumbline.functions.scalars import alias_of, clamp_weight


def _issue(df: DataFrame, severity: str, code: str, node: Column | None, edge: Column | None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), (none if node is None else node).alias("node_id"), (none if edge is None else edge).alias("edge_id"))


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """Every occurrence of an id after its first by pos."""
    first = nodes.groupBy("id").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    return nodes.join(first, "id").where("pos > first").select("id", "pos")


def edge_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id").distinct()
    key = F.concat(F.col("pos").cast("string"), F.lit(":"), F.coalesce("source", F.lit("")), F.lit("->"), F.coalesce("target", F.lit("")))
    w = F.col("weight").cast("double")
    return reduce(
        DataFrame.unionByName,
        [
            _issue(edges.join(ids.withColumnRenamed("id", "source"), "source", "left_anti"), "error", "MISSING_SOURCE_NODE", None, key),
            _issue(edges.join(ids.withColumnRenamed("id", "target"), "target", "left_anti"), "error", "MISSING_TARGET_NODE", None, key),
            _issue(edges.where(w.isNull() | F.isnan(w) | (w < 0) | (w > 1)), "error", "INVALID_EDGE_WEIGHT", None, key),
        ],
    )


def node_issues(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    several = members.groupBy("id").count().where("count > 1")
    file_level = nodes.where(F.col("type").isin(list(fixed.FILE_LEVEL_TYPES)))
    return reduce(
        DataFrame.unionByName,
        [
            _issue(duplicate_ids(nodes), "error", "DUPLICATE_NODE_ID", F.col("id"), None),
            _issue(nodes.where(F.coalesce(F.size("tags"), F.lit(0)) <= 0), "warning", "MISSING_TAGS", F.col("id"), None),
            _issue(nodes.where(F.coalesce(squeeze(F.col("summary")), F.lit("")) == ""), "warning", "MISSING_SUMMARY", F.col("id"), None),
            _issue(several, "warning", "NODE_IN_MULTIPLE_LAYERS", F.col("id"), None),
            _issue(file_level.join(members.select("id").distinct(), "id", "left_anti"), "warning", "FILE_NODE_NOT_IN_LAYER", F.col("id"), None),
            _issue(nodes.join(ends, "id", "left_anti"), "warning", "ORPHAN_NODE", F.col("id"), None),
            _issue(members.join(nodes.select("id").distinct(), "id", "left_anti"), "error", "LAYER_MISSING_NODE", F.col("id"), None),
        ],
    )


def validate(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """All issues of a graph. Empty tables have none."""
    return edge_issues(nodes, edges).unionByName(node_issues(nodes, edges, members))


def summary(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "code").agg(F.count("*").alias("issues"))


def extra_checks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Self-loops, and nodes whose type is not their id's prefix."""
    loops = _issue(edges.where("source = target"), "warning", "SELF_LOOP", F.col("source"), None)
    prefix = F.substring_index("id", ":", 1)
    return loops.unionByName(_issue(nodes.where(F.col("id").contains(":") & (prefix != F.col("type"))), "warning", "TYPE_PREFIX_MISMATCH", F.col("id"), None))


def lenient_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with aliases resolved and defaults filled in; rows without an id or name are dropped, of repeated ids the last row stays."""
    kind = alias_of(F.coalesce("type", F.lit("file")), fixed.NODE_TYPE_ALIASES)
    level = F.lower(squeeze(F.col("complexity")))
    for value, names in fixed.COMPLEXITY_ALIASES.items():
        level = F.when(level.isin(list(names)), value).otherwise(level)
    rows = nodes.where((squeeze(F.col("id")) != "") & (squeeze(F.col("name")) != "")).select(
        "id",
        F.when(kind.isin(list(fixed.NODE_TYPES)), kind).otherwise("file").alias("type"),
        "name",
        F.when(squeeze(F.coalesce("summary", F.lit(""))) != "", F.col("summary")).otherwise(F.col("name")).alias("summary"),
        F.when(level.isin("simple", "moderate", "complex"), level).otherwise("moderate").alias("complexity"),
        "pos",
    )
    return rows.groupBy("id").agg(F.max_by(F.struct("type", "name", "summary", "complexity"), "pos").alias("r")).select("id", "r.*")


def lenient_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with aliases resolved, weights coerced and clamped; those with a missing end are dropped."""
    kind = alias_of(F.coalesce("type", F.lit("depends_on")), fixed.EDGE_TYPE_ALIASES)
    way = alias_of(F.coalesce("direction", F.lit("forward")), fixed.DIRECTION_ALIASES)
    rows = edges.select("pos", "source", "target", kind.alias("type"), F.when(way.isin("forward", "backward", "bidirectional"), way).otherwise("forward").alias("direction"), clamp_weight(F.col("weight")).alias("weight"))
    rows = rows.where(F.col("type").isin(list(fixed.EDGE_TYPES)))
    return rows.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")



def exit_code(issues: DataFrame, strict: bool = False) -> int:
    """1 if there are errors, or in strict mode warnings, else 0."""
    bad = issues if strict else issues.where("severity = 'error'")
    return 0 if bad.isEmpty() else 1


def tour_checks(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(code, step): steps that are not numbered 1 to n, members that are no nodes, and a length outside 5 to 15. steps: (step, node_ids)."""
    numbers = steps.select("step").distinct()
    n = numbers.count()
    gaps = steps.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("step")).join(numbers, "step", "left_anti").select(F.lit("TOUR_STEP_GAP").alias("code"), "step")
    missing = steps.select("step", F.explode("node_ids").alias("id")).join(nodes.select("id"), "id", "left_anti").select(F.lit("TOUR_MISSING_NODE").alias("code"), "step")
    out = gaps.unionByName(missing)
    if not 5 <= n <= 15:
        out = out.unionByName(steps.sparkSession.createDataFrame([("TOUR_LENGTH", n)], "code string, step int"))
    return out

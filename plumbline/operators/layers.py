"""Layers of a codebase graph: detection by path, application of named patterns, aggregation over layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.scalars import layer_id
from plumbline.operators.skew import join_ends


def pattern_table(spark: SparkSession) -> DataFrame:
    """(segment, rank, layer): path segments of the fixed layers, singular and plural; a few dozen rows."""
    rows = [(s, i, name) for i, (name, patterns) in enumerate(fixed.LAYER_PATTERNS) for p in patterns for s in (p, p + "s")]
    return spark.createDataFrame(rows, "segment string, rank int, layer string")


def detect_layers(nodes: DataFrame) -> DataFrame:
    """(id, layer_id, layer) of every file node: the first layer that a segment of its path names, else Core."""
    files = nodes.where("type = 'file'").select("id", F.explode(F.split(F.lower(F.coalesce("file_path", F.lit(""))), "/")).alias("segment"))
    best = files.join(F.broadcast(pattern_table(nodes.sparkSession)), "segment").groupBy("id").agg(F.min(F.struct("rank", "layer")).alias("b"))
    named = nodes.where("type = 'file'").select("id").join(best, "id", "left").select("id", F.coalesce("b.layer", F.lit(fixed.CORE_LAYER)).alias("layer"))
    return named.select("id", layer_id(F.col("layer")).alias("layer_id"), "layer")


def apply_patterns(nodes: DataFrame, layers: list[tuple[str, list[str]]]) -> DataFrame:
    """(id, layer): files by the first layer one of whose path patterns begins the path or stands in it behind a slash; ``Other`` for the rest."""
    path = F.coalesce("file_path", F.lit(""))
    out = F.lit("Other")
    for name, patterns in reversed(layers):
        hit = F.lit(False)
        for p in patterns:
            hit = hit | path.startswith(p) | path.contains("/" + p)
        out = F.when(hit, name).otherwise(out)
    return nodes.where("type = 'file'").select("id", out.alias("layer"))


def layer_table(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(layer_id, layer, members, complexity): complex above 30 % complex members, else moderate above 30 % moderate ones, else simple."""
    rows = members.join(nodes.select("id", "complexity"), "id")
    share = lambda c: F.sum((F.coalesce(F.col("complexity") == c, F.lit(False))).cast("int")) / F.count("*")
    agg = rows.groupBy("layer_id", "layer").agg(F.count("*").alias("members"), share("complex").alias("c"), share("moderate").alias("m"))
    return agg.select("layer_id", "layer", "members", F.when(F.col("c") > 0.3, "complex").when(F.col("m") > 0.3, "moderate").otherwise("simple").alias("complexity"))


def layer_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(layer_a, layer_b, edges, types) between different layers, undirected: counts and the sorted types."""
    rows = join_ends(edges.select("source", "target", "type"), members.select("id", "layer_id"), {"layer_id": "la"}, {"layer_id": "lb"}).where("la <> lb")
    keys = F.least("la", "lb").alias("layer_a"), F.greatest("la", "lb").alias("layer_b")
    return rows.groupBy(*keys).agg(F.count("*").alias("edges"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))


def portals(members: DataFrame, edges: DataFrame, layer: str) -> DataFrame:
    """(layer_id, edges): edges between ``layer`` and each other one."""
    pairs = layer_edges(members, edges).where((F.col("layer_a") == layer) | (F.col("layer_b") == layer))
    other = F.when(F.col("layer_a") == layer, F.col("layer_b")).otherwise(F.col("layer_a"))
    return pairs.groupBy(other.alias("layer_id")).agg(F.sum("edges").alias("edges"))


def cross_layer_nodes(members: DataFrame, edges: DataFrame, one: str, two: str) -> DataFrame:
    """Ids of the nodes of two layers that an edge between these touches."""
    a, b = (members.where(F.col("layer_id") == x).select("id") for x in (one, two))
    s = lambda df, c: df.withColumnRenamed("id", c)
    hit = edges.join(s(a, "source"), "source", "left_semi").join(s(b, "target"), "target", "left_semi").unionByName(
        edges.join(s(b, "source"), "source", "left_semi").join(s(a, "target"), "target", "left_semi")
    )
    return hit.select(F.explode(F.array("source", "target")).alias("id")).distinct()

"""Queries of file structure: parsed items, structural hashes, change classes, frameworks, tours and guides."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import parsers
from plumbline.functions.ids import canonical_path
from plumbline.functions.scalars import language_of
from plumbline.operators import build, builder, graph
from plumbline.plans.common import edges_of, members_of, nodes_of
from plumbline.sources.tables import table


def _items(spark, d):
    return parsers.extract(table(spark, d, "source_files"), "file_id", language_of(F.col("path")), "content")


def structure_items(spark, d):
    return _items(spark, d)


def structure_hashes(spark, d):
    return parsers.structural_hash(_items(spark, d), "file_id")


def change_classes(spark, d):
    """Class of change between the first and the last scan of every path that was scanned again."""
    rows = table(spark, d, "source_files").where("content is not null").select("project", canonical_path(F.col("path")).alias("path"), "file_id", F.xxhash64("content").alias("text"), F.struct("scanned_at", "file_id").alias("at"))
    ends = rows.groupBy("project", "path").agg(F.min_by("file_id", "at").alias("a"), F.max_by("file_id", "at").alias("b"), F.min_by("text", "at").alias("ta"), F.max_by("text", "at").alias("tb")).where("a <> b")
    h = structure_hashes(spark, d)
    j = ends.join(h.select(F.col("file_id").alias("a"), F.col("structure").alias("sa")), "a", "left").join(h.select(F.col("file_id").alias("b"), F.col("structure").alias("sb")), "b", "left")
    return j.select("project", "path", parsers.classify_change(F.col("ta"), F.col("tb"), F.col("sa"), F.col("sb")).alias("change"))


def import_frameworks(spark, d):
    return parsers.frameworks_in_imports(_items(spark, d).where("`group` = 'import'"))


def tour_nodes(spark, d):
    n = nodes_of(spark, d)
    levels = graph.topological_levels(n.where("type = 'file'"), edges_of(spark, d).where("type = 'imports'"))
    return build.tour_nodes(levels, members_of(spark, d), n).select("step", "title", "id")


def tour_steps(spark, d):
    return tour_nodes(spark, d).groupBy("step", "title").agg(F.count("*").alias("nodes"))


def _files(spark, d):
    return table(spark, d, "source_files").select("file_id", "project", "path", language_of(F.col("path")).alias("language"))


def built_nodes(spark, d):
    return builder.build(_files(spark, d), _items(spark, d)).nodes


def built_edges(spark, d):
    return builder.build(_files(spark, d), _items(spark, d)).edges


def call_sites(spark, d):
    return builder.call_sites(table(spark, d, "source_files"), "file_id", language_of(F.col("path")), "content")


def call_edges(spark, d):
    return builder.call_edges(builder.build(_files(spark, d), _items(spark, d)), call_sites(spark, d), table(spark, d, "source_files"))


QUERIES = {"built_nodes": built_nodes, "built_edges": built_edges, "call_sites": call_sites, "call_edges": call_edges, "structure_items": structure_items, "structure_hashes": structure_hashes, "change_classes": change_classes, "import_frameworks": import_frameworks, "tour_steps": tour_steps, "tour_nodes": tour_nodes}
ORACLE: dict[str, str] = {}

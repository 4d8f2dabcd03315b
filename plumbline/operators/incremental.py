"""Incremental analysis: fingerprints, change plans, invalidation, upserts and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed
from plumbline.functions.ids import canonical_path, dirname
from plumbline.functions.scalars import text_hash


def snapshots(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old, new) fingerprints (project, path, hash) of scanned files: the first and the last scan of each path; null contents are no scans."""
    rows = files.where("content is not null").select("project", canonical_path(F.col("path")).alias("path"), text_hash(F.col("content")).alias("hash"), F.struct("scanned_at", "file_id").alias("at"))
    both = rows.groupBy("project", "path").agg(F.min_by("hash", "at").alias("old"), F.max_by("hash", "at").alias("new"), F.count("*").alias("n"))
    return both.where("n > 1").select("project", "path", F.col("old").alias("hash")), both.select("project", "path", F.col("new").alias("hash"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(project, path, change): new, changed, same or deleted."""
    a, b = old.withColumnRenamed("hash", "was"), new.withColumnRenamed("hash", "now")
    j = a.join(b, ["project", "path"], "full_outer")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed").otherwise("same")
    return j.select("project", "path", change.alias("change"))


def plan(changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project, changed, new, deleted, nodes, new_directories, action) per project: SKIP, FULL, ARCHITECTURE or PARTIAL."""
    counts = changed.groupBy("project").agg(*[F.sum((F.col("change") == c).cast("int")).alias(c) for c in ("changed", "new", "deleted", "same")])
    size = nodes.groupBy("project").agg(F.count("*").alias("nodes"))
    known = changed.where("change <> 'new'").select("project", dirname(F.col("path")).alias("dir")).distinct()
    fresh = changed.where("change = 'new'").select("project", dirname(F.col("path")).alias("dir")).distinct().join(known, ["project", "dir"], "left_anti").groupBy("project").agg(F.count("*").alias("new_directories"))
    j = counts.join(size, "project", "left").join(fresh, "project", "left").fillna(0, ["nodes", "new_directories"])
    total = F.col("changed") + F.col("new") + F.col("deleted")
    action = (
        F.when(total == 0, "SKIP")
        .when((total > fixed.FULL_THRESHOLD) | ((F.col("nodes") >= fixed.BIG_GRAPH) & (2 * total > F.col("nodes"))), "FULL")
        .when(F.col("new_directories") > 0, "ARCHITECTURE")
        .otherwise("PARTIAL")
    )
    return j.select("project", "changed", "new", "deleted", "nodes", "new_directories", action.alias("action"))


def drop_paths(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the nodes of ``paths`` (project, file_path) and the edges at these."""
    kept = nodes.join(paths, ["project", "file_path"], "left_anti")
    ids = kept.select("id").distinct()
    return kept, edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def embed_work(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``current`` (node_id, model, text_hash) whose stored hash is missing or another one."""
    s = stored.select("node_id", "model", F.col("text_hash").alias("stored"))
    return current.join(s, ["node_id", "model"], "left").where(F.col("stored").isNull() | (F.col("stored") != F.col("text_hash"))).select("node_id", "model", "text_hash")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last by ``order`` of both."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def forget(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def cache_hits(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached replies whose node, prompt and file hash all agree."""
    return asked.join(cache, ["node_id", "prompt_hash", "file_hash"], "inner")

"""Graph views and traversals: neighbourhoods, paths, blast radius, explanation, topological levels."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.ids import canonical_id, canonical_path, is_reference
from plumbline.session import cut_lineage


class Neighbourhood(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def graph_nodes(nodes: DataFrame) -> DataFrame:
    """One row per canonical id: the last by pos, with tags never null and a canonical path. Rows with blank ids are left out."""
    rows = nodes.where(is_reference(F.col("id"))).select(
        canonical_id(F.col("id")).alias("id"),
        F.struct(
            "pos", "kind", "project", "type", "name", canonical_path(F.col("file_path")).alias("file_path"), "summary",
            F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "complexity", "language_notes", "origin",
        ).alias("r"),
    )
    return rows.groupBy("id").agg(F.max_by("r", "r.pos").alias("r")).select("id", "r.*")


def graph_edges(edges: DataFrame) -> DataFrame:
    """Edges with canonical endpoints, the first by pos of each (source, target, type); edges with a blank endpoint are left out."""
    rows = edges.where(is_reference(F.col("source")) & is_reference(F.col("target"))).select(
        canonical_id(F.col("source")).alias("source"),
        canonical_id(F.col("target")).alias("target"),
        "type",
        F.struct("pos", "kind", "project", "direction", F.col("weight").cast("double").alias("weight")).alias("r"),
    )
    return rows.groupBy("source", "target", "type").agg(F.min_by("r", "r.pos").alias("r")).select("source", "target", "type", "r.*")


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, as distinct pairs (a, b)."""
    one = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    return one.unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()


def neighbours(nodes: DataFrame, edges: DataFrame, centers: DataFrame, depth: int = 1) -> Neighbourhood:
    """Nodes within ``depth`` (1 to 4) undirected steps of ``centers`` (id), each with its least depth, and all edges that a frontier touches.

    Level-synchronous: each round joins the frontier with the edges and drops what was visited. Ids without a node are passed through, not returned."""
    depth = min(4, max(1, depth))
    edges = cut_lineage(edges.select("source", "target", "type"))
    visited = centers.select("id", F.lit(0).alias("depth"))
    frontier, touched = visited, None
    for d in range(1, depth + 1):
        front = frontier.select("id")
        hit = edges.join(front.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(edges.join(front.withColumnRenamed("id", "target"), "target", "left_semi"))
        hit = cut_lineage(hit)
        touched = hit if touched is None else touched.unionByName(hit)
        # What an edge at the frontier touches is in the frontier, visited, or new.
        step = hit.select(F.explode(F.array("source", "target")).alias("id")).distinct()
        frontier = cut_lineage(step.join(visited, "id", "left_anti").withColumn("depth", F.lit(d)))
        visited = visited.unionByName(frontier)
    found = visited.where("depth > 0").join(nodes, "id", "inner")
    return Neighbourhood(found, touched.dropDuplicates(["source", "target", "type"]))


class _Rounds:
    """Rows that rounds add, each round written once; many rounds are written together from time to time, so that a plan stays small."""

    def __init__(self, first: DataFrame, every: int = 32) -> None:
        self.parts, self.every = [first], every

    def add(self, rows: DataFrame) -> None:
        self.parts.append(rows)
        if len(self.parts) > self.every:
            self.parts = [cut_lineage(self.whole())]

    def whole(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def reach(edges: DataFrame, roots: DataFrame, types: tuple[str, ...], max_rounds: int | None = None) -> DataFrame:
    """(id, depth) of everything that ``roots`` (id) reach along edges of ``types``, forward. Cycles end, as visited ids are not entered again.
    Ends when nothing new is met; exceeding ``max_rounds``, where it is given, raises."""
    step = cut_lineage(edges.where(F.col("type").isin(list(types))).select("source", F.col("target").alias("id")).distinct())
    frontier = cut_lineage(roots.select("id", F.lit(0).alias("depth")))
    visited, d = _Rounds(frontier), 0
    while max_rounds is None or d < max_rounds:
        d += 1
        new = step.join(frontier.select(F.col("id").alias("source")), "source", "left_semi").select("id").distinct()
        frontier = cut_lineage(new.join(visited.whole().select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        if frontier.isEmpty():
            return visited.whole()
        visited.add(frontier)
    raise RuntimeError(f"not ended after {max_rounds} rounds")


def shortest_path(edges: DataFrame, start: str, goal: str, max_rounds: int | None = None) -> list[str]:
    """The undirected shortest path from ``start`` to ``goal``, of several the lexicographically smallest; [] if there is none, [start] if they are equal.
    Ends when nothing new is met; exceeding ``max_rounds``, where it is given, raises."""
    if start == goal:
        return [start]
    pairs = cut_lineage(undirected(edges))
    spark = edges.sparkSession
    visited = frontier = spark.createDataFrame([(start, [start])], "id string, path array<string>")
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        step = frontier.join(pairs, frontier["id"] == pairs["a"]).select(F.col("b").alias("id"), F.concat("path", F.array("b")).alias("path"))
        frontier = cut_lineage(step.groupBy("id").agg(F.min("path").alias("path")).join(visited.select("id"), "id", "left_anti"))
        hit = frontier.where(F.col("id") == goal).first()
        if hit:
            return list(hit["path"])
        if frontier.isEmpty():
            return []
        visited = cut_lineage(visited.select("id").unionByName(frontier.select("id")))
    raise RuntimeError(f"not ended after {max_rounds} rounds")


def outgoing(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where(F.col("source") == node_id).select("target", "type")


class Blast(NamedTuple):
    changed: DataFrame
    affected: DataFrame
    edges: DataFrame
    unmapped: DataFrame


def blast_radius(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> Blast:
    """What a change of files (file_path) touches: their nodes and what these contain, the nodes one step away, the edges at the changed
    ones, and files that no node has."""
    nodes, edges = cut_lineage(nodes.select("id", "file_path")), cut_lineage(edges.select("source", "target", "type"))
    paths = paths.select(canonical_path(F.col("file_path")).alias("file_path")).distinct()
    own = nodes.join(paths, "file_path", "left_semi").select("id")
    held = edges.where("type = 'contains'").join(own.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    changed = own.unionByName(held).distinct().join(nodes.select("id"), "id", "left_semi")
    ends = changed.withColumnRenamed("id", "source"), changed.withColumnRenamed("id", "target")
    hit = edges.join(ends[0], "source", "left_semi").unionByName(edges.join(ends[1], "target", "left_semi")).dropDuplicates(["source", "target", "type"])
    around = hit.select(F.col("source").alias("id")).unionByName(hit.select(F.col("target").alias("id"))).distinct()
    affected = around.join(changed, "id", "left_anti").join(nodes.select("id"), "id", "left_semi")
    return Blast(changed, affected, hit, paths.join(nodes, "file_path", "left_anti"))


def explain(nodes: DataFrame, edges: DataFrame, target: str) -> Neighbourhood:
    """A node's surroundings as (id, role): target, child (it contains them), connected (one step from either), and the edges between them."""
    one = nodes.where(F.col("id") == target).select("id", F.lit(0).alias("rank"))
    child = edges.where((F.col("type") == "contains") & (F.col("source") == target)).select(F.col("target").alias("id"), F.lit(1).alias("rank"))
    inner = one.unionByName(child).groupBy("id").agg(F.min("rank").alias("rank"))
    keys = inner.select("id")
    hit = edges.join(keys.withColumnRenamed("id", "source"), "source", "left_semi").unionByName(edges.join(keys.withColumnRenamed("id", "target"), "target", "left_semi"))
    hit = hit.dropDuplicates(["source", "target", "type"])
    near = hit.select(F.col("source").alias("id")).unionByName(hit.select(F.col("target").alias("id"))).select("id", F.lit(2).alias("rank"))
    rows = inner.unionByName(near).groupBy("id").agg(F.min("rank").alias("rank")).join(nodes.select("id"), "id", "left_semi")
    role = F.when(F.col("rank") == 0, "target").when(F.col("rank") == 1, "child").otherwise("connected")
    return Neighbourhood(rows.select("id", role.alias("role")), hit)


def topological_levels(nodes: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(id, level): the longest distance from a root along edges between nodes; nodes on or behind cycles come last, with a null level.

    Kahn's peeling, a round per level: nodes without an open incoming edge are taken out with their edges. Ends when none is left to take; exceeding
    ``max_rounds``, where it is given, raises."""
    ids = cut_lineage(nodes.select("id").distinct())
    open_edges = edges.where("source <> target").select("source", "target").distinct()
    open_edges = cut_lineage(open_edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi"))
    rest, level = ids, 0
    done = _Rounds(ids.limit(0).withColumn("level", F.lit(0)))
    while True:
        ready = rest.join(open_edges.select(F.col("target").alias("id")).distinct(), "id", "left_anti")
        ready = cut_lineage(ready.withColumn("level", F.lit(level)))
        if ready.isEmpty():
            return done.whole().unionByName(rest.withColumn("level", F.lit(None).cast("int")))
        if max_rounds is not None and level >= max_rounds:
            raise RuntimeError(f"not ended after {max_rounds} rounds")
        done.add(ready)
        rest = cut_lineage(rest.join(ready, "id", "left_anti"))
        open_edges = cut_lineage(open_edges.join(ready.select(F.col("id").alias("source")), "source", "left_anti"))
        level += 1


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges of which both ends are among ``ids`` (id)."""
    return edges.join(ids.select(F.col("id").alias("source")).distinct(), "source", "left_semi").join(ids.select(F.col("id").alias("target")).distinct(), "target", "left_semi")

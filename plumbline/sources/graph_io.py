"""Reading and writing graphs: one Parquet dataset per table and kind, JSON documents, file trees, git status, settings."""

from __future__ import annotations

import fnmatch
import json
import os
import re
from dataclasses import dataclass, fields
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import fixed

KINDS = ("codebase", "domain", "knowledge")
SCHEMA_VERSION = 1
# What is left out of a source tree.
IGNORED = (".git", "node_modules", "target", "dist", "build", "__pycache__", ".venv", "venv")

NODE_SCHEMA = "pos bigint, kind string, id string, type string, name string, file_path string, summary string, tags array<string>, complexity string, language_notes string"
EDGE_SCHEMA = "pos bigint, kind string, source string, target string, type string, direction string, description string, weight double"


LAYER_SCHEMA = "kind string, layer_id string, name string, description string, rank bigint, node_id string"
TOUR_SCHEMA = "kind string, step int, title string, description string, rank bigint, node_id string"
PROJECT_SCHEMA = "kind string, name string, languages array<string>, frameworks array<string>, description string, analyzed_at string, git_commit_hash string"


class SavedGraph(NamedTuple):
    """All parts of a graph. layers and tour have a row per member, in the order of ``rank``; project has a row per kind."""

    nodes: DataFrame
    edges: DataFrame
    layers: DataFrame
    tour: DataFrame
    project: DataFrame


_PARTS = {"layers": LAYER_SCHEMA, "tour": TOUR_SCHEMA, "project": PROJECT_SCHEMA}


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the finished versions below ``folder``: those whose meta was written."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path)]
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/meta/_SUCCESS")))


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str, layers: DataFrame | None = None, tour: DataFrame | None = None, project: DataFrame | None = None) -> int:
    """Write a graph as a new version of ``folder`` and give its number. Readers see it when its meta, which is written last, is there; a failure leaves the
    version before in place, and a second writer of the same number fails. Edges without both their nodes are left out. A table per part, partitioned by kind, so a kind is
    read alone; members of layers and steps of tours are rows."""
    spark = nodes.sparkSession
    version = max(_versions(spark, folder), default=0) + 1
    base = f"{folder}/v{version}"
    ids = nodes.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    nodes.write.partitionBy("kind").parquet(f"{base}/nodes")
    kept.write.partitionBy("kind").parquet(f"{base}/edges")
    for name, part in (("layers", layers), ("tour", tour), ("project", project)):
        rows = spark.createDataFrame([], _PARTS[name]) if part is None else part
        rows.write.parquet(f"{base}/{name}")
    spark.createDataFrame([(SCHEMA_VERSION,)], "version int").coalesce(1).write.json(f"{base}/meta")
    return version


def load_graph(spark: SparkSession, folder: str, kind: str | None = None, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of load_saved()."""
    return load_saved(spark, folder, kind, version)[:2]


def load_saved(spark: SparkSession, folder: str, kind: str | None = None, version: int | None = None) -> SavedGraph:
    """The last finished version of a saved graph, or the given one, whole or one kind of it, with defaults for what is unknown: file, related, forward, 1.0, moderate."""
    found = _versions(spark, folder)
    version = (found[-1] if found else None) if version is None else version
    if version not in found:
        raise ValueError(f"no saved graph: {folder}")
    base = f"{folder}/v{version}"
    schema = spark.read.schema("version int").json(f"{base}/meta").first()
    if schema is None or schema[0] != SCHEMA_VERSION:
        raise ValueError(f"not a graph of version {SCHEMA_VERSION}: {folder}")
    if kind is not None and kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    read = lambda name: spark.read.parquet(f"{base}/{name}") if kind is None else spark.read.parquet(f"{base}/{name}").where(F.col("kind") == kind)
    nodes = read("nodes").withColumns(
        {"type": F.when(F.col("type").isin(list(fixed.NODE_TYPES)), F.col("type")).otherwise("file"), "complexity": F.when(F.col("complexity").isin("simple", "moderate", "complex"), F.col("complexity")).otherwise("moderate")}
    )
    edges = read("edges").withColumns(
        {
            "type": F.when(F.col("type").isin(list(fixed.EDGE_TYPES)), F.col("type")).otherwise("related"),
            "direction": F.when(F.col("direction").isin("forward", "backward", "bidirectional"), F.col("direction")).otherwise("forward"),
            "weight": F.coalesce("weight", F.lit(1.0)),
        }
    )
    return SavedGraph(nodes, edges, read("layers"), read("tour"), read("project"))


def export_json(nodes: DataFrame, edges: DataFrame, folder: str, layers: DataFrame | None = None, tour: DataFrame | None = None, project: DataFrame | None = None) -> None:
    """All parts as JSON lines, so that no document has to fit a task; parts that are not given are written empty."""
    spark = nodes.sparkSession
    given = {"nodes": nodes, "edges": edges, "layers": layers, "tour": tour, "project": project}
    for name, part in given.items():
        (spark.createDataFrame([], _PARTS[name]) if part is None else part).write.mode("overwrite").json(f"{folder}/{name}")


def import_saved(spark: SparkSession, folder: str, kind: str | None = None) -> SavedGraph:
    """Parts of export_json; the kind is the given one, else the rows' own, else codebase."""
    chosen = F.lit(kind) if kind else F.coalesce("kind", F.lit("codebase"))
    read = lambda name, schema: spark.read.schema(schema).json(f"{folder}/{name}").withColumn("kind", chosen)
    return SavedGraph(read("nodes", NODE_SCHEMA), read("edges", EDGE_SCHEMA), *(read(name, schema) for name, schema in _PARTS.items()))


def import_json(spark: SparkSession, folder: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of import_saved()."""
    return import_saved(spark, folder, kind)[:2]


def import_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One whole graph document ({kind, nodes, edges, ...}) in a file."""
    doc = spark.read.option("multiLine", True).schema(f"kind string, nodes array<struct<{_struct(NODE_SCHEMA)}>>, edges array<struct<{_struct(EDGE_SCHEMA)}>>").json(path)
    kind = F.coalesce(F.col("kind"), F.lit("codebase"))
    nodes = doc.select(kind.alias("k"), F.posexplode("nodes").alias("n", "x")).select(F.col("n").cast("bigint").alias("pos"), F.col("k").alias("kind"), "x.id", "x.type", "x.name", "x.file_path", "x.summary", "x.tags", "x.complexity", "x.language_notes")
    edges = doc.select(kind.alias("k"), F.posexplode("edges").alias("n", "x")).select(F.col("n").cast("bigint").alias("pos"), F.col("k").alias("kind"), "x.source", "x.target", "x.type", "x.direction", "x.description", "x.weight")
    return nodes, edges


def _struct(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split(" ", 1) for part in schema.split(", ")))


def walk_project(spark: SparkSession, root: str, patterns: tuple[str, ...] = ()) -> DataFrame:
    """(path, modified_at, length, content) of the text files below ``root``, without hidden, ignored and gitignored ones, and ``patterns``. Ignore files count
    in every folder for what is below it; of several rules that match, the last one, and ``!`` takes a path back in."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = os.path.abspath(root).rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), base, -1)
    rows = files.select(rel.alias("path"), F.unix_timestamp("modificationTime").alias("modified_at"), "length", F.decode("content", "UTF-8").alias("content"))
    hidden = F.exists(F.split("path", "/"), lambda s: s.startswith(".") | s.isin(list(IGNORED)))
    ignored = F.lit(False)
    for below, p in (*_ignore_rules(root), *(("", p) for p in patterns)):
        hit = F.col("path").rlike(_as_regex(p.removeprefix("!"), below))
        ignored = F.when(hit, not p.startswith("!")).otherwise(ignored)
    return rows.where(~hidden & ~ignored)


def _ignore_rules(root: str) -> list[tuple[str, str]]:
    """(folder, pattern) of all ignore files below ``root``, outer folders first."""
    found = []
    for folder, names, files in os.walk(root):
        names[:] = sorted(n for n in names if not n.startswith(".") and n not in IGNORED)
        if ".gitignore" in files:
            below = os.path.relpath(folder, root).replace(os.sep, "/")
            lines = Path(folder, ".gitignore").read_text().splitlines()
            found += [("" if below == "." else below, x.strip()) for x in lines if x.strip() and not x.startswith("#")]
    return found


def _gitignore(root: str) -> list[str]:
    path = Path(root, ".gitignore")
    return [x.strip() for x in path.read_text().splitlines() if x.strip() and not x.startswith(("#", "!"))] if path.exists() else []


def _as_regex(pattern: str, below: str = "") -> str:
    """A path pattern as a regular expression; one without a slash matches at any depth ``below`` its folder, a trailing slash a folder."""
    core = fnmatch.translate(pattern.strip("/")).removeprefix("(?s:").removesuffix(")\\z").removesuffix(")\\Z")
    base = "^" + re.escape(below) + "/" if below else "^"
    return (base if pattern.startswith("/") or "/" in pattern.strip("/") else base + "(?:.*/)?") + core + "(?:/|$)"


def write_ignore_file(root: str, name: str = ".plumblineignore") -> str:
    """Write a file of ignored patterns, the defaults and those of .gitignore; an existing one stays."""
    path = Path(root, name)
    if not path.exists():
        path.write_text("\n".join(["# Left out of the graph.", *IGNORED, "", "# From .gitignore.", *_gitignore(root)]) + "\n")
    return str(path)


def read_wiki(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of the markdown files below ``root``."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,mdx}")
    base = os.path.abspath(root).rstrip("/") + "/"
    return files.select(F.substring_index(F.col("_metadata.file_path"), base, -1).alias("path"), F.col("value").alias("text"))


def readme_head(files: DataFrame, most: int = fixed.README_BYTES) -> DataFrame:
    """(project, head): the beginning of each project's top-level README, at most ``most`` bytes and whole characters."""
    name = F.lower(F.regexp_replace("path", r"^(?:\./)+", ""))
    # A character that the cut has split becomes a replacement mark at the end, and goes.
    cut = F.substring(F.encode(F.col("content"), "UTF-8"), 1, most).cast("string")
    text = F.regexp_replace(F.make_valid_utf8(cut), "\ufffd$", "")
    rows = files.where(name.isin("readme.md", "readme", "readme.rst", "readme.txt") & F.col("content").isNotNull())
    return rows.groupBy("project").agg(F.min_by(text, name).alias("head"))


def write_overlay(changed: DataFrame, affected: DataFrame, folder: str) -> None:
    """Changed and affected ids of a diff as JSON lines."""
    changed.select("id", F.lit("changed").alias("state")).unionByName(affected.select("id", F.lit("affected").alias("state"))).write.mode("overwrite").json(folder)


def read_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """(id, state) of a written overlay."""
    return spark.read.schema("id string, state string").json(folder)


def git_changes(porcelain: str) -> list[str]:
    """New paths of ``git status --porcelain=v2 -z``; of a rename the new name, headers and ignored files are skipped."""
    out, parts = [], iter(porcelain.split("\0"))
    for record in parts:
        kind = record[:1]
        if kind == "1":
            out.append(record.split(" ", 8)[8])
        elif kind == "2":
            out.append(record.split(" ", 9)[9])
            next(parts, None)
        elif kind == "u":
            out.append(record.split(" ", 10)[10])
        elif kind == "?":
            out.append(record[2:])
    return out


def _read_settings(path: str) -> dict:
    text = Path(path).read_text()
    if not path.endswith((".yaml", ".yml")):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ValueError(f"no reader for {path} is installed") from e
    return yaml.safe_load(text) or {}


@dataclass
class Settings:
    """Options of a run; unknown keys raise."""

    project_name: str = ""
    full_threshold: int = fixed.FULL_THRESHOLD
    big_graph: int = fixed.BIG_GRAPH
    batch_size: int = 32
    concurrency: int = 4

    @classmethod
    def load(cls, path: str | None = None, **given) -> Settings:
        """Given values before those of a YAML or JSON file before the defaults. YAML needs its reader to be installed."""
        stored = _read_settings(path) if path and Path(path).exists() else {}
        merged = stored | {k: v for k, v in given.items() if v is not None}
        unknown = set(merged) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**merged)

"""Graphs from parsed files: file nodes, the nodes of what they define, contains, imports and calls edges."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import fixed, parsers
from plumbline.functions.ids import basename, canonical_path
from plumbline.functions.scalars import definition_type
from plumbline.session import spread

# The node type of files that are no code, by language.
FILE_TYPES = {
    "markdown": "document",
    "yaml": "config",
    "json": "config",
    "toml": "config",
    "ini": "config",
    "env": "config",
    "dockerfile": "service",
    "makefile": "pipeline",
    "sql": "table",
    "protobuf": "schema",
    "graphql": "schema",
    "terraform": "resource",
}
#: Items that become nodes: the id's prefix (null: their kind), and the node type (null: by their kind).
CHILDREN = {"function": ("function", "function"), "class": ("class", "class"), "definition": (None, None), "service": ("service", "service"), "endpoint": ("endpoint", "endpoint"), "step": ("step", "pipeline"), "resource": ("resource", "resource")}
_SUFFIXES = ("", ".py", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".go", ".rs", ".java", "/index.ts", "/index.tsx", "/index.js", "/__init__.py", "/mod.rs")


class Built(NamedTuple):
    nodes: DataFrame
    edges: DataFrame


def file_id(path: Column, language: Column) -> Column:
    """Id of a file's node: its type by language, and its path."""
    kind = F.lit("file")
    for name, node_type in FILE_TYPES.items():
        kind = F.when(language == name, node_type).otherwise(kind)
    return F.concat(kind, F.lit(":"), path)


def build(files: DataFrame, items: DataFrame) -> Built:
    """Nodes and edges of ``files`` (file_id, project, path, language) and their ``items`` (file_id, group, kind, name, detail, line).

    A node per file and project; one per function, class, definition, service, endpoint, step and resource, of several with one id the first by line; a
    contains edge from the file to each, and imports edges to the files of the project that imports name (relative names, dotted modules). Files without items are nodes too;
    null paths give none, items without their file none. Of several rows of a file (scans) the last file_id counts."""
    path = canonical_path(F.col("path"))
    rows = files.where("path is not null").select("file_id", "project", path.alias("path"), F.coalesce("language", F.lit("")).alias("language"))
    last = rows.groupBy("project", "path").agg(F.max_by(F.struct("file_id", "language"), "file_id").alias("r")).select("project", "path", "r.*")
    own = last.withColumn("parent", file_id(F.col("path"), F.col("language")))
    roots = own.select("project", F.col("parent").alias("id"), F.substring_index("parent", ":", 1).alias("type"), basename(F.col("path")).alias("name"), F.col("path").alias("file_path"), F.lit(None).cast("int").alias("line"), F.lit("").alias("summary"))
    prefix, kind = F.col("kind"), definition_type(F.col("kind"))
    for group, (p, t) in CHILDREN.items():
        if p is not None:
            prefix, kind = F.when(F.col("group") == group, p).otherwise(prefix), F.when(F.col("group") == group, t).otherwise(kind)
    code = F.col("group").isin("function", "class")
    fields = F.when(F.trim("detail") == "", 0).otherwise(F.size(F.split("detail", ",")))
    label = F.when((F.col("group") == "endpoint") & (F.col("kind") != ""), F.concat_ws(" ", F.upper("kind"), F.col("name"))).otherwise(F.col("name"))
    summary = (
        F.when(code, "")
        .when(F.col("group") == "definition", F.concat("kind", F.lit(": "), "name", F.lit(" ("), fields.cast("string"), F.lit(" fields)")))
        .when(F.col("group") == "service", F.when(F.trim("detail") == "", F.concat(F.lit("Service "), "name")).otherwise(F.concat(F.lit("Service "), "name", F.lit(" (image: "), "detail", F.lit(")"))))
        .when(F.col("group") == "endpoint", F.concat(F.lit("Endpoint: "), label))
        .when(F.col("group") == "step", F.concat(F.lit("Step: "), "name"))
        .otherwise(F.concat(F.lit("Resource: "), "name", F.lit(" ("), "kind", F.lit(")")))
    )
    held = items.where(F.col("group").isin(list(CHILDREN))).join(own.select("file_id", "project", "path", "parent"), "file_id")
    child = held.select("project", "parent", F.concat(prefix, F.lit(":"), "path", F.lit(":"), "name").alias("id"), kind.alias("type"), label.alias("name"), F.col("path").alias("file_path"), "line", summary.alias("summary"))
    child = child.groupBy("project", "id").agg(F.min_by(F.struct("parent", "type", "name", "file_path", "line", "summary"), "line").alias("r")).select("project", "id", "r.*")
    nodes = roots.unionByName(child.drop("parent"))
    contains = child.select("project", F.col("parent").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type"), F.lit(1.0).alias("weight"))
    return Built(nodes, contains.unionByName(import_edges(own, items)))


def import_edges(own: DataFrame, items: DataFrame) -> DataFrame:
    """imports edges between files of a project (own: file_id, project, path, parent): an import is looked up below the importing file's folder if it is relative,
    else from the root and from ``src``; with the usual suffixes, of several hits the first."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    held = items.where("`group` = 'import' and name <> ''").select("file_id", "name", F.col("kind").alias("how")).distinct().join(own.select("file_id", "project", "path", F.col("parent").alias("source")), "file_id")
    dots = F.length(F.regexp_extract("name", r"^(\.+)", 1))
    python = F.col("path").rlike(r"\.pyi?$")
    up = F.regexp_replace(folder, F.lit("x"), F.lit("x"))
    for n in (2, 3, 4):  # each further dot is a folder up
        up = F.when(dots >= n, F.regexp_replace(up, "/?[^/]*$", "")).otherwise(up)
    dotted = F.replace(F.regexp_replace("name", r"^\.+", ""), F.lit("."), F.lit("/"))
    joined = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("/"), b))
    relative = normal_path(joined(folder, F.col("name")))
    base = (
        F.when(python & (dots > 0), F.array(joined(up, dotted)))
        .when(python | F.col("path").endswith(".java"), F.array(dotted, F.concat(F.lit("src/"), dotted), F.concat(F.lit("src/main/java/"), dotted)))
        .when(F.col("path").endswith(".rs"), F.array(F.regexp_replace(F.replace(F.regexp_replace("name", r"^crate::", "src::"), F.lit("::"), F.lit("/")), r"[/{ ].*\{.*$|/\w+$", "")))
        .when(F.col("name").startswith("."), F.array(relative))
        .otherwise(F.array(F.col("name"), F.concat(F.lit("src/"), "name")))
    )
    tried = held.select("project", "source", "name", F.posexplode(base).alias("b", "stem")).select("project", "source", "name", "b", F.posexplode(F.array(*[F.concat("stem", F.lit(x)) for x in _SUFFIXES])).alias("s", "path"))
    hit = tried.join(own.select("project", "path", F.col("parent").alias("target")), ["project", "path"]).where("source <> target")
    first = hit.groupBy("project", "source", "name").agg(F.min_by("target", F.struct("b", "s")).alias("target"))
    return first.select("project", "source", "target", F.lit("imports").alias("type"), F.lit(fixed.WEIGHTS["imports"]).alias("weight")).distinct()


def normal_path(path: Column) -> Column:
    """A path without ``.`` parts, and without ``..`` parts as far as there are folders before them."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != ".") & (x != ""))
    empty = F.array().cast("array<string>")
    return F.array_join(F.aggregate(parts, empty, lambda acc, x: F.when((x == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))), "/")


def call_sites(files: DataFrame, key: str, language: Column, content: str) -> DataFrame:
    """(key, caller, callee, line) of the calls in files of languages with a call reader; the caller is the nearest enclosing function, ``<top>`` outside any. Narrow."""
    schema = files.select(key).schema.simpleString()[len("struct<") : -1] + ",caller string,callee string,line int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *c) for k, text in pdf.itertuples(index=False, name=None) for c in parsers.call_graph(text)]
            yield pd.DataFrame(rows, columns=[key, "caller", "callee", "line"])

    return spread(files.where((language == "python") & F.col(content).isNotNull()).select(key, content)).mapInPandas(run, schema)


def call_edges(built: Built, sites: DataFrame, files: DataFrame) -> DataFrame:
    """calls edges between function nodes: a callee of the same file first, else the one of an imported file. Calls of anything else give none."""
    path = files.where("path is not null").select("file_id", "project", canonical_path(F.col("path")).alias("path"))
    f = built.nodes.where("type = 'function'").select("project", F.col("id").alias("target"), F.col("name").alias("callee"), F.col("file_path").alias("at"))
    calls = sites.where("caller <> '<top>'").select("file_id", "caller", "callee").distinct().join(path, "file_id").select("project", "path", "caller", "callee").distinct()
    imported = built.edges.where("type = 'imports'").select("project", F.regexp_replace("source", "^[^:]*:", "").alias("path"), F.regexp_replace("target", "^[^:]*:", "").alias("at"))
    places = imported.withColumn("far", F.lit(1)).unionByName(path.select("project", "path", F.col("path").alias("at"), F.lit(0).alias("far")).distinct())
    hit = calls.join(places, ["project", "path"]).join(f, ["project", "at", "callee"])
    best = hit.groupBy("project", "path", "caller", "callee").agg(F.min_by("target", F.struct("far", "at")).alias("target"))
    source = F.concat(F.lit("function:"), "path", F.lit(":"), "caller")
    return best.select("project", source.alias("source"), "target", F.lit("calls").alias("type"), F.lit(fixed.WEIGHTS["calls"]).alias("weight")).distinct()

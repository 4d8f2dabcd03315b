"""Graph views of the test tables, and the same as common table expressions for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions import fixed
from plumbline.functions.ids import canonical_id_sql
from plumbline.operators import graph, layers
from plumbline.sources.tables import table

QUERY = "stale ledger"
LAYER_A, LAYER_B = "layer:data-layer", "layer:api-layer"


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_nodes(table(spark, d, "nodes"))


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_edges(table(spark, d, "edges"))


def members_of(spark: SparkSession, d: str) -> DataFrame:
    return layers.detect_layers(nodes_of(spark, d))


def trim_sql(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def case_sql(c: str, table_: dict, default: str = "NULL") -> str:
    """CASE over a table of value -> key, or key -> values."""
    rows = [(k, v) for k, v in table_.items()]
    if rows and isinstance(rows[0][1], tuple):
        whens = " ".join(f"WHEN {c} IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in rows)
    else:
        whens = " ".join(f"WHEN {c} = '{k}' THEN '{v}'" for k, v in rows)
    return f"(CASE {whens} ELSE {default} END)"


_PATH = rf"regexp_replace(replace({trim_sql('file_path')}, '\', '/'), '^(?:\./)+', '')"
NODES = f"""n AS (SELECT * EXCLUDE (rn) FROM (SELECT {canonical_id_sql("id")} AS id, pos, kind, project, type, name, {_PATH} AS file_path, summary,
coalesce(tags, []) AS tags, complexity, language_notes, origin, row_number() OVER (PARTITION BY {canonical_id_sql("id")} ORDER BY pos DESC) AS rn
FROM nodes WHERE {trim_sql("id")} <> '') WHERE rn = 1)"""
EDGES = f"""e AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY pos) AS rn FROM (
SELECT {canonical_id_sql("source")} AS source, {canonical_id_sql("target")} AS target, type, pos, kind, project, direction, weight::DOUBLE AS weight
FROM edges WHERE {trim_sql("source")} <> '' AND {trim_sql("target")} <> '')) WHERE rn = 1)"""
_LAYER_ROWS = ", ".join(f"('{s}', {i}, '{name}')" for i, (name, ps) in enumerate(fixed.LAYER_PATTERNS) for p in ps for s in (p, p + "s"))
MEMBERS = f"""pat(segment, rank, layer) AS (VALUES {_LAYER_ROWS}),
hit AS (SELECT id, arg_min(layer, rank) AS layer FROM (SELECT id, unnest(string_split(lower(coalesce(file_path, '')), '/')) AS segment FROM n WHERE type = 'file') JOIN pat USING (segment) GROUP BY id),
m AS (SELECT n.id, 'layer:' || regexp_replace(lower(coalesce(hit.layer, 'Core')), '\\s', '-', 'g') AS layer_id, coalesce(hit.layer, 'Core') AS layer FROM n LEFT JOIN hit USING (id) WHERE type = 'file')"""


def sql(body: str, *parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body

"""Queries of the orphan-reference operator with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.ids import canonical_id_sql
from plumbline.operators import orphans
from plumbline.sources.tables import table


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, d, n) for n in ("edges", "nodes", "external_nodes", "node_tombstones"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.direct_orphans(*_tables(spark, d)).select("pos", "endpoint")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(orphans.direct_orphans(*_tables(spark, d)))


def p4_cascade(spark: SparkSession, d: str) -> DataFrame:
    return orphans.cascade(*_tables(spark, d)).select("pos", "endpoint", "level")


def p4_cascade_report(spark: SparkSession, d: str) -> DataFrame:
    """Direct and inherited orphans per table and month; p4_report has the direct ones by reason, as its SQL does."""
    return orphans.cascade_report(orphans.cascade(*_tables(spark, d)))


_DIRECT = f"""
WITH n AS (SELECT {canonical_id_sql("id")} AS ref, min(first_seen_at) AS seen FROM nodes GROUP BY 1),
x AS (SELECT DISTINCT {canonical_id_sql("id")} AS ref FROM external_nodes),
t AS (SELECT {canonical_id_sql("id")} AS ref, min(deleted_at) AS gone FROM node_tombstones GROUP BY 1),
e AS (SELECT pos, 'source' AS endpoint, {canonical_id_sql("source")} AS ref, observed_at FROM edges
      UNION ALL SELECT pos, 'target', {canonical_id_sql("target")}, observed_at FROM edges),
d AS (SELECT e.pos, e.endpoint, e.ref, e.observed_at,
        CASE WHEN n.ref IS NULL THEN 'missing' WHEN t.gone <= e.observed_at THEN 'deleted' WHEN n.seen > e.observed_at THEN 'later' END AS reason
      FROM e LEFT JOIN n USING (ref) LEFT JOIN t USING (ref) WHERE e.ref <> '' AND e.ref NOT IN (SELECT ref FROM x))
"""

# What no unbroken chain of containers ties to a node without containers, or to a cycle of them, is lost; the longest chain above it is its level.
_CASCADE = f"""{_DIRECT.replace("WITH n AS", "WITH RECURSIVE n AS", 1)},
links AS (SELECT parent, child, min(broken) AS broken FROM (
  SELECT c.parent, c.child, CASE WHEN b.pos IS NULL THEN 0 ELSE 1 END AS broken
  FROM (SELECT pos, {canonical_id_sql("source")} AS parent, {canonical_id_sql("target")} AS child FROM edges WHERE type = 'contains') c
  LEFT JOIN (SELECT pos FROM d WHERE reason IS NOT NULL AND endpoint = 'source') b USING (pos) WHERE c.parent <> '' AND c.child <> '' AND c.parent <> c.child) GROUP BY 1, 2),
u AS (SELECT parent, child FROM links WHERE broken = 0),
free(id) AS (SELECT parent FROM u WHERE parent NOT IN (SELECT child FROM links) UNION SELECT u.child FROM free JOIN u ON u.parent = free.id),
w(id, depth) AS (SELECT DISTINCT child, 0 FROM links UNION SELECT u.child, w.depth + 1 FROM w JOIN u ON u.parent = w.id WHERE w.depth < 60),
lost AS (SELECT id, max(depth) + 1 AS level FROM w WHERE id NOT IN (SELECT id FROM free) GROUP BY id HAVING max(depth) < 60),
every AS (SELECT pos, endpoint, ref, observed_at, 0 AS level FROM d WHERE reason IS NOT NULL
  UNION ALL SELECT e.pos, e.endpoint, e.ref, e.observed_at, lost.level FROM e JOIN lost ON lost.id = e.ref ANTI JOIN (SELECT pos, endpoint FROM d WHERE reason IS NOT NULL) g ON g.pos = e.pos AND g.endpoint = e.endpoint)
"""

QUERIES = {"p4_found": p4_found, "p4_report": p4_report, "p4_cascade": p4_cascade, "p4_cascade_report": p4_cascade_report}
ORACLE = {
    "p4_cascade": _CASCADE + "SELECT pos, endpoint, level FROM every",
    "p4_cascade_report": _CASCADE
    + """SELECT CASE WHEN starts_with(split_part(ref, ':', -1), 'ext/') THEN 'external_nodes' ELSE 'nodes' END AS ref_table, CASE WHEN level = 0 THEN 'direct' ELSE 'inherited' END AS kind,
endpoint, strftime(observed_at, '%Y-%m') AS month, count(*) AS orphans FROM every GROUP BY ALL""",
    "p4_found": _DIRECT + "SELECT pos, endpoint FROM d WHERE reason IS NOT NULL",
    "p4_report": _DIRECT
    + """SELECT CASE WHEN starts_with(split_part(ref, ':', -1), 'ext/') THEN 'external_nodes' ELSE 'nodes' END AS ref_table, reason, endpoint,
strftime(observed_at, '%Y-%m') AS month, count(*) AS orphans FROM d WHERE reason IS NOT NULL GROUP BY ALL""",
}

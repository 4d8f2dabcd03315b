"""Queries on records: duplicates of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.functions.ids import canonical_id_sql
from plumbline.llm import survivors as S
from plumbline.sources.tables import table


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return S.survivor_positions(table(spark, d, "nodes"))


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    return S.survivors(table(spark, d, "nodes"))


def p7_truth(spark: SparkSession, d: str) -> DataFrame:
    return S.build_records(S.discover_truth(S.claims(table(spark, d, "nodes"))).chosen)


def p7_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often truth discovery chooses what the stated precedence keeps, and whether it converged."""
    nodes = table(spark, d, "nodes")
    return S.agreement(nodes, S.discover_truth(S.claims(nodes)))


_IN = ", ".join(f"'{s}'" for s in S.STAND_INS)


def _stand_in(c: str) -> str:
    bare = rf"regexp_replace(lower({c}), '^[\s\pP\pS]+|[\s\pP\pS]+$', '', 'g')"
    return f"({bare} = '' OR {bare} IN ({_IN}))"


def _trim(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


QUERIES = {"p7_found": p7_found, "p7_records": p7_records, "p7_truth": p7_truth, "p7_agreement": p7_agreement}
ORACLE = {
    "p7_found": rf"""
WITH n AS (SELECT {canonical_id_sql("id")} AS node_id, * FROM nodes WHERE {_trim("id")} <> ''),
g AS (SELECT node_id FROM n GROUP BY 1 HAVING count(*) >= 2),
v AS (
 SELECT node_id, 'summary' AS field, pos, origin, updated_at FROM n WHERE summary IS NOT NULL AND NOT {_stand_in("summary")} AND NOT coalesce({_trim("summary")} = {_trim("name")}, false)
 UNION ALL SELECT node_id, 'tags', pos, origin, updated_at FROM n WHERE len(list_filter(tags, lambda t: t IS NOT NULL AND NOT {_stand_in("t")})) > 0
 UNION ALL SELECT node_id, 'file_path', pos, origin, updated_at FROM n WHERE file_path IS NOT NULL AND NOT {_stand_in("file_path")})
SELECT node_id, field, pos FROM v SEMI JOIN g USING (node_id)
QUALIFY row_number() OVER (PARTITION BY node_id, field ORDER BY coalesce(origin <> 'guess', true) DESC, updated_at DESC NULLS LAST, pos DESC) = 1""",
}

"""Queries on files and requests: oversized texts and credentials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import chunking, credentials
from plumbline.sources.tables import table


def contents(spark: SparkSession, d: str) -> DataFrame:
    """Files and requests as (src, row_id, content)."""
    files = table(spark, d, "source_files").select(F.lit("source_files").alias("src"), F.col("file_id").alias("row_id"), "content")
    return files.unionByName(table(spark, d, "summary_requests").select(F.lit("summary_requests").alias("src"), F.col("request_id").alias("row_id"), "content"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(contents(spark, d), ["src", "row_id"], "content")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).where("piece = 1").select("src", "row_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.find_credentials(contents(spark, d), ["src", "row_id"], "content").select("src", "row_id", "line_no")


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redact_column(contents(spark, d), ["src", "row_id"], "content")


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces, "p6_found": p6_found, "p6_redacted": p6_redacted}
ORACLE = {
    "p3_found": """SELECT 'source_files' AS src, file_id AS row_id FROM source_files WHERE length(content) > 8000
UNION ALL SELECT 'summary_requests', request_id FROM summary_requests WHERE length(content) > 8000""",
}

"""Queries on source files: syntax and hand-written source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import handwritten, syntax
from plumbline.sources.tables import table


def p5_broken(spark: SparkSession, d: str) -> DataFrame:
    return syntax.find_broken(table(spark, d, "source_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_broken(spark, d).select("file_id")


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "source_files"), p5_broken(spark, d))


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.classify(table(spark, d, "source_files"), table(spark, d, "library_files"), syntax.parses)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_reasons(spark, d).select("file_id")


def p1_handwritten(spark: SparkSession, d: str) -> DataFrame:
    """The files that remain: neither tool-made nor broken nor empty."""
    files = table(spark, d, "source_files").where(F.coalesce(F.length("content"), F.lit(0)) > 0)
    return files.select("file_id", "project", "path").join(p1_found(spark, d), "file_id", "left_anti").join(p5_found(spark, d), "file_id", "left_anti")


QUERIES = {"p1_found": p1_found, "p1_reasons": p1_reasons, "p1_handwritten": p1_handwritten, "p5_found": p5_found, "p5_broken": p5_broken, "p5_rates": p5_rates}
ORACLE: dict[str, str] = {}

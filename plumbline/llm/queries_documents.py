"""Queries on documents: packing, leaked test items and garbled texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import encoding, leakage, packing
from plumbline.sources.tables import table


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_passages(spark, d).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return p9_passages(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest_passage"))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_restored(spark, d).select("doc_id")


def p8_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(p8_packing(spark, d))


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    return packing.usage(p8_packing(spark, d))


QUERIES = {"p8_packing": p8_packing, "p8_containers": p8_containers, "p8_usage": p8_usage, "p9_found": p9_found, "p9_passages": p9_passages, "p9_items": p9_items, "p10_found": p10_found, "p10_restored": p10_restored}
ORACLE: dict[str, str] = {}

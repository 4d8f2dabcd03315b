"""Queries on vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import neighbours
from plumbline.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(neighbours.nearest(table(spark, d, "node_vectors"), k=10, min_similarity=0.85))


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(table(spark, d, "node_vectors"), k=10)
    ids = table(spark, d, "node_vectors").select(F.col("vec_id").alias("neighbour"), F.col("node_id").alias("neighbour_node"))
    return near.join(ids, "neighbour").select("model", "vec_id", "neighbour", "neighbour_node", "similarity")


QUERIES = {"p2_found": p2_found, "p2_neighbours": p2_neighbours}
ORACLE: dict[str, str] = {}

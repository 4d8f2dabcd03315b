"""Readers of the tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; Parquet gives column pruning and filter pushdown."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

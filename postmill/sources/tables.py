"""Parquet table access and the archive's declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``; columns and filters are pruned by the reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

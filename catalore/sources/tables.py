"""Parquet tables of a catalogue directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table; its columns keep their names and types."""
    return spark.read.parquet(f"{folder}/{name}.parquet")

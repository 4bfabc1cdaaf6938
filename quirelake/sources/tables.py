"""Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from ..session import ship


def table(spark: SparkSession, folder: str, name: str, *columns: str | Column) -> DataFrame:
    """The table ``name`` of ``folder``; with ``columns``, only these are read."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df

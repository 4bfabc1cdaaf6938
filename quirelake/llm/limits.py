"""The table of size limits: one row per limited field, the same few at every scale."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import SparkSession

from ..sources.tables import table


class Limit(NamedTuple):
    max_size: int
    overlap: int


def limits(spark: SparkSession, folder: str) -> dict[str, Limit]:
    rows = table(spark, folder, "size_limits", "field", "max_size", "overlap").dropna().collect()
    return {r.field: Limit(r.max_size, r.overlap) for r in rows}

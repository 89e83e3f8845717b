"""The corpus tables, and what cuts a plan's lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..shared import drop, free, scope, written

__all__ = ["drop", "free", "scope", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

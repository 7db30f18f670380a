"""Parquet table access for the harness tables and stored acadspark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HARNESS_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """Read ``<base_dir>/<name>.parquet``; projections and filters push down to the scan."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Lazy attribute access: ``t = Tables(spark, dir); t.lineitem``."""

    def __init__(self, spark: SparkSession, base_dir: str):
        self._spark = spark
        self._dir = base_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self._spark, self._dir, name)

"""Reading the shared Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline.session import use_utc


class Tables:
    """Lazy access to the tables of one folder: ``Tables(spark, folder).part``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = use_utc(spark), folder.rstrip("/")
        self._opened: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._opened:  # the footer is read once per query, not once per mention
            self._opened[name] = self.spark.read.parquet(self.path(name))
        return self._opened[name]

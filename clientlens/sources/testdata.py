"""Loader for the driver-supplied parquet tables (one file per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


class TestData:
    """Lazy handles on ``{sf_dir}/{name}.parquet``.

    Reading is lazy; column pruning and filter push-down reach the parquet
    scan because every operator selects only what it needs.
    """

    __test__ = False  # not a pytest class

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return os.path.join(self.sf_dir, f"{name}.parquet")

    def table(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(self.path(name))
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    def register_views(self) -> None:
        """Expose every table as a temp view (for ``spark.sql``)."""
        for t in TABLES:
            if os.path.exists(self.path(t)):
                self.table(t).createOrReplaceTempView(t)

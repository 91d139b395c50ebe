"""A small table of values by key, each with the version of what it was made of."""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession

from tremor.sources import sinks


class KeyValue:
    """``put`` replaces a key's value; ``get`` gives it only for the same version. A write that did not end is no value."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, key: str) -> str:
        return f"{self.path}/key={hashlib.sha256(key.encode()).hexdigest()[:32]}"

    def put(self, key: str, version: str, value: str) -> None:
        self.spark.createDataFrame([(key, version, value)], "name string, version string, value string").coalesce(1).write.mode("overwrite").parquet(self._at(key))

    def get(self, key: str, version: str) -> str | None:
        if not sinks.exists(self.spark, f"{self._at(key)}/_SUCCESS"):
            return None
        row = self.spark.read.parquet(self._at(key)).first()
        return row["value"] if row and (row["name"], row["version"]) == (key, version) else None

"""A run's progress as one small JSON file: which paths are done, of how many, and whether the run ended."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from glimmer.sources.snapshots import Snapshots


class Checkpoint:
    """Kept beside a library's tables and replaced as a whole. The paths themselves are a table, named by a version."""

    SCHEMA = "relative_path string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Snapshots(spark, root)

    def write(self, done: DataFrame, total: int, complete: bool = False) -> dict:
        """Note the processed paths (relative_path), the total, and whether the run ended."""
        paths = done.select("relative_path").distinct()
        state = self.spark.createDataFrame([(json.dumps({"total_count": total, "complete": complete}),)], "state string")
        self.store.commit({"paths": paths, "state": state})
        return self.status()

    def read(self) -> DataFrame | None:
        """The processed paths of a run to go on with; None where there is none, it ended, or it can't be read."""
        status = self.status()
        return None if status is None or status["complete"] else self.store.read("paths", self.spark.createDataFrame([], self.SCHEMA).schema)

    def status(self) -> dict | None:
        """processed_count, total_count, percent and complete; None where there is no checkpoint or it is damaged."""
        try:
            if "state" not in self.store.current():
                return None
            state = json.loads(self.store.read("state", self.spark.createDataFrame([], "state string").schema).first()[0])
            n = self.store.read("paths", self.spark.createDataFrame([], self.SCHEMA).schema).count()
        except Exception:  # noqa: BLE001  any damage means that the run starts anew
            return None
        return {"processed_count": n, "percent": 100 * n // max(state["total_count"], 1)} | state

    def clear(self) -> None:
        self.store.clear()

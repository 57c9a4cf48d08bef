"""Trained models by version: a folder each, listed once its manifest is written."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersift.operators.classifier import TriageModel

_MANIFEST = "version long, rows long, test_accuracy double, created_at timestamp"


class ModelRegistry:
    """``models/version=N`` holds a model, ``listed/version=N`` what it was trained on; without the second it does not count."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _versions(self, folder: str, pattern: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}/{pattern}")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path) or []
        names = [p.getPath() for p in found]
        return sorted(int(n.getName().split("=")[1]) if "=" in n.getName() else int(n.getParent().getName().split("=")[1]) for n in names)

    def versions(self) -> list[int]:
        return self._versions("listed", "version=*/_SUCCESS")

    def register(self, model: TriageModel, rows: int, test_accuracy: float | None = None, at: datetime | None = None) -> int:
        """Save under the next version; returns it."""
        version = max([*self._versions("models", "version=*"), *self.versions()], default=-1) + 1
        model.save(f"{self.root}/models/version={version}")
        facts = self.spark.createDataFrame([(version, rows, test_accuracy, at)], _MANIFEST)
        facts.withColumn("created_at", F.coalesce("created_at", F.current_timestamp())).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/listed/version={version}")
        return version

    def manifest(self) -> DataFrame:
        """One row per version."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(*[f"{self.root}/listed/version={v}" for v in known])

    def load(self, version: int) -> TriageModel:
        return TriageModel.load(f"{self.root}/models/version={version}")

    def newest(self) -> TriageModel | None:
        known = self.versions()
        return self.load(known[-1]) if known else None

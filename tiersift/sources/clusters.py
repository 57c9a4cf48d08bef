"""Cluster results on disk: long-form Parquet for further work, JSON lines for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersift.operators.clusters import export_document


def save_clusters(path: str, assignments: DataFrame, representatives: DataFrame,
                  summaries: DataFrame, mode: str = "errorifexists") -> None:
    """Assignments, representatives and one JSON document per cluster under one folder."""
    assignments.write.mode(mode).parquet(f"{path}/assignments")
    representatives.write.mode(mode).parquet(f"{path}/representatives")
    export_document(summaries).write.mode(mode).json(f"{path}/summary")


def load_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables back; the noise id stays a number."""
    assignments = spark.read.parquet(f"{path}/assignments")
    key = assignments.schema["email_id"].dataType.simpleString()
    cluster = assignments.schema["cluster_id"].dataType.simpleString()
    documents = spark.read.schema(f"cluster_id {cluster}, document string").json(f"{path}/summary")
    fields = (f"representative_id {key}, size long, representative_fingerprint string, "
              f"representative_subject string, representative_from string, member_preview array<{key}>")
    summaries = documents.select("cluster_id", F.from_json("document", fields).alias("s")).select(
        "cluster_id", "s.*")
    return assignments, spark.read.parquet(f"{path}/representatives"), summaries

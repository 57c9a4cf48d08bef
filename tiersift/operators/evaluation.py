"""Model quality from a table of true and predicted 0/1 classes: one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, truth: str, predicted: str, classes=(0, 1)) -> DataFrame:
    """Rows are true classes, columns ``predicted_<class>``."""
    return df.groupBy(F.col(truth).cast("int").alias("truth")).agg(*[
        F.count_if(F.col(predicted) == c).alias(f"predicted_{c}") for c in classes])


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def report(df: DataFrame, truth: str, predicted: str, classes=(0, 1)) -> DataFrame:
    """``class, precision, recall, f1, support`` per class and for both averages, and accuracy.

    The accuracy row carries the value in all three ratios.
    """
    t, p = F.col(truth), F.col(predicted)
    counted = df.agg(F.count("*").alias("n"), F.count_if(t == p).alias("right"), *[
        c for k in classes for c in (
            F.count_if((t == k) & (p == k)).alias(f"hit_{k}"),
            F.count_if(p == k).alias(f"said_{k}"), F.count_if(t == k).alias(f"is_{k}"))])

    def per_class(k):
        precision = _ratio(F.col(f"hit_{k}"), F.col(f"said_{k}"))
        recall = _ratio(F.col(f"hit_{k}"), F.col(f"is_{k}"))
        return precision, recall, _ratio(2 * precision * recall, precision + recall), F.col(f"is_{k}")

    measured = {str(k): per_class(k) for k in classes}

    def averaged(weight):
        return [sum((m[i] * weight(m) for m in measured.values()), F.lit(0.0)) for i in range(3)]

    right = _ratio(F.col("right"), F.col("n"))
    rows = measured | {
        "macro avg": (*averaged(lambda m: F.lit(1.0 / len(classes))), F.col("n")),
        "weighted avg": (*averaged(lambda m: _ratio(m[3], F.col("n"))), F.col("n")),
        "accuracy": (right, right, right, F.col("n")),
    }
    return counted.select(F.inline(F.array(*[F.struct(
        F.lit(name).alias("class"), r[0].cast("double").alias("precision"),
        r[1].cast("double").alias("recall"), r[2].cast("double").alias("f1"),
        r[3].cast("long").alias("support")) for name, r in rows.items()])))

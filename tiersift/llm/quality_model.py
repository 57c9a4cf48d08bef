"""Quality scores: random Fourier features, ridge regression from summed normal equations, isotonic calibration.

Edge cases: null and empty texts have all-zero statistics and get a score like any other; labels that are null or
belong to no document are ignored, repeated ones count as often as they occur; without both classes the
score is the share of good labels (0.5 without any). Long texts are measured whole, in chunks of whole texts; equal raw scores get equal
scores; repeated rows are scored each; an empty table gives an empty result. Nothing but the text enters a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersift.llm.statistics import FEATURES, statistics
from tiersift.runtime import materialize

COSINES, WIDTH, RIDGE, SEED = 128, 5.0, 0.1, 7
PARTIALS = 32  # partial sums sent to the driver, each of (COSINES + 2)^2 numbers per fold
BINS = 1000


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores and calibrated values, both ascending
    values: np.ndarray

    def raw(self, x: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return fourier(x, self.mean, self.scale) @ (self.weights if weights is None else weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; a thousandth of the raw score keeps order inside flat steps."""
        raw = np.clip(self.raw(x), -1, 2)
        level = np.interp(raw, self.knots, self.values) if len(self.knots) else np.full(len(x), 0.5)
        return np.clip(0.999 * level + 0.001 * (raw + 1) / 3, 0, 1)


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A constant and cosines at random frequencies, whose products approximate a Gaussian kernel."""
    draw = np.random.default_rng(SEED)
    spread = WIDTH * np.sqrt(len(mean)) / 2
    frequencies = draw.standard_normal((len(mean), COSINES)) / spread
    phases = draw.uniform(0, 2 * np.pi, COSINES)
    z = np.clip((x - mean) / scale, -4, 4)
    return np.column_stack([np.ones(len(z)), np.sqrt(2 / COSINES) * np.cos(z @ frequencies + phases)])


def with_statistics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x`` for every row, written once; one pass over the texts."""

    def measure(batches):
        for batch in batches:
            x = statistics(batch)
            ends = np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))], ["doc_id", "x"])

    return materialize(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        measure, f"doc_id {documents.schema[id_col].dataType.simpleString()}, x array<double>"), "statistics")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, size: int, partial) -> dict[int, np.ndarray]:
    """Sums of ``partial(x, y)`` by fold: added up inside every partition, then over at most PARTIALS of them."""

    def work(batches):
        total = {}
        for batch in batches:
            x, fold = _matrix(batch), batch.column(batch.schema.get_field_index("fold")).to_numpy()
            y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            for f in np.unique(fold):
                part = partial(x[fold == f], y[fold == f])
                total[int(f)] = total.get(int(f), 0) + part
        for f, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([part.ravel().tolist()])], ["fold", "part"])

    found: dict[int, np.ndarray] = {}
    for fold, part in rows.coalesce(PARTIALS).mapInArrow(work, "fold int, part array<double>").collect():
        found[fold] = found.get(fold, np.zeros(size)) + np.array(part)
    return found


def _isotonic(bins: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ``bin, rows, positives``, ascending."""
    blocks: list[list[float]] = []  # sum of positions, rows, positives
    for at, n, good in bins:
        blocks.append([at * n, n, good])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top, strict=True)]
    knots = np.array([b[0] / b[1] for b in blocks])
    return -1 + 3 * knots / BINS, np.array([b[2] / b[1] for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, folds: int = 4) -> QualityModel:
    """Fit on ``labels`` (``doc_id, y, fold``; fold in 0..folds-1). Calibration uses scores by weights that have not seen the fold."""
    rows = materialize(stats.join(labels.filter("y IS NOT NULL"), "doc_id").select(
        "x", F.col("y").cast("double").alias("y"), F.col("fold").cast("int").alias("fold")), "labelled")
    width = len(FEATURES)
    moments = sum(_summed(rows, 2 * width + 2, lambda x, y: np.concatenate(
        [[len(x), y.sum()], x.sum(0), (x * x).sum(0)])).values(), np.zeros(2 * width + 2))
    n, good = moments[:2]
    mean = moments[2:2 + width] / max(n, 1)
    scale = np.sqrt(np.maximum(moments[2 + width:] / max(n, 1) - mean ** 2, 0)) + 1e-6
    if n == 0 or good in (0, n):
        level = good / n if n else 0.5
        return QualityModel(mean, scale, np.zeros(COSINES + 1), np.array([0.0]), np.array([level]))

    def normal(x, y):
        p = fourier(x, mean, scale)
        return np.concatenate([p.T @ p, (p.T @ y)[None]])

    size = COSINES + 1
    sums = {f: s.reshape(size + 1, size) for f, s in _summed(rows, (size + 1) * size, normal).items()}
    total = sum(sums.values())

    def solve(m):
        return np.linalg.solve(m[:-1] + RIDGE * np.eye(size), m[-1])

    blind = {f: solve(total - s) if len(sums) > 1 else solve(total) for f, s in sums.items()}

    def binned(batches):
        for batch in batches:
            x, fold = _matrix(batch), batch.column(batch.schema.get_field_index("fold")).to_numpy()
            p = fourier(x, mean, scale)
            raw = np.array([p[i] @ blind[int(f)] for i, f in enumerate(fold)])
            at = np.floor((np.clip(raw, -1, 2) + 1) / 3 * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), batch.column(batch.schema.get_field_index("y"))], ["at", "y"])

    bins = rows.mapInArrow(binned, "at int, y double").groupBy("at").agg(
        F.count("*").alias("n"), F.sum("y").alias("good")).orderBy("at").collect()  # at most BINS + 1 rows
    knots, values = _isotonic([tuple(r) for r in bins])
    return QualityModel(mean, scale, solve(total), knots, values)


def apply(stats: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` of every row of ``with_statistics``."""

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.score(_matrix(batch)) if len(batch) else [], pa.float64())], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(
        scored, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def remainder(column: str, parts: int):
    """crc32 of an id written as text, modulo ``parts``; -1 for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % parts, F.lit(-1))


def quality_scores(documents: DataFrame, labels: DataFrame, label_col: str = "quality", parts: int = 5,
                   held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; labels with the held-out remainder are not used."""
    learn = labels.select("doc_id", F.col(label_col).alias("y"), remainder("doc_id", parts).alias("r")).filter(
        F.col("doc_id").isNotNull() & (F.col("r") != held_out))
    fold = F.pmod(F.col("r") - held_out - 1, F.lit(parts)).cast("int")
    stats = with_statistics(documents)
    model = fit(stats, learn.select("doc_id", "y", fold.alias("fold")))
    scored = apply(stats, model)
    return scored.select("doc_id", (remainder("doc_id", parts) == held_out).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))

"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Vectors become whole numbers; the mean and the covariance are taken over each different vector once, in three passes of
partition sums: sums, products of centred values, and the covariance of the whitened values that tells the error left. Only numbers
of the size of the dimension reach the driver. The factor G of the covariance V = G G' comes from the Cholesky
factorisation with the largest pivot first, which stops at the rank; rotations of column pairs make its columns orthogonal.
Their squared norms are the eigenvalues of V, the normalised columns its eigenvectors, without V being diagonalised itself.

Edge cases: vectors that are null, empty or hold null or non-finite entries are dropped, as are those of another length than most vectors
have (ties: the longer); entries beyond the range of a long are set to its limits, a deviation beyond it is null; repeated vectors count once in
the fit and are returned each, null ids too; equal eigenvalues may give any basis of their space. There are as many components as the
covariance has rank, so none without two different vectors, and an empty result for an empty table. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersift.runtime import materialize

SCALE = 256
RANK_LIMIT = 1e-13  # a pivot below this part of the largest ends the factorisation
SWEEPS, ORTHOGONAL = 60, 1e-15
ROWS = 2048  # vectors multiplied at once


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of each dimension, exact
    values: np.ndarray  # falling eigenvalues
    vectors: np.ndarray  # one column a component
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ self.vectors / np.sqrt(self.values)


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """``g`` with ``v = g @ g.T``, as many columns as ``v`` has rank; rows keep their order."""
    rest, columns = v.astype(float).copy(), []
    first = np.diag(rest).max(initial=0.0)
    for _ in range(len(v)):
        at = int(np.argmax(np.diag(rest)))
        pivot = rest[at, at]
        if pivot <= first * RANK_LIMIT:
            break
        column = rest[:, at] / np.sqrt(pivot)
        columns.append(column)
        rest -= np.outer(column, column)
        rest[at, :] = rest[:, at] = 0.0
    return np.column_stack(columns) if columns else np.zeros((len(v), 0))


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of ``n`` columns in rounds of disjoint pairs."""
    seats = list(range(n + n % 2))
    rounds = []
    for _ in range(len(seats) - 1):
        pairs = [(a, b) for a, b in zip(seats[:len(seats) // 2], seats[::-1], strict=False) if max(a, b) < n]
        rounds.append((np.array([p[0] for p in pairs], dtype=int), np.array([p[1] for p in pairs], dtype=int)))
        seats = [seats[0], seats[-1], *seats[1:-1]]
    return rounds


def orthogonal_columns(g: np.ndarray) -> np.ndarray:
    """``g`` rotated from the right until all columns are orthogonal; its row space and ``g @ g.T`` stay."""
    g = g.copy()
    rounds = _rounds(g.shape[1]) if g.shape[1] > 1 else []
    for _ in range(SWEEPS):
        worst = 0.0
        for left, right in rounds:
            a, b = g[:, left], g[:, right]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            off = np.abs(gamma) / np.maximum(np.sqrt(alpha * beta), np.finfo(float).tiny)
            worst = max(worst, off.max(initial=0.0))
            turn = off > ORTHOGONAL
            zeta = (beta - alpha) / np.where(turn, 2 * gamma, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = np.where(turn, 1 / np.sqrt(1 + t * t), 1.0)
            s = np.where(turn, c * t, 0.0)
            g[:, left], g[:, right] = c * a - s * b, s * a + c * b
        if worst <= ORTHOGONAL:
            break
    return g


def components_of(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues above zero and their unit vectors as columns."""
    g = orthogonal_columns(pivoted_cholesky(covariance))
    norms = np.sqrt((g * g).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, g[:, order] / norms[order]


def whole_vectors(embeddings: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """``vec_id, x`` of the rows that remain, entries as whole numbers."""
    rows = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).filter(
        F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c.cast("double") * scale)).alias("x"))


def _matrix(batch: pa.RecordBatch, dimension: int):
    """Stretches of the vectors of a batch as rows of whole numbers."""
    column = batch.column(batch.schema.get_field_index("x"))
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    for at in range(0, len(flat), ROWS):
        yield flat[at:at + ROWS]


def _summed(vectors: DataFrame, dimension: int, shape: tuple[int, ...], of) -> np.ndarray:
    """Sum of ``of(rows)`` over all vectors: one array a task, added up place by place in a shuffle."""

    def partial(batches):
        total = None
        for batch in batches:
            for rows in _matrix(batch, dimension):
                part = of(rows)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int64()), pa.array(total.ravel())], ["at", "v"])

    found = vectors.select("x").mapInArrow(partial, "at long, v double").groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(int(np.prod(shape)))
    for at, v in found.collect():  # as many rows as the result has numbers, at most dimension squared
        out[at] = v
    return out.reshape(shape)


def fit(distinct: DataFrame, dimension: int, n: int) -> Whitening | None:
    """The transform over a table of different vectors ``x``; None without any."""
    if not n:
        return None
    sums = distinct.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(
        F.sum(F.col("c").cast("decimal(38,0)")).alias("s"))
    exact = {i: int(s) for i, s in sums.collect()}  # one row a dimension
    ordered = [exact[i] for i in range(dimension)]
    mean = np.array([s / n for s in ordered])

    def products(rows):
        y = rows - mean
        return y.T @ y

    covariance = _summed(distinct, dimension, (dimension, dimension), products) / n
    values, vectors = components_of(covariance)
    return Whitening(n, ordered, values, vectors, float(np.trace(covariance)))


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened vectors minus the identity."""
    k, dimension = len(model.values), len(model.sums)
    mean = _summed(distinct, dimension, (k,), lambda rows: model.apply(rows).sum(0)) / model.n

    def products(rows):
        w = model.apply(rows) - mean
        return w.T @ w

    covariance = _summed(distinct, dimension, (k, k), products) / model.n
    return float(np.abs(covariance - np.eye(k)).max(initial=0.0))


def whiten(embeddings: DataFrame, components: int = 4, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` of every remaining row and component."""
    kind = embeddings.schema[id_col].dataType.simpleString()
    schema = (f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    rows = materialize(whole_vectors(embeddings, vector_col, id_col), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], schema)
    dimension = lengths["d"]
    rows = rows.filter(F.size("x") == dimension)
    distinct = materialize(rows.select("x").distinct(), "distinct")
    model = fit(distinct, dimension, distinct.count())
    share = model.values / model.trace if model.trace else model.values
    model = Whitening(model.n, model.sums, model.values[:components], model.vectors[:, :components], model.trace)
    left, k = identity_error(distinct, model), len(model.values)
    exact_sums = np.array(model.sums, dtype=object)
    far = max(1, *(abs(s) for s in model.sums)) if model.sums else 1

    def deviation(x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2: in 64 bits where nothing can overflow, else in Python's whole numbers."""
        largest = model.n * int(max(abs(int(x.max())), abs(int(x.min())))) + far
        if largest * largest * dimension < 1 << 62:
            d = model.n * x - exact_sums.astype(np.int64)
            return (d * d).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in ((model.n * x.astype(object) - exact_sums) ** 2).sum(1)]

    def work(batches):
        for batch in batches:
            ids, at = batch.column(0), 0
            for x in _matrix(batch, dimension):
                w, m = model.apply(x), len(x)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(np.repeat(np.arange(at, at + m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                     pa.array(np.full(m * k, model.n), pa.int64()),
                     pa.array([d for d in deviation(x) for _ in range(k)], pa.int64()), pa.array(w.ravel()),
                     pa.array(np.tile(share[:k], m)), pa.array(np.full(m * k, left))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
                at += m

    return rows.mapInArrow(work, schema)

"""Toxicity scores: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Every text is a set of hashed features: its words, neighbouring words and words one apart. Each shard of the labelled rows is
learnt in sequence with one learning rate per coordinate and an L1 penalty that leaves most weights at zero;
the shards' weights are averaged over the shards that saw the coordinate. The result, at most 2^BITS weights, goes to every task.

Edge cases: null, empty and word-less texts have the constant feature only and score the intercept; labels that are null or
belong to no document are ignored; without labels every score is 0.5. Long texts are read whole, in chunks of whole texts; rows with one hash are learnt
in any order; repeated rows are scored each; an empty table gives an empty result. Nothing but the text enters a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersift.llm.quality_model import remainder
from tiersift.llm.words import PUNCTUATION, Words, lowered, mix, text_chunks

BITS = 20
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 10.0, 0.1, 5
ROWS_PER_SHARD, SHARDS = 24_000, 3  # at most their product of labelled rows is learnt from
MAX_LEARNT = ROWS_PER_SHARD * SHARDS


def hashed_features(batch: pa.RecordBatch, text: str = "text"):
    """Sorted distinct feature numbers of every text of a batch; 0 is the constant."""
    shift = np.uint64(64 - BITS)
    for _, _, data, offsets in text_chunks(batch, text):
        words = Words(lowered(data), offsets, PUNCTUATION)
        h = words.hashes()
        one = (mix(h) >> shift).astype(np.int64)
        two = (mix(h[:-1] * np.uint64(3) + h[1:]) >> shift).astype(np.int64)
        skip = (mix(h[:-2] * np.uint64(5) + h[2:]) >> shift).astype(np.int64)
        for low, high in zip(words.bounds[:-1], words.bounds[1:], strict=True):
            yield np.unique(np.concatenate([
                [0], one[low:high], two[low:max(high - 1, low)], skip[low:max(high - 2, low)]]))


@dataclass
class Ftrl:
    """State of one learner: ``z`` the adjusted gradient sums, ``n`` the squared ones."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def fresh(cls) -> Ftrl:
        return cls(np.zeros(1 << BITS), np.zeros(1 << BITS))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        penalty = np.where(at == 0, 0.0, L1)
        w = -(z - np.sign(z) * penalty) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= penalty, 0.0, w)

    def learn(self, at: np.ndarray, y: float) -> None:
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        grown = n + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(n)) / ALPHA * w
        self.n[at] = grown


def fit(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_LEARNT) -> np.ndarray:
    """Weights by feature number from ``labels`` (``doc_id, y``), at most ``max_rows`` of them, chosen by hash."""
    labels = labels.filter("doc_id IS NOT NULL AND y IS NOT NULL")
    total = labels.count()
    share = min(1.0, max_rows / max(total, 1))
    order = F.xxhash64("doc_id", F.lit(17))
    labels = labels.filter((F.shiftrightunsigned(order, 40) / float(1 << 24)) < share)
    shards = max(1, min(SHARDS, -(-int(total * share) // ROWS_PER_SHARD)))
    # at most about max_rows labels: sent to every task, so that only labelled texts are shuffled
    rows = documents.select("doc_id", "text").join(F.broadcast(labels), "doc_id").withColumn("order", order)
    shard = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(shards))
    dealt = rows.select("text", F.col("y").cast("double").alias("y"), "order", shard.cast("int").alias("shard"))
    dealt = dealt.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "order")

    def learn(batches):
        seen: dict[int, list] = {}  # feature lists only: bounded by ROWS_PER_SHARD texts
        for batch in batches:
            parts = zip(hashed_features(batch), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)
            for at, y, own in parts:
                seen.setdefault(own, []).append((at.astype(np.int32), y))
        for examples in seen.values():
            learner = Ftrl.fresh()
            for _ in range(EPOCHS):
                for at, y in examples:
                    learner.learn(at, y)
            at = np.flatnonzero(learner.n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(learner.weights(at))], ["at", "w"])

    found = dealt.mapInArrow(learn, "at long, w double").groupBy("at").agg(F.avg("w").alias("w")).filter("w <> 0")
    weights = np.zeros(1 << BITS)
    for at, w in found.collect():  # at most 2^BITS rows; L1 leaves a small part of them
        weights[at] = w
    return weights


def apply(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """``doc_id, score`` of every row."""
    at = np.flatnonzero(weights).astype(np.int32)
    compact = (at, weights[at])

    def score(batches):
        dense = np.zeros(1 << BITS)
        dense[compact[0]] = compact[1]
        for batch in batches:
            sums = np.array([dense[f].sum() for f in hashed_features(batch)], dtype=float)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))))], ["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")


def toxicity_scores(documents: DataFrame, labels: DataFrame, label_col: str = "toxic", parts: int = 4,
                    held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; labels with the held-out remainder are not used."""
    learn = labels.select("doc_id", F.col(label_col).alias("y")).filter(remainder("doc_id", parts) != held_out)
    scored = apply(documents, fit(documents, learn))
    return scored.select("doc_id", (remainder("doc_id", parts) == held_out).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))

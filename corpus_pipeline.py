"""From raw documents to packed sequences: quality, lines, near copies, benchmark leaks, packing.

Every stage takes what the one before kept, as written to shared storage, and all but the last return the columns
of ``documents``. A stage drops rows by their ids: rows repeated with one id share its fate, rows without an id are never dropped.

The order is given: lines go before near copies are sought, so an exact copy loses all its lines there and is dropped by that
stage, and near copies are compared by what their own lines leave. A text that had no line with a word before stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersift.llm import decontaminate, line_dedup, ngram_join, packing, quality_model
from tiersift.runtime import materialize

#: Learnt models and searches have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


#: So many ids at most are sent to all tasks (16 MB); more are joined by shuffle, with the same result.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    gone = materialize(ids.select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"] == gone["_gone"], "left_anti")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality_model.quality_scores(docs, labels)
    return _without(docs, scored.filter("predicted = 0"))


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that resemble an earlier line; ``n_chars`` follows the text. Texts that lose all words go."""
    kept = line_dedup.dedup_lines(docs)
    lost = (F.col("_n_kept") < F.col("_n_lines")) & ~F.col("text").rlike(line_dedup.WORD)
    kept = kept.filter(~F.coalesce(lost, F.lit(False)))
    return kept.select(*[F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias(c) if c == "n_chars" else c
                         for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies: five words, a similarity of 0.8."""
    return _without(docs, ngram_join.ngram_components(docs, width=5, threshold_percent=80).filter("doc_id <> component_id"))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _without(docs, decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", good_quality),
    ("lines", distinct_lines),
    ("near_copies", one_of_near_copies),
    ("leaks", without_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs

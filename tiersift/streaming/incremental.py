"""Process only messages without a stored rule result, as a batch or as a stream.

One rule for both: a stored result stays, and of copies that arrive together the one with the largest ``email_id`` decides.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiersift.operators import results, rules
from tiersift.sources.store import ResultStore

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _as_writes(classified: DataFrame) -> DataFrame:
    return classified.select("fingerprint", F.col("email_id").cast("string").alias("email_id"), "label",
                             F.col("confidence").cast("double").alias("confidence"), "source", F.to_json("context").alias("context"))


def triage_batch(emails: DataFrame, store: ResultStore, at: datetime | None = None,
                 batch: int | None = None, ruleset: rules.RuleSet | None = None) -> int:
    """Classify and store the messages the store does not know; returns how many rows were kept."""
    known = store.lookup(emails, without=batch)
    fresh = rules.classify(results.misses(emails, known), ruleset)
    chosen = results.latest(fresh, "email_id").withColumn("context", F.to_json("context"))
    return store.upsert(chosen.select("fingerprint", "label", "confidence", "source", "context"), at, batch)


def _winners(arriving: DataFrame, remember: timedelta, numbers: bool) -> DataFrame:
    """Keyed state: of every fingerprint the winning write of the first batch that brought it, and the first and last arrival.

    A write falls into two windows of twice ``remember``, so copies that come within ``remember`` of each other share one. State
    ends with its window.
    """
    length = remember // timedelta(milliseconds=1)
    order = F.col("email_id").cast("long") if numbers else F.col("email_id")
    write = F.struct((-F.unix_micros("arrived_at")).alias("age"), order.alias("order"), "label", "confidence", "source", "context")
    return arriving.groupBy("fingerprint", F.window("arrived_at", f"{2 * length} milliseconds", f"{length} milliseconds")).agg(
        F.max(write).alias("winner"), F.min("arrived_at").alias("first"), F.max("arrived_at").alias("last"))


def _new(touched: DataFrame) -> DataFrame:
    """Writes of the fingerprints that no window has seen in an earlier batch; all rows of a batch arrive at one moment."""
    return touched.groupBy("fingerprint").agg(
        F.max("winner").alias("winner"), F.bool_and(F.col("first") == F.col("last")).alias("is_new")).filter("is_new").select(
        "fingerprint", "winner.label", "winner.confidence", "winner.source", "winner.context")


def triage_stream(messages: DataFrame, store: ResultStore, checkpoint: str, remember: timedelta = timedelta(days=1),
                  ruleset: rules.RuleSet | None = None, trigger: dict | None = None):
    """Start a stream that stores a rule result per new fingerprint.

    Messages are classified where they arrive; only their results are shuffled by fingerprint. Keyed state holds the winner of every
    fingerprint for ``remember`` at least and drops what follows; later copies meet the stored result. Every micro-batch looks its
    keys up in the store, reading few parts of it, and writes under its own number of the stream's range, so a repeated
    one replaces itself, or does nothing if a snapshot has taken it in meanwhile.
    """
    spark = messages.sparkSession
    numbers = messages.schema["email_id"].dataType.typeName() in ("long", "integer", "short", "byte")
    # the watermark runs on arrival time, so no message is too late to be seen and state ends even when none of its key comes
    arriving = _as_writes(rules.classify(messages, ruleset)).filter("fingerprint IS NOT NULL").withColumn(
        "arrived_at", F.current_timestamp()).withWatermark("arrived_at", "0 seconds")
    winners = _winners(arriving, remember, numbers)
    first = store.stream_range(checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        if store.holds(first + number):
            return
        batch = _new(batch).persist()  # read by the lookup and by the write
        new = results.misses(batch, store.lookup(batch, without=first + number))
        store.upsert(new, batch=first + number)
        batch.unpersist()

    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return (winners.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)

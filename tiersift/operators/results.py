"""Views over stored classifications. The store keeps one row per fingerprint, last write wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersift.functions.fields import text

REQUIRED = ("fingerprint", "label", "confidence", "source")


def valid(writes: DataFrame) -> DataFrame:
    """Rows a store accepts: every required field present."""
    return writes.dropna(subset=list(REQUIRED))


def latest(writes: DataFrame, order: str, key: str = "fingerprint") -> DataFrame:
    """Last write per key. Partial aggregation absorbs a key that owns most of the log."""
    kept = [c for c in writes.columns if c not in (key, order)]
    picked = writes.groupBy(key).agg(F.max_by(F.struct(*kept), F.col(order)).alias("row"))
    return picked.select(key, "row.*")


def metadata(emails: DataFrame, order: str = "email_id") -> DataFrame:
    """Message facts kept next to the classifications, one row per fingerprint."""
    rows = emails.select(text("fingerprint").alias("fingerprint"), text("file_path").alias("file_path"),
                         text("subject").alias("subject"), text("sender_domain").alias("sender_domain"),
                         F.col(order).alias("write_order"))
    return latest(rows, "write_order")


def hits(emails: DataFrame, store: DataFrame, source: str = "rules") -> DataFrame:
    """E-mails whose stored result may be reused, with that result."""
    usable = store.filter(F.col("source") == source).select(
        "fingerprint", "label", "confidence", "source", "context")
    return emails.select("email_id", "fingerprint").join(usable, "fingerprint")


def misses(emails: DataFrame, store: DataFrame, source: str = "rules") -> DataFrame:
    """E-mails that still need work. Store keys are unique; copies sit on the e-mail side only,
    which adaptive skew handling may split for an anti join."""
    usable = store.filter(F.col("source") == source).select("fingerprint")
    return emails.join(usable, "fingerprint", "left_anti")


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("created_at").desc(), "fingerprint")


def by_source(store: DataFrame, source: str) -> DataFrame:
    return newest_first(store.filter(F.col("source") == source))


def by_label(store: DataFrame, label: str) -> DataFrame:
    return newest_first(store.filter(F.col("label") == label))


def cutoff(as_of, **interval: int) -> Column:
    """The moment that lies an interval before ``as_of``."""
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return moment - F.make_interval(**{k: F.lit(v) for k, v in interval.items()})


def recent(store: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return newest_first(store.filter(F.col("created_at") >= cutoff(as_of, hours=hours)))


def unexpired(store: DataFrame, as_of, days: int = 30) -> DataFrame:
    return store.filter(F.col("created_at") >= cutoff(as_of, days=days))


def expired(store: DataFrame, as_of, days: int = 30) -> DataFrame:
    return store.filter(F.col("created_at") < cutoff(as_of, days=days))


def stats(store: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """``section, key, n``: total, per source, per label and recent counts in one pass."""
    grouped = store.groupingSets([["source"], ["label"], []], "source", "label").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("created_at") >= cutoff(as_of, hours=hours)).alias("fresh"),
        F.grouping_id().alias("level"))

    def entry(section, key, n):
        return F.struct(F.lit(section).alias("section"), key.alias("key"), n.alias("n"))

    return grouped.select(F.inline(
        F.when(F.col("level") == 1, F.array(entry("by_source", F.col("source"), F.col("n"))))
        .when(F.col("level") == 2, F.array(entry("by_label", F.col("label"), F.col("n"))))
        .otherwise(F.array(entry("total", F.lit("classifications"), F.col("n")),
                           entry("total", F.lit("recent"), F.col("fresh"))))))


def training_rows(store: DataFrame, facts: DataFrame, min_confidence: float = 0.7) -> DataFrame:
    """Confident stored rows with the message facts known for them (empty when unknown)."""
    facts = facts.select("fingerprint", "subject", "sender_domain")
    confident = store.filter(F.col("confidence") >= min_confidence)
    return confident.join(facts, "fingerprint", "left").select(
        "fingerprint", "label", "confidence", "source",
        text("subject").alias("subject"), text("sender_domain").alias("sender_domain"))


def export(store: DataFrame, source: str | None = None) -> DataFrame:
    """Rows to write as JSON lines, newest first, an absent context as ``{}``."""
    chosen = store if source is None else store.filter(F.col("source") == source)
    return newest_first(chosen.withColumn("context", F.coalesce("context", F.lit("{}"))))

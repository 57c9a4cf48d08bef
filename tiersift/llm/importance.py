"""Target-distribution importance resampling: hashed word features, array-scored weights, exact ranks by regular sampling.

Features are runs of one to ``longest`` words; the gain of a bucket compares how often the target texts and the documents fall into it.
Both counts are summed inside every task before they are shuffled, and the gains, one number a bucket, go to every task.
A document's score is the sum of its gains plus Gumbel noise from a hash of its id, so taking the highest scores draws without
replacement in proportion to the weights. Ranks come from a parallel sort by regular sampling: every partition is a sorted run,
rows at equal distances in the runs become the splitters, rows go to the segment between their two splitters, a segment is
merged by one task, and the counts of the segments before it give its first rank. Segments behind the last drawn rank are not exchanged.

Edge cases: null and word-less texts have no feature, weight 0, and are not drawn while ``least_words`` is above 0; a null id is hashed as
the empty text and comes last among ties; rows repeated with one id are rows of their own, their ties broken by place in the
table; long texts are scored whole, in chunks of whole texts; an empty table gives an empty result, an empty target only
negative or zero gains. Other columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersift.llm.words import LOWER, Words, shingle_hashes, text_chunks
from tiersift.runtime import materialize

BUCKETS = 10_000
ROWS_PER_SEGMENT, MAX_SEGMENTS = 1 << 18, 1 << 14
SAMPLES = 32  # splitter candidates a segment: at most SAMPLES * MAX_SEGMENTS and one a run reach the driver
GAP = np.ones(256, dtype=bool)  # what separates words: all ASCII but digits and small letters
GAP[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def features(batch: pa.RecordBatch, longest: int = 1, buckets: int = BUCKETS):
    """``first row, words of each text, text of each feature, bucket of each feature`` for stretches of a batch."""
    for first, last, data, offsets in text_chunks(batch, "text"):
        low = LOWER[data]
        words = Words(low, offsets, GAP)
        own, raw = words.hashes(), low.tobytes()
        n_words = np.diff(words.bounds)
        text = np.repeat(np.arange(last - first), n_words)
        texts, found = [], []
        for width in range(1, longest + 1):
            runs = own if width == 1 else shingle_hashes(own, width)
            inside = text[:len(runs)] == text[width - 1:] if len(runs) else np.zeros(0, dtype=bool)
            at = np.flatnonzero(inside)
            codes, kinds = pd.factorize(runs[at])
            some = np.zeros(len(kinds), dtype=np.int64)
            some[codes] = at  # any place of each different run
            crc = [zlib.crc32(b" ".join(raw[words.starts[i + k]:words.ends[i + k]] for k in range(width))) for i in some.tolist()]
            texts.append(text[at])
            found.append((np.array(crc, dtype=np.int64) % buckets)[codes])
        yield first, n_words, np.concatenate(texts), np.concatenate(found)


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in every bucket."""

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, _, found in features(batch, longest, buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["bucket", "n"])

    summed = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, dtype=np.int64)
    for bucket, n in summed.collect():  # one row a bucket
        counts[bucket] = n
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio) of every bucket."""
    buckets, s, t = len(raw), float(raw.sum()), float(target.sum())
    ratio = ((target + 1.0) * (s + buckets)) / ((raw + 1.0) * (t + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], dtype=np.int64)


def weigh(documents: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""

    def work(batches):
        for batch in batches:
            n, n_words, n_features, weight = batch.num_rows, [], [], []
            for _, words, text, found in features(batch, longest, len(gain)):
                sums = np.concatenate([[0], np.cumsum(gain[found[order := np.argsort(text, kind="stable")]])])
                ends = np.searchsorted(text[order], np.arange(len(words) + 1))
                n_words.append(words)
                n_features.append(np.diff(ends))
                weight.append(np.diff(sums[ends]))
            if n:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (n_words, n_features, weight))],
                    ["doc_id", "n_words", "n_features", "weight"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        work, "doc_id long, n_words long, n_features long, weight long")


def noise(seed: int, doc_id: Column) -> Column:
    """floor(1000 * Gumbel noise) from a hash of the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What rows are ordered by, ascending: falling score, rising id (null last), place in the table."""
    column = {n: batch.column(batch.schema.get_field_index(n)) for n in ("score", "doc_id", "row")}
    ids = column["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    return -column["score"].to_numpy(zero_copy_only=False), ids, column["row"].to_numpy(zero_copy_only=False)


def _splitters(runs: DataFrame, n: int, segments: int) -> list[np.ndarray]:
    """Keys that cut the order into ``segments`` of about equal size, from rows at equal distances in the sorted runs."""
    step = max(1, n // (segments * SAMPLES))

    def pick(batches):
        seen = 0
        for batch in batches:
            at = np.arange((step // 2 - seen) % step, batch.num_rows, step)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(k[at]) for k in _keys(batch)], ["a", "b", "c"])

    found = runs.select("score", "doc_id", "row").mapInArrow(pick, "a long, b long, c long").toArrow()
    keys = [found.column(c).to_numpy() for c in ("a", "b", "c")]
    order = np.lexsort(keys[::-1])
    cut = order[(np.arange(1, segments) * len(order)) // segments] if len(order) else order
    return [k[np.unique(cut)] if len(order) < segments else k[cut] for k in keys]


def ranked(rows: DataFrame, eligible: Column, draw: float) -> DataFrame:
    """Adds ``rank``: 1, 2, ... by falling ``score`` and rising ``doc_id`` for the highest floor(draw * eligible rows), else null."""
    columns = rows.columns
    numbered = rows.withColumns({"row": F.monotonically_increasing_id(), "able": eligible})
    runs = materialize(numbered.sortWithinPartitions(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row"), "runs")
    able = runs.filter("able")
    n = able.count()
    wanted = math.floor(draw * n + 1e-9)
    if not wanted:
        return runs.select(*columns, F.lit(None).cast("long").alias("rank"))
    at_least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = min(MAX_SEGMENTS, max(at_least, -(-n // ROWS_PER_SEGMENT)))
    splitters = _splitters(able, n, segments)

    def place(batches):
        for batch in batches:
            both = [np.concatenate([s, k]) for s, k in zip(splitters, _keys(batch), strict=True)]
            order, cuts = np.lexsort(both[::-1]), len(splitters[0])
            segment = np.empty(len(order), dtype=np.int64)
            segment[order] = np.cumsum(order < cuts)  # splitters up to a row, itself one of them or not
            yield batch.append_column("segment", pa.array(segment[cuts:].astype(np.int32)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in able.schema) + ", segment int"
    placed = able.mapInArrow(place, schema)
    sizes = dict(placed.groupBy("segment").count().collect())  # at most ``segments`` rows
    before, first = {}, 0
    for segment in sorted(sizes):
        before[segment] = first
        first += sizes[segment]
    last = max(s for s, f in before.items() if f < wanted)
    offsets = rows.sparkSession.createDataFrame(list(before.items()), "segment int, before long")
    inside = Window.partitionBy("segment").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    taken = placed.filter(F.col("segment") <= last).withColumn("place", F.row_number().over(inside)).join(
        F.broadcast(offsets), "segment")  # at most MAX_SEGMENTS rows
    rank = F.col("before") + F.col("place")
    drawn = taken.select(*columns, F.when(rank <= wanted, rank).cast("long").alias("rank"))
    rest = placed.filter(F.col("segment") > last).select(*columns).unionByName(runs.filter("NOT able").select(*columns))
    return drawn.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def resample(documents: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = BUCKETS,
             least_words: int = 20, seed: int = 2024) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row; ``rank`` is null for what is not drawn."""
    gain = gains(bucket_counts(documents, longest, buckets), bucket_counts(target, longest, buckets))
    scored = weigh(documents, gain, longest).withColumn("score", F.col("weight") + noise(seed, F.col("doc_id")))
    return ranked(scored, F.col("n_words") >= least_words, percent / 100)

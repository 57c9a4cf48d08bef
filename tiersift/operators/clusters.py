"""Clusters of messages: k-means, centres, representatives, summaries.

Shapes: vectors ``(email_id, embedding)`` with an array or an ML vector, assignments ``(email_id, cluster_id)`` with -1 for noise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType

from tiersift.functions.fields import embedding_text_plain
from tiersift.operators.text_vectors import Vocabulary, with_terms
from tiersift.runtime import join_cluster_side, materialize, packed, spread

NOISE = -1
TEXT_DIMENSIONS = 500  # bounds the one place where text vectors become plain arrays


def _as_vector(df: DataFrame) -> Column:
    is_array = isinstance(df.schema["embedding"].dataType, ArrayType)
    return array_to_vector(F.col("embedding").cast("array<double>")) if is_array else F.col("embedding")


def as_arrays(df: DataFrame) -> DataFrame:
    """``embedding`` as a plain array of doubles."""
    is_array = isinstance(df.schema["embedding"].dataType, ArrayType)
    return df.withColumn("embedding", F.col("embedding").cast("array<double>") if is_array
                         else vector_to_array("embedding"))


def _halves(n, text_clusters: bool):
    tenth = F.greatest(F.lit(2), F.floor(n / 10))
    if text_clusters:
        return F.least(tenth, F.lit(100))
    return F.least(F.least(F.lit(20), F.floor(n / 2)), F.greatest(tenth, F.floor(n / 5)))


def cluster_counts(rows: DataFrame) -> DataFrame:
    """How many clusters to ask for: ``n, k_text, k_embedding`` (one cluster below two rows)."""
    counted = rows.agg(F.count("*").alias("n"))
    n = F.col("n")
    return counted.select("n", *[
        F.when(n < 2, n).otherwise(_halves(n, is_text)).cast("long").alias(name)
        for name, is_text in (("k_text", True), ("k_embedding", False))])


def text_embedding(emails: DataFrame, dimensions: int = TEXT_DIMENSIONS,
                   stop_words: list[str] | None = None) -> DataFrame:
    """Default embedder: sparse unit TF-IDF vectors over subject, snippet and sender domain."""
    docs = with_terms(emails, embedding_text_plain(), stop_words)
    vectors = Vocabulary.fit(docs, dimensions, n_docs=emails.count()).stages("vector").transform(docs)
    return vectors.select("email_id", F.col("vector").alias("embedding"))


def embed(emails: DataFrame, fn, text_column: Column, dimensions_type: str = "array<double>") -> DataFrame:
    """Any embedder: ``fn()`` builds the model once per task and returns ``texts -> vectors``."""
    def run(batches):
        model = fn()
        for pdf in batches:
            yield pdf[["email_id"]].assign(embedding=[list(v) for v in model(list(pdf["txt"]))])

    rows = emails.select("email_id", text_column.alias("txt"))
    key = rows.schema["email_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"email_id {key}, embedding {dimensions_type}")


#: Vectors that starting centres are drawn from, by hash order.
SEED_SAMPLE = 5000
_SLICE = 512  # vectors compared with all centres at once
_FEW = 8  # tasks whose sums the driver adds up


def _entries_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of entries of each unwrapped vector of a batch, their places and values."""
    column = batch.column(batch.schema.get_field_index("features"))
    kind, _, indices, values = column.flatten()  # children of a slice, unlike those of ``field``
    length = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), length)
    place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)  # of an entry in its vector
    sparse = (kind.to_numpy(zero_copy_only=False) == 0)[row]
    place[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
    return length, place, values.flatten().to_numpy(zero_copy_only=False)


def _rows_of(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """Dense rows of a batch of unwrapped vectors."""
    length, place, values = _entries_of(batch)
    out = np.zeros((len(length), size))
    out[np.repeat(np.arange(len(length)), length), place] = values
    return out


def _blocks(rows: DataFrame) -> DataFrame:
    """``ids, lengths, places, entries``: a row for up to ``_SLICE`` vectors, as arrays of their entries; zeros of dense ones as well.

    Every pass then reads a few large values instead of a struct of arrays a vector, and compares few rows at a time.
    """
    def work(batches):
        for batch in batches:
            for low in range(0, len(batch), _SLICE):
                part = batch.slice(low, _SLICE)
                length, place, entries = _entries_of(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_pylist()], ids), *[pa.array([x.tobytes()], pa.binary()) for x in (
                        length.astype(np.int32), place.astype(np.int32), entries.astype(np.float64))]],
                    ["ids", "lengths", "places", "entries"])

    kind = rows.schema["email_id"].dataType
    ids = pa.list_(to_arrow_type(kind))
    return rows.select("email_id", "features").mapInArrow(
        work, f"ids array<{kind.simpleString()}>, lengths binary, places binary, entries binary")


def _unpacked(batch: pa.RecordBatch, size: int):
    """Dense rows of every block in a batch of ``lengths, places, entries``."""
    return (out for out, *_ in _unpacked_entries(batch, size))


def _unpacked_entries(batch: pa.RecordBatch, size: int):
    """Dense rows of every block in a batch, and the row, place and value of its entries."""
    columns = [batch.column(batch.schema.get_field_index(c)) for c in ("lengths", "places", "entries")]
    for length, place, entries in zip(*columns, strict=True):
        length = np.frombuffer(length.as_py(), dtype=np.int32)
        out = np.zeros((len(length), size))
        row, place, entries = np.repeat(np.arange(len(length)), length), np.frombuffer(place.as_py(), dtype=np.int32), np.frombuffer(entries.as_py())
        out[row, place] = entries
        yield out, row, place, entries


def _starts(sample: np.ndarray, k: int, n_init: int, seed: int) -> np.ndarray:
    """``n_init`` sets of ``k`` centres, each next one drawn in proportion to the squared distance to those before."""
    out = np.empty((n_init, k, sample.shape[1]))
    length = (sample * sample).sum(1)
    for start in range(n_init):
        draw = np.random.default_rng(seed + start)
        far = np.full(len(sample), np.inf)
        at = int(draw.integers(len(sample)))
        for j in range(k):
            out[start, j] = sample[at]
            far = np.minimum(far, np.maximum(length - 2 * sample @ sample[at] + length[at], 0))
            total = far.sum()
            at = int(draw.choice(len(sample), p=far / total)) if total > 0 else int(draw.integers(len(sample)))
    return out


def _pass(blocks: DataFrame, centers: np.ndarray, running: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums, counts and costs of the nearest rows of every centre, for all running starts in one pass.

    Tasks send the sums of the centres they touched; those are added up by centre before the driver gets one row each.
    """
    k, size = centers.shape[1:]
    flat = centers[running].reshape(-1, size)
    length = (flat * flat).sum(1)

    def partial(batches):
        sums, counts, cost = np.zeros(flat.shape), np.zeros(len(flat), dtype=np.int64), np.zeros(len(flat))
        for x, row, place, entries in (b for batch in batches for b in _unpacked_entries(batch, size)):
            far = (length - 2 * x @ flat.T).reshape(len(x), -1, k)
            best = far.argmin(2)
            near = np.take_along_axis(far, best[:, :, None], 2)[:, :, 0] + (x * x).sum(1)[:, None]
            for start in range(best.shape[1]):
                own = best[:, start] + start * k
                sums[start * k:(start + 1) * k] += np.bincount(  # few entries of a text vector are not zero
                    best[row, start] * size + place, weights=entries, minlength=k * size).reshape(k, size)
                counts += np.bincount(own, minlength=len(flat))
                cost += np.bincount(own, weights=near[:, start], minlength=len(flat))
        yield from _packed_sums(sums, counts, cost)

    def added(batches):
        sums, counts, cost = np.zeros(flat.shape), np.zeros(len(flat), dtype=np.int64), np.zeros(len(flat))
        for batch in batches:
            at = batch.column(0).to_numpy()
            np.add.at(counts, at, batch.column(1).to_numpy())
            np.add.at(cost, at, batch.column(2).to_numpy())
            for place, raw in zip(at, batch.column(3).to_pylist(), strict=True):
                sums[place] += np.frombuffer(raw)
        yield from _packed_sums(sums, counts, cost)

    schema = "at long, n long, cost double, sums binary"
    parts = blocks.mapInArrow(partial, schema)
    if blocks.rdd.getNumPartitions() > _FEW:
        parts = parts.repartition(_FEW, "at").mapInArrow(added, schema)
    total = next(added(parts.toArrow().to_batches()))  # a row a centre, of _FEW tasks at most
    sums, counts, cost = np.zeros(flat.shape), np.zeros(len(flat), dtype=np.int64), np.zeros(len(flat))
    at = total.column(0).to_numpy()
    counts[at], cost[at] = total.column(1).to_numpy(), total.column(2).to_numpy()
    for place, raw in zip(at, total.column(3).to_pylist(), strict=True):
        sums[place] = np.frombuffer(raw)
    shape = (int(running.sum()), k)
    return sums.reshape(*shape, size), counts.reshape(shape), cost.reshape(shape).sum(1)


def _packed_sums(sums: np.ndarray, counts: np.ndarray, cost: np.ndarray):
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at]), pa.array(cost[at]),
                                      pa.array([sums[i].tobytes() for i in at], pa.binary())], ["at", "n", "cost", "sums"])


def kmeans(vectors: DataFrame, k: int | None = None, seed: int = 42, n_init: int = 10,
           max_iter: int = 300, text_clusters: bool = False, tol: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Assignments and centres ``(cluster_id, center)`` of the cheapest of ``n_init`` runs.

    All runs move their centres in one pass over the rows each round; a run whose centres move by less than ``tol`` of the
    variance is done and takes no part in later passes. A centre without rows stays where it is.
    """
    spark = vectors.sparkSession
    if k is None:
        k = cluster_counts(vectors).first()["k_text" if text_clusters else "k_embedding"]
    if k < 2:
        single = vectors.select("email_id", F.lit(0).alias("cluster_id"))
        return single, centroids(vectors, single)
    # every iteration is a pass over these rows: even partitions of a useful size, cached
    rows = packed(materialize(vectors.select("email_id", F.unwrap_udt(_as_vector(vectors)).alias("features"))
                              .hint("rebalance"), "features"), 8 << 20)
    blocks = _blocks(spread(rows)).persist()
    n = blocks.agg(F.sum(F.size("ids"))).first()[0]
    first = rows.select("features").first()["features"]
    size = first["size"] if first["type"] == 0 else len(first["values"])
    share = min(1.0, 2 * SEED_SAMPLE / n)
    chosen = rows.filter(F.pmod(F.xxhash64("email_id", F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * share)).limit(SEED_SAMPLE)
    sample = np.concatenate([_rows_of(b, size) for b in chosen.select("features").toArrow().to_batches()])
    centers = _starts(sample, k, n_init, seed)
    entries = blocks.drop("ids")
    limit = tol * float(sample.var(0).mean())
    running, costs = np.ones(n_init, dtype=bool), np.full(n_init, np.inf)
    for _ in range(max_iter):
        sums, counts, cost = _pass(entries, centers, running)
        costs[running] = cost
        old = centers[running]
        new = np.where(counts[:, :, None] > 0, sums / np.maximum(counts, 1)[:, :, None], old)
        centers[running] = new
        running[running] = ((new - old) ** 2).sum((1, 2)) > limit
        if not running.any():
            break
    every = np.ones(n_init, dtype=bool)
    costs = _pass(entries, centers, every)[2]
    best = centers[int(costs.argmin())]
    length = (best * best).sum(1)

    def nearest(batches):
        for batch in batches:
            near = [(length - 2 * x @ best.T).argmin(1) for x in _unpacked(batch, size)]
            if near:
                yield pa.RecordBatch.from_arrays([batch.column(0).flatten(), pa.array(np.concatenate(near), pa.int32())],
                                                 ["email_id", "cluster_id"])

    kind = rows.schema["email_id"].dataType.simpleString()
    assigned = materialize(blocks.mapInArrow(nearest, f"email_id {kind}, cluster_id int"), "kmeans")
    blocks.unpersist()
    placed = [(i, c.tolist()) for i, c in enumerate(best)]
    return assigned, spark.createDataFrame(placed, "cluster_id int, center array<double>")


def members(assignments: DataFrame) -> DataFrame:
    return assignments.filter(F.col("cluster_id") != NOISE)


def sizes(assignments: DataFrame) -> DataFrame:
    return members(assignments).groupBy("cluster_id").agg(F.count("*").alias("size"))


def centroids(vectors: DataFrame, assignments: DataFrame) -> DataFrame:
    """Mean vector per cluster, map-side combined."""
    rows = vectors.join(members(assignments), "email_id")
    mean = Summarizer.mean(_as_vector(rows))
    return rows.groupBy("cluster_id").agg(vector_to_array(mean).alias("center"))


def distance(a: str, b: str) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, s: total + s))


def representatives(vectors: DataFrame, assignments: DataFrame,
                    centers: DataFrame | None = None) -> DataFrame:
    """The member nearest to its cluster's centre, the smallest id on ties.

    The argmin is a partial aggregate, so a cluster with a third of all rows is reduced on the map
    side; only the centre join could gather it and that is salted.
    """
    rows = as_arrays(vectors).join(members(assignments), "email_id")
    centers = centers if centers is not None else centroids(vectors, assignments)
    measured = join_cluster_side(rows, centers, "cluster_id", "email_id").select(
        "cluster_id", "email_id", distance("embedding", "center").alias("distance"))
    return measured.groupBy("cluster_id").agg(
        F.min_by("email_id", F.struct("distance", "email_id")).alias("rep_email_id"))


def representative_emails(emails: DataFrame, reps: DataFrame) -> DataFrame:
    return emails.join(reps.withColumnRenamed("rep_email_id", "email_id"), "email_id")


def preview(assignments: DataFrame, first: int = 10) -> DataFrame:
    """The ``first`` smallest member ids per cluster; partitions keep at most that many before
    the shuffle."""
    w = Window.partitionBy("cluster_id").orderBy("email_id")
    ranked = members(assignments).withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= first)
    return ranked.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list("email_id")).alias("member_preview"))


def summary(emails: DataFrame, assignments: DataFrame, reps: DataFrame) -> DataFrame:
    facts = emails.select(F.col("email_id").alias("rep_email_id"),
                          F.col("fingerprint").alias("representative_fingerprint"),
                          F.col("subject").alias("representative_subject"),
                          F.col("from_hdr").alias("representative_from"))
    return (sizes(assignments).join(reps, "cluster_id").join(facts, "rep_email_id", "left")
            .join(preview(assignments), "cluster_id")
            .withColumnRenamed("rep_email_id", "representative_id"))


def totals(assignments: DataFrame) -> DataFrame:
    """``emails, clusters, average_size, reduction_percent``: what one call per cluster saves."""
    per_cluster = sizes(assignments).agg(F.sum("size").alias("emails"), F.count("*").alias("clusters"))
    return per_cluster.select(
        "emails", "clusters", (F.col("emails") / F.col("clusters")).alias("average_size"),
        ((1 - F.col("clusters") / F.col("emails")) * 100).alias("reduction_percent"))


def largest(emails: DataFrame, assignments: DataFrame, reps: DataFrame, top: int = 5) -> DataFrame:
    """The largest clusters; ties go to the cluster whose first member comes first."""
    chosen = (members(assignments).groupBy("cluster_id")
              .agg(F.count("*").alias("size"), F.min("email_id").alias("first_id"))
              .orderBy(F.col("size").desc(), "first_id").limit(top))
    facts = emails.select(F.col("email_id").alias("rep_email_id"), "subject", "from_hdr")
    named = chosen.join(reps, "cluster_id").join(facts, "rep_email_id", "left")
    return named.select(
        "cluster_id", "size",
        F.substring(F.coalesce("subject", F.lit("No subject")), 1, 60).alias("subject"),
        F.substring(F.coalesce("from_hdr", F.lit("Unknown")), 1, 60).alias("from_hdr"))


def export_document(summaries: DataFrame) -> DataFrame:
    """One JSON text per cluster, ready for a text or JSON sink."""
    return summaries.select("cluster_id", F.to_json(F.struct(
        *[c for c in summaries.columns if c != "cluster_id"])).alias("document"))


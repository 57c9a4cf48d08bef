"""Exact n-gram Jaccard self-join with vertical partitioning.

One global order of the n-grams (those frequent in many texts last, otherwise by hash) serves two
ends. The first n-grams of a set in that order find candidates: two sets with Jaccard >= t share one of
them. And the order is cut into fragments; the common n-grams of a candidate pair are counted per
fragment, each count separately, and summed per pair.

Edge cases: null and word-less texts have an empty set and link with nothing; a text with fewer than
``width`` words is one n-gram; copies share one set and one group; a null id is returned with a null
component; rows repeated with one id give as many result rows; long texts are read whole; of equal ids the least names a
component, so there are no ties; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersift.llm.linking import link_blocks, odd_cells_apart
from tiersift.llm.words import LOWER, Words, lists, sequence_hash, shingle_hashes, text_chunks
from tiersift.runtime import join_per_key, materialize, release

FRAGMENTS = 8
FREQUENT_LIMIT = 200_000  # n-grams whose frequency is told to every task; others are ordered by hash
CELL_BITS = 9
CELLS = 1 << CELL_BITS
FIRST = 4  # leading n-grams by which a pair that shares many blocks is told from one that was met in an earlier block
_BROADCAST_IDS = 1_000_000  # ids of candidates sent to all tasks (16 MB); beyond it they are joined by shuffle


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row number, word hashes and ascending distinct n-gram hashes of every text of a batch."""
    for first, last, data, offsets in text_chunks(batch, "text"):
        words = Words(LOWER[data], offsets)
        hashes = words.hashes()
        for i in range(last - first):
            own = hashes[words.bounds[i]:words.bounds[i + 1]]
            grams = np.unique(shingle_hashes(own, min(width, len(own)))) if len(own) else own
            yield first + i, own, grams


def _needed(n: int, t: int) -> int:
    return -(-t * n // 100)


def _prefix(grams: np.ndarray, frequent: np.ndarray, t: int) -> np.ndarray:
    """The first n-grams of a set in the global order, one of which every similar set shares."""
    n = len(grams)
    size = n - _needed(n, t) + 1 if n else 0
    if not len(frequent):
        return grams[:size]
    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    late = frequent[at] == grams
    rare = grams[~late][:size]
    return np.concatenate([rare, grams[late][:size - len(rare)]]) if len(rare) < size else rare


def parities(grams: np.ndarray) -> np.ndarray:
    """For each of ``CELLS`` cells of the hash range, whether an odd number of the n-grams falls into it, as bits of longs.

    Every n-gram that only one of two sets has turns one bit, so the sets differ in at least as many n-grams as their bits.
    """
    odd = np.bincount((grams >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _close(t: int):
    """Necessary for a similarity of ``t`` percent: no more differing bits than n-grams may differ."""

    def condition(x, y):
        return odd_cells_apart(x, y, CELLS // 64).cast("long") * (100 + t) <= (x["n"] + y["n"]).cast("long") * (100 - t)

    return condition


def _met_before(x, y) -> Column:
    """Two sets share one of their first ``FIRST`` n-grams before this one, so the block of that n-gram holds the pair as well.

    It stands earlier in both sets, so ``possible`` is no stricter there.
    """
    before = [F.slice(s["first"], F.lit(1), F.least(s["pos"], F.lit(FIRST))) for s in (x, y)]
    return F.arrays_overlap(*before)


def _frequent(documents: DataFrame, width: int, limit: int) -> np.ndarray:
    """Up to ``limit`` n-grams that many different texts have; which ones only decides speed, never results.

    Counts are summed inside every partition, and only those that stand out there are summed over all.
    """

    def counted(batches):
        found, size, seen = [], 0, set()

        def flush():
            grams, n = np.unique(np.concatenate(found), return_counts=True)
            kept = n >= 3
            return pa.RecordBatch.from_arrays(
                [pa.array(grams[kept].view(np.int64)), pa.array(n[kept].astype(np.int64))], ["gram", "n"])

        for batch in batches:
            for _, own, grams in _sets(batch, width):
                key = sequence_hash(own)
                if len(grams) == 0 or key in seen:
                    continue
                seen.add(key)
                found.append(grams)
                size += len(grams)
                if size > 4_000_000:
                    yield flush()
                    found, size = [], 0
        if found:
            yield flush()

    rows = documents.select("text").mapInArrow(counted, "gram long, n long").groupBy("gram").agg(
        F.sum("n").alias("n")).filter("n >= 24").orderBy(F.desc("n"), "gram").limit(limit).select("gram")
    return np.sort(np.array([r[0] for r in rows.collect()], dtype=np.int64).view(np.uint64))


def _promising(pairs: DataFrame, sets: DataFrame, facts: DataFrame, t: int) -> DataFrame:
    """Pairs ``a, b, na, nb`` whose leading n-grams have enough in common.

    Of two sets, the one whose lead ends first in the global order has all common n-grams up to there in both
    leads, and can share at most what it has after its lead. ``facts`` bounds the common part of two leads by the n-grams of
    each that any other lead has; the leads themselves settle what is left. They travel as 32-bit hashes; common n-grams of
    one hash count once there, so the hashes that a lead has less than n-grams are added to what is common.
    """
    for side in ("a", "b"):
        pairs = pairs.join(facts.withColumnsRenamed(
            {"node": side, "n": f"n{side}", "after": f"after_{side}", "shared": f"shared_{side}"}), side)

    def enough(common):
        most = common + F.greatest("after_a", "after_b")
        return most * (100 + t) >= (F.col("na") + F.col("nb")) * t

    pairs = materialize(pairs.filter(enough(F.least("shared_a", "shared_b"))).drop("shared_a", "shared_b"), "able")
    ids = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "met")
    leads = sets.filter("size(lead) > 0").join(F.broadcast(ids) if ids.count() <= _BROADCAST_IDS else ids, "doc_id", "left_semi")
    leads = leads.select("doc_id", F.array_distinct(F.transform("lead", lambda x: F.hash(x))).alias("lead"),
                                                 F.size("lead").alias("long"))
    leads = leads.withColumn("same", F.col("long") - F.size("lead")).drop("long")
    two = pairs.join(leads.withColumnsRenamed({"doc_id": "b", "lead": "lead_b", "same": "same_b"}), "b").join(
        leads.withColumnsRenamed({"doc_id": "a", "lead": "lead_a", "same": "same_a"}), "a")
    common = F.size(F.array_intersect("lead_a", "lead_b")) + F.least("same_a", "same_b")
    done = materialize(two.filter(enough(common)).select("a", "b", "na", "nb").distinct(), "promising")
    release(pairs, ids)
    return done


def _overlaps(documents: DataFrame, pairs: DataFrame, sets: DataFrame, facts: DataFrame, frequent: np.ndarray,
              width: int, t: int, fragments: int) -> DataFrame:
    """Pairs ``a, b`` whose summed partial counts reach the threshold.

    Marks, the distinct 16-bit hashes of a set, come first: common marks plus the n-grams that share a mark with another of
    their set are never fewer than the common n-grams, and a mark is a quarter of the bytes.
    """
    pairs = _promising(pairs, sets, facts, t)
    ids = materialize(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "ids")
    small = ids.count() <= _BROADCAST_IDS
    wanted = documents.join(F.broadcast(ids) if small else ids, F.col("doc_id") == F.col("node"), "left_semi")

    def cut(batches):
        for batch in batches:
            ids_, frags, segments, marks = [], [], [], []
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            none, no_marks = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int16)
            for row, _, grams in _sets(batch, width):
                late = np.isin(grams, frequent, assume_unique=True) if len(frequent) else np.zeros(len(grams), bool)
                # the last fragment holds the frequent end of the order, the others equal ranges of hashes
                part = np.where(late, fragments - 1, (grams >> np.uint64(32)) * np.uint64(fragments - 1) >> np.uint64(32))
                own = np.unique(part)
                ids_ += [doc[row]] * (len(own) + 1)
                frags += [*own.tolist(), -1]
                segments += [grams[part == f].view(np.int64) for f in own] + [none]
                marks += [no_marks] * len(own) + [np.unique(grams.astype(np.uint16)).view(np.int16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids_, pa.int64()), pa.array(frags, pa.int32()), lists(segments, pa.int64()), lists(marks, pa.int16())],
                ["node", "fragment", "grams", "marks"])

    cuts = materialize(wanted.select("doc_id", "text").mapInArrow(
        cut, "node long, fragment int, grams array<long>, marks array<short>"), "segments")
    marked, segments = cuts.filter("fragment = -1").select("node", "marks"), cuts.filter("fragment >= 0").drop("marks")
    near = pairs.join(marked.withColumnsRenamed({"node": "b", "marks": "marks_b"}), "b").join(
        marked.withColumnsRenamed({"node": "a", "marks": "marks_a"}), "a")
    most = F.size(F.array_intersect("marks_a", "marks_b")) + F.least(
        F.col("na") - F.size("marks_a"), F.col("nb") - F.size("marks_b"))
    near = near.filter(most * (100 + t) >= (F.col("na") + F.col("nb")) * t).select("a", "b", "na", "nb").distinct()
    left = near.join(segments.withColumnsRenamed({"node": "b", "grams": "more"}), "b")
    met = left.join(segments.withColumnRenamed("node", "a"), ["a", "fragment"])
    partial = met.select("a", "b", "na", "nb", "fragment", F.size(
        F.array_intersect("grams", "more")).cast("long").alias("common"))
    partial = partial.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("common").alias("common"))  # an id may be repeated
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    done = materialize(total.filter(F.col("common") * 100 >= t * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b"), "common")
    release(pairs, ids, cuts)
    return done


def ngram_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                     threshold_percent: int = 85, fragments: int = FRAGMENTS,
                     frequent_limit: int = FREQUENT_LIMIT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per row; the component's name is its smallest id."""
    t = threshold_percent
    documents = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    frequent = _frequent(documents, width, frequent_limit)

    def prefixes(batches):
        none = np.zeros(0, dtype=np.int64)
        seen = set()  # of a partition: copies after the first take no part in the search
        for batch in batches:
            n, one, two, leads, odd = [], [], [], [], []
            for _, own, grams in _sets(batch, width):
                key = sequence_hash(own)
                n.append(len(grams))
                one.append(key[0])
                two.append(key[1])
                leads.append(grams[:0].view(np.int64) if key in seen else _prefix(grams, frequent, t).view(np.int64))
                odd.append(none if key in seen else parities(grams))
                seen.add(key)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 lists(leads, pa.int64()), lists(odd, pa.int64())], ["doc_id", "n", "k1", "k2", "lead", "odd"])

    sets = materialize(documents.mapInArrow(
        prefixes, "doc_id long, n long, k1 long, k2 long, lead array<long>, odd array<long>"), "sets")
    classes = materialize(sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")
    firsts = sets.filter("size(lead) > 0 AND doc_id IS NOT NULL")
    entries = firsts.select(F.posexplode("lead").alias("pos", "block"), F.col("doc_id").alias("node"), F.col("n").cast("int"))
    of_block = Window.partitionBy("block")  # entries are shuffled once
    met = entries.withColumn("_rows", F.count("*").over(of_block)).withColumn("_least", F.min("n").over(of_block))
    # no set of the block is small enough for an n-gram that stands so late to be the first common one
    reach = (F.col("n") - F.col("pos")).cast("long") * (100 + t) >= (F.col("n") + F.col("_least")).cast("long") * t
    blocks = materialize(met.filter("_rows > 1").select("pos", "block", "node", "n", reach.alias("reaches")), "blocks")
    facts = materialize(blocks.groupBy("node").agg(F.count("*").alias("shared")).join(
        firsts.select(F.col("doc_id").alias("node"), "n", (F.col("n") - F.size("lead")).alias("after")), "node"), "facts")
    copies = firsts.select("doc_id", "k1", "k2").join(classes.filter("copies > 1"), ["k1", "k2"]).filter(
        "doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()

    def possible(x, y):
        """Enough n-grams are left, from the first common one on, in sets of these sizes."""
        rest = F.least(x["n"] - x["pos"], y["n"] - y["pos"]).cast("long")
        return rest * (100 + t) >= (x["n"] + y["n"]).cast("long") * t

    copies = materialize(copies, "copies")
    # an id may be repeated with different texts: any of its rows may be the one that links, none is told apart by one sketch
    told = firsts.groupBy(F.col("doc_id").alias("node")).agg(F.first(F.struct(
        "odd", F.slice("lead", 1, FIRST).alias("first"))).alias("own"), F.count("*").alias("rows"))
    told = told.select("node", *[F.when(F.col("rows") == 1, F.col(f"own.{c}")).alias(c) for c in ("odd", "first")])
    roots = link_blocks(blocks.filter("reaches").drop("reaches"), lambda pairs: _overlaps(
        documents, pairs, sets, facts, frequent, width, t, fragments), possible, columns=("pos", "n"),
        known=copies, central=F.col("pos"),  # few rarer n-grams: the unedited text of a block
        details=told, close=lambda x, y: F.coalesce(_close(t)(x, y), F.lit(True)) & ~F.coalesce(_met_before(x, y), F.lit(False)))
    release(blocks, facts, copies)
    # two classes of copies may start at one id only if that id is repeated; then its least root counts
    named = classes.join(roots.groupBy("node").agg(F.min("root").alias("root")), "node", "left").select(
        F.xxhash64("k1", "k2").alias("content"), "k1", "k2", F.coalesce("root", "node").alias("component_id"), F.col("copies").alias("n"))
    named = materialize(named, "components")
    release(roots, classes)
    full = sets.filter("n > 0 AND doc_id IS NOT NULL").select(
        "doc_id", F.col("n").alias("n_shingles"), F.xxhash64("k1", "k2").alias("content"), "k1", "k2")
    placed = join_per_key(full, named.withColumnsRenamed({"k1": "j1", "k2": "j2"}), "content", "doc_id").filter(
        "k1 = j1 AND k2 = j2").select("doc_id", "n_shingles", "component_id")
    rest = sets.filter("n = 0 OR doc_id IS NULL").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return placed.unionByName(rest)

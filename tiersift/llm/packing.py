"""Packing documents into sequences: dominance reduction, then best fit, both on the histogram of lengths.

Whether and how pieces fit depends on their lengths alone, so the plan is made from at most ``capacity`` counts,
whatever the number of documents. It consists of stretches: pieces of one length, by rank, go to consecutive
sequences at one offset. Pieces then find their stretch by length and rank in a join.

Edge cases: null and empty texts are the end id alone; texts longer than a sequence are cut and only
these; repeated rows are packed as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiersift.llm.tokens import encoder, in_batches
from tiersift.runtime import materialize

CAPACITY = 4096
RANKED_TOGETHER = 100_000  # pieces of one length numbered in one task
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLAN = "length long, low long, high long, first long, per long, at long"


def cut_documents(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of every document."""

    def work(batches):
        encode = encoder(tokenizer).encode
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            texts = (raw for part in in_batches(batch.column(1).to_pylist()) for raw in encode(part))
            for doc, raw in zip(ids, texts, strict=True):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at:at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows) if rows else [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, PIECES)


class _Plan:
    """Stretches placed so far and, by room left, the runs of open sequences."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = {w: n for w, n in counts.items() if n > 0}
        self.capacity = capacity
        self.used = dict.fromkeys(counts, 0)
        self.stretches: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = {}
        self.rooms: list[int] = []

    def place(self, length: int, count: int, first: int, per: int, at: int) -> None:
        low = self.used[length]
        self.stretches.append((length, low, low + count, first, per, at))
        self.used[length] = low + count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: tuple[int, ...], times: int) -> None:
        """Close ``times`` sequences that hold exactly these lengths."""
        at = 0
        for length in lengths:
            self.place(length, times, self.sequences, 1, at)
            at += length
        self.sequences += times

    def keep_open(self, first: int, count: int, room: int) -> None:
        if count and room:
            if room not in self.open:
                self.open[room] = []
                insort(self.rooms, room)
            self.open[room].append((first, count))

    def take_tightest(self, length: int) -> tuple[int, int, int] | None:
        i = bisect_left(self.rooms, length)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        first, count = self.open[room].pop()
        if not self.open[room]:
            del self.open[room], self.rooms[i]
        return first, count, room


def _reduce(plan: _Plan) -> None:
    """Fix sets that dominate every other feasible set of their largest length.

    A length w goes alone if nothing fits beside it; with the length that fills the sequence exactly, if there
    is one; with the largest that fits, if no two others fit beside it: whatever else could share its sequence is no
    larger than this partner, so some optimal packing contains the set.
    """
    changed = True
    while changed:
        changed = False
        for w in sorted(plan.left, reverse=True):
            while plan.left.get(w):
                n = plan.left[w]
                sizes = sorted(x for x in plan.left if x != w or n > 1)
                rest, room = [x for x in sizes if x <= plan.capacity - w], plan.capacity - w
                if not rest:
                    plan.fix((w,), n)
                elif rest[-1] == room or _smallest_two(plan, rest, w) > room:
                    k = rest[-1]
                    times = n // 2 if k == w else min(n, plan.left[k])
                    plan.fix((w, k), times)
                else:
                    break
                changed = True


def _smallest_two(plan: _Plan, rest: list[int], w: int) -> int:
    """Sum of the two smallest lengths that could join one piece of length ``w``."""
    smallest = rest[0]
    spare = plan.left[smallest] - (smallest == w)
    if spare >= 2:
        return 2 * smallest
    return smallest + rest[1] if len(rest) > 1 else plan.capacity + 1


def _best_fit(plan: _Plan) -> None:
    """Best fit of decreasing lengths: each piece goes to the open sequence with the least room for it."""
    for w in sorted(plan.left, reverse=True):
        while plan.left.get(w):
            n = plan.left[w]
            found = plan.take_tightest(w)
            if found is None:
                per = plan.capacity // w
                found = (plan.sequences, -(-n // per), plan.capacity)
                plan.sequences += found[1]
            first, count, room = found
            per = room // w
            full = min(count, n // per)
            if full:
                plan.place(w, full * per, first, per, plan.capacity - room)
                plan.keep_open(first, full, room - full_size(per, w))
            some = min(n - full * per, per) if full < count else 0
            if some:
                plan.place(w, some, first + full, some, plan.capacity - room)
                plan.keep_open(first + full, 1, room - some * w)
            plan.keep_open(first + full + bool(some), count - full - bool(some), room)


def full_size(per: int, length: int) -> int:
    return per * length


def plan_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Stretches ``length, low, high, first, per, at`` and the number of sequences.

    Pieces of ``length`` with rank in low..high-1 lie in sequence first + (rank - low) / per, at ``at`` plus length
    times the remainder.
    """
    plan = _Plan(counts, capacity)
    _reduce(plan)
    _best_fit(plan)
    return plan.stretches, plan.sequences


def _ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds ``rank``, 0, 1, ... within a length. A length owned by many pieces is numbered in parts."""
    spark = pieces.sparkSession
    parts = spark.createDataFrame([(w, -(-n // RANKED_TOGETHER)) for w, n in counts.items()], "length long, parts long")
    pieces = pieces.join(F.broadcast(parts), "length")  # at most one row per length
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))
    pieces = pieces.withColumn("part", F.when(F.col("parts") > 1, part).otherwise(0))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.groupBy("length", "part").agg(F.count("*").alias("n")).select(
        "length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    numbered = pieces.withColumn("rank", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("offset")).drop(
        "part", "parts", "offset")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with a ``length`` of at most ``capacity``."""
    pieces = materialize(pieces, "pieces")
    counts = {w: n for w, n in pieces.groupBy("length").count().collect()}  # at most capacity rows
    stretches, _ = plan_lengths(counts, capacity)
    plan = pieces.sparkSession.createDataFrame(stretches, _PLAN)
    ranked = _ranked(pieces, counts)
    # at most about 3 * capacity^1.5 stretches, whatever the input: one is made per length and open run
    met = ranked.alias("p").join(F.broadcast(plan).alias("s"), (F.col("p.length") == F.col("s.length"))
                                 & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    place = F.col("rank") - F.col("low")
    return met.select(
        *[F.col(f"p.{c}") for c in pieces.columns],
        (F.col("first") + F.floor(place / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.col("p.length") * (place % F.col("per"))).cast("long").alias("offset"))


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    return pack(cut_documents(documents, tokenizer, end_id, capacity), capacity)

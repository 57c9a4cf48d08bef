"""Extendible hashing of documents into shards under a byte limit.

A directory indexed by leading hash bits starts with one bucket. Only a bucket above the limit splits, on the next
bit. Rounds look at ``STEP`` more bits of the buckets still open, so what is grouped is at most 2^STEP
cells per open bucket; closed buckets are not touched again.

A row heavier than the limit ends in a bucket of its own (``oversized``), as do rows of one repeated id, whose hash never
differs; very long texts count all their bytes. Null ids share one hash, null texts weigh nothing, and an empty table has no shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersift.runtime import materialize, shared_path

HASH_BITS = 60
STEP = 12
LIMIT = 64 << 20


def hash_of(id_col: str) -> Column:
    """The first 60 bits of the id's MD5, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def bits_of(hash_: Column, depth: Column | int) -> Column:
    """The leading ``depth`` bits, as text."""
    return F.lpad(F.bin(hash_), HASH_BITS, "0").substr(F.lit(1), F.lit(depth) if isinstance(depth, int) else depth)


def _cell(hash_: Column, bits: int) -> Column:
    return F.shiftright(hash_, HASH_BITS - bits)


def directory(weights: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """``bits`` and ``cell, depth, oversized`` of all cells closed in a round; ``weights`` has ``h, bytes``.

    A cell tells that rows with these leading bits belong to the bucket of its first ``depth`` bits.
    """
    result, before = [], 0
    left = weights
    while before < HASH_BITS:
        bits = min(before + STEP, HASH_BITS)
        cells = materialize(left.groupBy(_cell(F.col("h"), bits).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high")), "cells")
        buckets = cells.select("*", F.explode(F.sequence(F.lit(before), F.lit(bits))).alias("depth")).withColumn(
            "prefix", F.expr(f"shiftright(cell, {bits} - depth)"))
        closed = buckets.groupBy("depth", "prefix").agg(
            F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high")).filter(
            (F.col("bytes") <= limit) | (F.col("low") == F.col("high")))
        found = buckets.select("cell", "depth", "prefix").join(closed, ["depth", "prefix"]).groupBy("cell").agg(
            F.min(F.struct("depth", (F.col("bytes") > limit).alias("oversized"))).alias("to"))
        found = materialize(found.select("cell", "to.depth", "to.oversized"), "directory")
        result.append((bits, found))
        open_cells = cells.join(found, "cell", "left_anti").select("cell")
        if open_cells.isEmpty():
            break
        left = materialize(left.withColumn("cell", _cell(F.col("h"), bits)).join(open_cells, "cell", "left_semi").drop("cell"), "open")
        before = bits
    return result


def with_shards(documents: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns with ``shard`` (its bits), ``depth``, ``bytes`` and ``oversized``."""
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    weights = materialize(documents.select(hash_of(id_col).alias("h"), size.alias("bytes")), "weights")
    rows = documents.withColumns({"_h": hash_of(id_col), "_bytes": size})
    depth, oversized = F.lit(None).cast("int"), F.lit(None).cast("boolean")
    for i, (bits, found) in enumerate(directory(weights, limit)):
        named = found.select(F.col("cell").alias(f"_cell{i}"), F.col("depth").alias(f"_depth{i}"),
                             F.col("oversized").alias(f"_over{i}"))
        rows = rows.withColumn(f"_cell{i}", _cell(F.col("_h"), bits)).join(named, f"_cell{i}", "left")
        depth, oversized = F.coalesce(depth, F.col(f"_depth{i}")), F.coalesce(oversized, F.col(f"_over{i}"))
    return rows.select(*documents.columns, bits_of(F.col("_h"), depth).alias("_shard"), depth.alias("_depth"),
                       "_bytes", oversized.alias("_oversized"))


def write_shards(documents: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write one folder per shard below ``path``, named by its bits after ``b``."""
    rows = with_shards(documents, limit).withColumn("_shard", F.concat(F.lit("b"), "_shard"))
    rows.repartition("_shard").write.partitionBy("_shard").parquet(path)


def shard_documents(documents: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Write the shards and return ``doc_id, shard, depth, bytes, oversized`` of every row as read back from them."""
    path = shared_path(documents.sparkSession, "shards")
    write_shards(documents.select("doc_id", "text"), path, limit)
    kind = documents.schema["doc_id"].dataType.simpleString()  # told, as no files come from an empty table
    back = documents.sparkSession.read.schema(
        f"doc_id {kind}, text string, _depth int, _bytes long, _oversized boolean, _shard string").parquet(path)
    return back.select("doc_id", F.substring("_shard", 2, HASH_BITS).alias("shard"), F.col("_depth").alias("depth"),
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.col("_oversized").alias("oversized"))

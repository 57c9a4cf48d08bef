"""Session helpers: shared scratch space, lineage cuts, skew-safe joins with a small side."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SALTS = 16  # at least


def _salts(rows: DataFrame) -> int:
    """Sub-keys for a hot key: as many as the session has shuffle partitions, so that a large share of the rows spreads over all."""
    return max(SALTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names, else one below the session's own warehouse."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current is None:
        sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch")
        current = sc.getCheckpointDir()
    return current


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, keeps column pruning and sizes, and
    survives the loss of executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def release(*tables: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for these tables; nothing may read them any more."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path is not None:
            spark = table.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
            table.stored_at = None


def drop_shuffles(spark: SparkSession) -> None:
    """Shuffle files stay until the driver's garbage collection finds that no plan reads them; ask for one after a large shuffle."""
    spark.sparkContext._jvm.System.gc()


def spread(table: DataFrame) -> DataFrame:
    """Deal out a table that is one input split, at most ``spark.sql.files.maxPartitionBytes`` in all.

    Any larger table is read in several splits and left alone.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() > 1 else table.repartition(cores)


def packed(table: DataFrame, partition_bytes: int = 64 << 20) -> DataFrame:
    """Merge the small partitions of a stored table before many passes over it."""
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = max(1, -(-size // partition_bytes))
    return table.coalesce(wanted) if table.rdd.getNumPartitions() > wanted else table


def join_cluster_side(rows: DataFrame, per_key: DataFrame, key: str, row_id: str,
                      how: str = "inner", salts: int | None = None) -> DataFrame:
    """Join many rows with a table holding one row per key when one key may own a third of them.

    The rows of a key are spread over ``salts`` sub-keys and the one-per-key side is repeated for
    each, so no task receives a whole key. Adaptive execution still turns this into a broadcast
    when the measured size of ``per_key`` allows it.
    """
    salts = salts or _salts(rows)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    repeated = per_key.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds costly columns so that later filters and projections read them instead of repeating them.

    A filter on a projected column is pushed below the projection with the expression written out
    again, once per mention; a generator stops that while filters on other columns still pass.
    """
    built = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(built)))


def numbered(df: DataFrame, order: str, column: str = "ordinal") -> DataFrame:
    """Adds 0, 1, 2, ... in the order of ``order`` without passing all rows through one task.

    Range-partitioned and sorted once; each partition's offset comes from the partition counts.
    """
    placed = materialize(df.repartitionByRange(order).sortWithinPartitions(order)
                         .withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(  # one row per partition
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    done = joined.withColumn(column, F.col("_offset") + row).drop("_at", "_part", "_offset")
    done.stored_at = placed.stored_at  # what ``release`` deletes once the result is stored
    return done


def join_per_key(rows: DataFrame, per_key: DataFrame, key: str, row_id: str, count: str = "n",
                 salts: int | None = None) -> DataFrame:
    """Join rows with a large one-row-per-key table whose ``count`` tells the rows of each key.

    Only keys that own more than a thousandth of all rows are spread and repeated, so fewer than a
    thousand keys reach the driver and the rest of ``per_key`` is shuffled once.
    """
    salts = salts or _salts(rows)
    total = per_key.agg(F.sum(count)).first()[0] or 0
    limit = max(total / 1000, 10_000)
    hot = [r[0] for r in per_key.filter(F.col(count) > limit).select(key).collect()]
    per_key = per_key.drop(count)
    if not hot:
        return rows.join(per_key, key)
    is_hot = F.col(key).isin(hot)
    spread = rows.withColumn("_salt", F.when(
        is_hot, F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int")).otherwise(0))
    repeated = per_key.withColumn("_salt", F.explode(F.when(
        is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return spread.join(repeated, [key, "_salt"]).drop("_salt")

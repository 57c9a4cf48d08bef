"""Result-store views over a write log taken from the event table."""

import datetime as dt

from pyspark.sql import functions as F

from tiersift import schemas
from tiersift.operators import results
from tiersift.runtime import shared_path
from tiersift.sources.jsonl import read_jsonl
from tiersift.sources.store import ResultStore
from workload.fixtures import table
from workload.registry import query

# Each event is one write: the user is the key, later events replace earlier ones.
_WRITES = """CAST(user_id AS {text}) AS fingerprint, event_type AS label, value / (value + 100) AS confidence,
  CASE event_id % 3 WHEN 0 THEN 'rules' WHEN 1 THEN 'ml' ELSE 'llm' END AS source,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE props END AS context, ts AS created_at, event_id AS seq"""

_STORE = f"""w AS (SELECT {_WRITES.format(text='VARCHAR')} FROM events),
st AS (SELECT fingerprint, max_by(label, seq) AS label, max_by(confidence, seq) AS confidence,
  max_by(source, seq) AS source, max_by(coalesce(context, '{{}}'), seq) AS context,
  max(seq) AS seq, max_by(created_at, seq) AS created_at FROM w GROUP BY fingerprint),
c AS (SELECT fingerprint, label, round(confidence, 6) AS confidence, source, context,
  strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created_at, created_at AS moment FROM st)"""
_SHOWN = "fingerprint, label, confidence, source, context, created_at"


def store(spark, sf_dir):
    writes = spark.sql(
        f"SELECT {_WRITES.format(text='STRING')} FROM {{events}}", events=table(spark, sf_dir, "events"))
    return results.latest(results.valid(writes), "seq")


def as_of(spark, sf_dir):
    """The newest event is 'now': one value, read from the aggregate."""
    return table(spark, sf_dir, "events").agg(F.max("ts")).first()[0]


def shown(df):
    return df.select(
        "fingerprint", "label", F.round("confidence", 6).alias("confidence"), "source",
        F.coalesce("context", F.lit("{}")).alias("context"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"))


@query("store_upsert", f"WITH {_STORE} SELECT {_SHOWN} FROM c")
def store_upsert(spark, sf_dir):
    return shown(store(spark, sf_dir))


@query("store_by_source", f"WITH {_STORE} SELECT {_SHOWN} FROM c WHERE source = 'rules' ORDER BY moment DESC")
def store_by_source(spark, sf_dir):
    return shown(results.by_source(store(spark, sf_dir), "rules"))


@query("store_by_label", f"WITH {_STORE} SELECT {_SHOWN} FROM c WHERE label = 'error' ORDER BY moment DESC")
def store_by_label(spark, sf_dir):
    return shown(results.by_label(store(spark, sf_dir), "error"))


@query("store_recent", f"""WITH {_STORE} SELECT {_SHOWN} FROM c
WHERE moment >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def store_recent(spark, sf_dir):
    return shown(results.recent(store(spark, sf_dir), as_of(spark, sf_dir), hours=24))


@query("store_stats", f"""WITH {_STORE}
SELECT 'by_source' AS section, source AS key, count(*) AS n FROM c GROUP BY source
UNION ALL SELECT 'by_label', label, count(*) FROM c GROUP BY label
UNION ALL SELECT 'total', 'classifications', count(*) FROM c
UNION ALL SELECT 'total', 'recent', count(*) FROM c
  WHERE moment >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def store_stats(spark, sf_dir):
    return results.stats(store(spark, sf_dir), as_of(spark, sf_dir))


# Two events write each key, batch by batch; a batch lies some days before the last event.
_AGES = (9, 6, 5, 1)


@query("store_expire", f"""WITH w AS (SELECT CAST(event_id // 2 AS VARCHAR) AS fingerprint, event_type AS label,
  (event_id // 3) % 4 AS batch, event_id FROM events),
k AS (SELECT fingerprint, max_by(label, batch * 1e12 + event_id) AS label, max(batch) AS batch FROM w GROUP BY fingerprint)
SELECT fingerprint, label, (SELECT count(*) FROM k WHERE batch < 2) AS removed FROM k WHERE batch >= 2""")
def store_expire(spark, sf_dir):
    """Four writes of different age, compacted; what is older than five days goes."""
    writes = table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id DIV 2 AS STRING) AS fingerprint", "event_type AS label", "0.9 AS confidence", "'rules' AS source",
        "CAST(NULL AS STRING) AS context", "event_id AS write_order", "(event_id DIV 3) % 4 AS batch")
    kept, now = ResultStore(spark, shared_path(spark, "expire")), as_of(spark, sf_dir)
    for number, age in enumerate(_AGES):
        kept.upsert(writes.filter(F.col("batch") == number), now - dt.timedelta(days=age), number)
    removed = kept.expire(now, days=5)
    return kept.current().select("fingerprint", "label", F.lit(removed).cast("long").alias("removed"))


@query("store_export_file", f"""WITH {_STORE}
SELECT {_SHOWN.replace(", created_at", "")}, count(*) OVER () AS written FROM c""")
def store_export_file(spark, sf_dir):
    """Writes the store as JSON lines, newest first, and reads the file back; rows are counted on the way."""
    kept, path = ResultStore(spark, shared_path(spark, "exported")), shared_path(spark, "export")
    kept.upsert(store(spark, sf_dir))
    written = kept.export(path)
    return read_jsonl(spark, path, schemas.CLASSIFICATION).select(
        "fingerprint", "label", F.round("confidence", 6).alias("confidence"), "source", "context",
        F.lit(written).cast("long").alias("written"))


@query("store_export", f"WITH {_STORE} SELECT {_SHOWN} FROM c ORDER BY moment DESC")
def store_export(spark, sf_dir):
    return shown(results.export(store(spark, sf_dir)))


@query("store_write_cycle", f"""WITH w AS (SELECT {_WRITES.format(text='VARCHAR')}, event_id % 4 AS batch FROM events),
k AS (SELECT fingerprint, max_by(struct_pack(label := label, confidence := confidence, source := source), batch * 1e12 + seq) AS r
  FROM w GROUP BY fingerprint UNION ALL
  SELECT concat('late-', fingerprint), max_by(struct_pack(label := label, confidence := confidence, source := source), seq)
  FROM w WHERE batch = 0 GROUP BY fingerprint)
SELECT fingerprint, r.label AS label, round(r.confidence, 6) AS confidence, r.source AS source FROM k""")
def store_write_cycle(spark, sf_dir):
    """Three writes, compaction, a fourth, expiry of nothing, and one that comes later under the number before the last."""
    writes = spark.sql(f"SELECT {_WRITES.format(text='STRING')}, event_id % 4 AS batch FROM {{events}}",
                       events=table(spark, sf_dir, "events")).withColumnRenamed("seq", "write_order")
    kept, at = ResultStore(spark, shared_path(spark, "cycle")), dt.datetime(2024, 1, 1)
    for number in range(3):
        kept.upsert(writes.filter(F.col("batch") == number), at, number)
    kept.compact()
    kept.upsert(writes.filter("batch = 3"), at, 4)
    kept.expire(at + dt.timedelta(days=1), days=5)
    kept.upsert(writes.filter("batch = 0").withColumn("fingerprint", F.concat(F.lit("late-"), "fingerprint")), at, 3)
    return kept.current().select("fingerprint", "label", F.round("confidence", 6).alias("confidence"), "source")

"""The registered queries of this subpackage with their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tiersift.llm import (
    decontaminate, id_coder, importance, language_id, line_dedup, ngram_join, packing, pseudonyms, quality_model, quality_rules,
    sharding, toxicity, whitening,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS_SQL = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op10_ngram_jaccard_join", f"""WITH RECURSIVE
w AS (SELECT doc_id, {WORDS_SQL.format(text=LOWER_SQL)} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[]
  WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y WHERE 100 * c >= 85 * (len(a.sh) + len(b.sh) - c)),
g AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM s UNION SELECT r.node, g.y FROM r JOIN g ON g.x = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, component_id FROM s JOIN c ON c.node = s.doc_id""")
def op10_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


@query("op3_fourier_quality")
def op3_fourier_quality(spark, sf_dir):
    return quality_model.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_best_fit_packing")
def op8_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_bm25_decontamination")
def op6_bm25_decontamination(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_ftrl_toxicity")
def op7_ftrl_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SHARD_LIMIT = 1 << 20


@query("op9_extendible_hash_shards", f"""WITH
h AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes,
  substr((('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT)::BIT::VARCHAR, 5) AS bits FROM documents),
d AS (SELECT doc_id, bytes, bits, unnest(range(0, 61))::INTEGER AS depth FROM h),
s AS (SELECT doc_id, bytes, depth, left(bits, depth) AS shard,
  sum(bytes) OVER w AS total, min(bits) OVER w = max(bits) OVER w AS alone FROM d WINDOW w AS (PARTITION BY depth, left(bits, depth)))
SELECT doc_id, arg_min(shard, depth) AS shard, min(depth) AS depth, any_value(bytes) AS bytes,
  arg_min(total, depth) > {SHARD_LIMIT} AS oversized FROM s WHERE total <= {SHARD_LIMIT} OR alone GROUP BY doc_id""")
def op9_extendible_hash_shards(spark, sf_dir):
    """Shards of at most 1 MB of text, so that the tables of 1,000 documents split as well."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"), SHARD_LIMIT)


@query("op5_fuzzy_line_dedup")
def op5_fuzzy_line_dedup(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_kept").alias("n_kept"),
                       F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


@query("op1_decision_list")
def op1_decision_list(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_feistel_pseudonyms")
def op2_feistel_pseudonyms(spark, sf_dir):
    """The key is a demonstration value; a real one comes from a secret store."""
    replaced = pseudonyms.with_pseudonyms(table(spark, sf_dir, "documents"), key="demonstration")
    return replaced.select("doc_id", F.col("_n_replaced").alias("n_replaced"), "text")


@query("op4_context_mixing_ids")
def op4_context_mixing_ids(spark, sf_dir):
    return id_coder.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_kneser_ney_language")
def op11_kneser_ney_language(spark, sf_dir):
    return language_id.language_scores(table(spark, sf_dir, "documents"))


@query("op12_jacobi_whitening")
def op12_jacobi_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


BYTES_SQL = "list_transform(range(1, strlen(hex(word)), 2), lambda i: ('0x' || substr(hex(word), i, 2))::BIGINT)"


@query("op13_importance_resampling", rf"""WITH
tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
e AS (SELECT doc_id, unnest(ws) AS word FROM d), f AS (SELECT unnest(ws) AS word FROM b),
k AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, {BYTES_SQL}),
  lambda a, x: xor(t[1 + (xor(a, x) & 255)], a >> 8))) % 10000 AS bucket FROM (SELECT word FROM e UNION SELECT word FROM f), tab),
n AS (SELECT bucket, count(*) AS s FROM e JOIN k USING (word) GROUP BY 1),
m AS (SELECT bucket, count(*) AS t FROM f JOIN k USING (word) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT sum(s) FROM n)::DOUBLE + 10000)
  / ((s::DOUBLE + 1) * (coalesce((SELECT sum(t) FROM m), 0)::DOUBLE + 10000))))::BIGINT AS gain FROM n LEFT JOIN m USING (bucket)),
w AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM e JOIN k USING (word) JOIN g USING (bucket) GROUP BY 1),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE + 0.5)
    / 4294967296))))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
r AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(*) FROM s WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM r""")
def op13_importance_resampling(spark, sf_dir):
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")

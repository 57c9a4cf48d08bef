"""Second and third tier over the derived messages, merge and reports."""

from pyspark.sql import functions as F

from tiersift.operators import merge, reports, results, rules
from tiersift.runtime import materialize
from tiersift.runtime import shared_path
from tiersift.sources.store import ResultStore
from workload.fixtures import emails
from workload.registry import query
from workload.sqlbase import RULES, over_rules

# Scores that stand in for a trained model, so both engines see the same probabilities.
_PROB_BAD = "CASE WHEN email_id % 50 = 7 THEN NULL ELSE CAST((email_id * 37) % 101 AS DOUBLE) / 100 END"

SCORED_SQL = RULES + f""",
s0 AS (SELECT email_id, fingerprint, {_PROB_BAD} AS prob_bad, 1 - ({_PROB_BAD}) AS prob_good FROM r WHERE label = 'UNKNOWN'),
s AS (SELECT *, CASE WHEN prob_bad > prob_good THEN 'BAD' ELSE 'GOOD' END AS label,
  greatest(prob_good, prob_bad) AS confidence,
  coalesce(greatest(prob_good, prob_bad) >= 0.95, false) AS auto FROM s0)"""

_RULE_CONTEXT_SQL = """to_json({'risk_score': risk_score, 'risk_factors': {
  'domain_mismatch': domain_mismatch, 'phishing_keywords': phishing_keywords,
  'suspicious_urls': suspicious_urls, 'auth_failure': auth_failure,
  'urgent_language': urgent_language, 'suspicious_headers': suspicious_headers},
  'is_trusted_domain': is_trusted_domain, 'strong_bad_indicators': strong_bad_indicators})::VARCHAR"""

FINAL_SQL = SCORED_SQL + f""",
t AS (SELECT email_id, 0 AS tier, label, confidence, 'rules' AS source, {_RULE_CONTEXT_SQL} AS context FROM r
  UNION ALL SELECT email_id, 1, label, confidence, 'ml', '{{}}' FROM s WHERE auto
  UNION ALL SELECT email_id, 2, CASE WHEN email_id % 2 = 0 THEN 'BAD' ELSE 'GOOD' END,
    (0.45 + (email_id % 10) * 0.05::DOUBLE) * 0.9::DOUBLE, 'llm_propagated', '{{}}' FROM s WHERE NOT auto),
b AS (SELECT *, row_number() OVER (PARTITION BY email_id ORDER BY confidence DESC, tier) AS rn,
  string_agg(source, '|') OVER (PARTITION BY email_id ORDER BY tier
    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS all_sources FROM t),
final AS (SELECT e.email_id, e.fingerprint, coalesce(b.label, 'UNKNOWN') AS label,
  coalesce(b.confidence, 0) AS confidence, coalesce(b.source, 'none') AS source,
  coalesce(b.context, '{{}}') AS context, coalesce(b.all_sources, '') AS all_sources
  FROM e LEFT JOIN b ON e.email_id = b.email_id AND b.rn = 1)"""


def scored(results_of_rules):
    open_rows = results_of_rules.filter("label = 'UNKNOWN'").select("email_id", "fingerprint")
    return merge.split_by_confidence(open_rows.withColumn("prob_bad", F.expr(_PROB_BAD))
                                     .withColumn("prob_good", 1 - F.col("prob_bad")))


def final(spark, sf_dir):
    by_rules = materialize(rules.classify(emails(spark, sf_dir)), "rules")
    split = scored(by_rules)
    labelled = split.filter("NOT auto").select(
        "email_id", F.when(F.col("email_id") % 2 == 0, "BAD").otherwise("GOOD").alias("label"),
        ((0.45 + (F.col("email_id") % 10) * 0.05) * 0.9).alias("confidence"),
        F.lit("llm_propagated").alias("source"))
    return merge.merge_tiers(by_rules, [
        by_rules.withColumn("context", F.to_json("context")), split.filter("auto"), labelled])


@query("confidence_split", f"""WITH {SCORED_SQL}
SELECT email_id, label, round(confidence, 6) AS confidence, auto FROM s""")
def confidence_split(spark, sf_dir):
    return scored(rules.classify(emails(spark, sf_dir))).select(
        "email_id", "label", F.round("confidence", 6).alias("confidence"), "auto")


@query("final_labels", f"""WITH {FINAL_SQL}
SELECT email_id, fingerprint, label, round(confidence, 6) AS confidence, source, context, all_sources FROM final""")
def final_labels(spark, sf_dir):
    return final(spark, sf_dir).select(
        "email_id", "fingerprint", "label", F.round("confidence", 6).alias("confidence"), "source",
        "context", F.array_join("all_sources", "|").alias("all_sources"))


@query("source_counts", f"WITH {FINAL_SQL} SELECT source, count(*) AS n FROM final GROUP BY source")
def source_counts(spark, sf_dir):
    return reports.count_by(final(spark, sf_dir), "source")


@query("run_summary", f"""WITH {FINAL_SQL}
SELECT 'label_distribution' AS section, label AS key, count(*)::DOUBLE AS value FROM final GROUP BY label
UNION ALL SELECT 'average_confidence', label, round(avg(confidence), 6) FROM final GROUP BY label
UNION ALL SELECT 'source_distribution', source, count(*)::DOUBLE FROM final GROUP BY source
UNION ALL SELECT 'total', 'total_emails', count(*)::DOUBLE FROM final
UNION ALL SELECT 'total', 'bad_percentage',
  round(100.0 * count(*) FILTER (label = 'BAD') / count(*), 6)::DOUBLE FROM final""")
def run_summary(spark, sf_dir):
    return reports.run_summary(final(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("tier_funnel", f"""WITH {FINAL_SQL}, g AS (
  SELECT CASE WHEN label = 'UNKNOWN' THEN 'unresolved' ELSE source END AS stage, count(*) AS n FROM final GROUP BY 1)
SELECT stage, n, round(n * 100.0 / (SELECT sum(n) FROM g), 6)::DOUBLE AS percent FROM g""")
def tier_funnel(spark, sf_dir):
    return reports.tier_funnel(final(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


# A store that already holds the decided messages as rule results and the long open ones as model
# results; other messages are unknown to it.
STORE_SQL = RULES + """,
st AS (SELECT fingerprint, max_by(label, email_id) AS label, max_by(confidence, email_id) AS confidence,
  max_by(CASE WHEN label = 'UNKNOWN' THEN 'ml' ELSE 'rules' END, email_id) AS source
  FROM r WHERE label <> 'UNKNOWN' OR content_length > 2000 GROUP BY fingerprint)"""


def stored(messages):
    written = rules.classify(messages, keep=("content_length",)).filter(
        "label <> 'UNKNOWN' OR content_length > 2000").select(
        "fingerprint", "label", "confidence",
        F.when(F.col("label") == "UNKNOWN", "ml").otherwise("rules").alias("source"),
        F.to_json("context").alias("context"), "email_id")
    return results.latest(results.valid(written), "email_id")


@query("store_hits", f"""WITH {STORE_SQL}
SELECT r.email_id, st.fingerprint, st.label, round(st.confidence, 6) AS confidence
FROM r JOIN st USING (fingerprint) WHERE st.source = 'rules'""")
def store_hits(spark, sf_dir):
    messages = emails(spark, sf_dir)
    return results.hits(messages, stored(messages)).select(
        "email_id", "fingerprint", "label", F.round("confidence", 6).alias("confidence"))


@query("store_misses", f"""WITH {STORE_SQL}
SELECT email_id, fingerprint, subject FROM r
WHERE fingerprint NOT IN (SELECT fingerprint FROM st WHERE source = 'rules')""")
def store_misses(spark, sf_dir):
    """Against a compacted store, whose parts are chosen by the keys of the messages."""
    messages = emails(spark, sf_dir)
    store = ResultStore(spark, shared_path(spark, "known"))
    store.upsert(stored(messages))
    store.compact()
    return results.misses(messages, store.lookup(messages)).select("email_id", "fingerprint", "subject")


@query("store_merge", f"""WITH {STORE_SQL}
SELECT r.email_id, st.label, round(st.confidence, 6) AS confidence, true AS reused
FROM r JOIN st USING (fingerprint) WHERE st.source = 'rules'
UNION ALL SELECT email_id, label, round(confidence, 6), false FROM r
WHERE fingerprint NOT IN (SELECT fingerprint FROM st WHERE source = 'rules')""")
def store_merge(spark, sf_dir):
    messages = emails(spark, sf_dir)
    store = stored(messages)
    reused = results.hits(messages, store).select("email_id", "label", "confidence", F.lit(True).alias("reused"))
    fresh = rules.classify(results.misses(messages, store)).select(
        "email_id", "label", "confidence", F.lit(False).alias("reused"))
    return reused.unionByName(fresh).withColumn("confidence", F.round("confidence", 6))


@query("training_join", f"""WITH {STORE_SQL},
md AS (SELECT fingerprint, max_by(subject, email_id) AS subject, max_by(sender_domain, email_id) AS sender_domain
  FROM r GROUP BY fingerprint)
SELECT st.fingerprint, st.label, round(st.confidence, 6) AS confidence, st.source,
  coalesce(md.subject, '') AS subject, coalesce(md.sender_domain, '') AS sender_domain
FROM st LEFT JOIN md USING (fingerprint) WHERE st.confidence >= 0.7""")
def training_join(spark, sf_dir):
    messages = emails(spark, sf_dir)
    rows = results.training_rows(stored(messages), results.metadata(messages), 0.7)
    return rows.orderBy(F.col("confidence").desc()).withColumn("confidence", F.round("confidence", 6))


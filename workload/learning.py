"""Text weights, training data, classifier and evaluation queries."""

from pyspark.sql import functions as F

from tiersift import constants as K
from tiersift.functions.fields import classifier_text
from tiersift.operators import classifier, evaluation, features, rules, text_vectors
from tiersift.runtime import materialize, shared_path
from workload.fixtures import emails, table
from workload.messages import FEATURES_SQL
from workload.registry import query
from workload.sqlbase import EMAILS, RULES, in_list, quoted

def terms_sql(text="concat(subject, ' ', snippet)"):
    return f"""tk AS (SELECT email_id, list_filter(
    regexp_extract_all(lower({text}), {quoted(K.TOKEN_PATTERN)}, 0),
    lambda w: w NOT IN ({in_list(K.STOP_WORDS)})) AS tokens FROM e),
tm AS (SELECT email_id, tokens, list_concat(tokens, list_transform(range(1, greatest(len(tokens), 1)),
    lambda i: concat(tokens[i], ' ', tokens[i + 1]))) AS terms FROM tk)"""


TERMS_SQL = terms_sql()


def vocabulary_sql(size, text="concat(subject, ' ', snippet)"):
    """Vocabulary and weights; without a size every term counts."""
    bounds = f"""HAVING count(DISTINCT email_id) >= 2 AND count(DISTINCT email_id) <= 0.95 * (SELECT count(*) FROM tm)
  ORDER BY tf DESC, term LIMIT {size}""" if size else ""
    return f"""{terms_sql(text)},
x AS (SELECT email_id, unnest(terms) AS term FROM tm),
v AS (SELECT term, count(*) AS tf, count(DISTINCT email_id) AS df FROM x GROUP BY term
  {bounds}),
vi AS (SELECT *, ln((1.0 + (SELECT count(*) FROM tm)) / (1.0 + df)) + 1 AS idf FROM v),
wr AS (SELECT email_id, term, df, count(*) * any_value(idf) AS raw FROM x JOIN vi USING (term) GROUP BY email_id, term, df),
wt AS (SELECT email_id, term, df, raw / sqrt(sum(raw * raw) OVER (PARTITION BY email_id)) AS weight FROM wr)"""


def documents(spark, sf_dir):
    return text_vectors.with_terms(emails(spark, sf_dir).select(
        "email_id", "subject", "snippet"), classifier_text())


@query("tokens", f"""WITH {EMAILS}, {TERMS_SQL}
SELECT email_id, array_to_string(terms, '|') AS terms, len(tokens) AS n_tokens FROM tm""")
def tokens(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "email_id", F.array_join("terms", "|").alias("terms"), F.size("tokens").cast("long").alias("n_tokens"))


@query("tfidf_vocab", f"""WITH {EMAILS}, {vocabulary_sql(10000)}
SELECT term, tf, df, round(idf, 6) AS idf FROM vi""")
def tfidf_vocab(spark, sf_dir):
    return text_vectors.vocabulary(
        documents(spark, sf_dir), 10_000, n_docs=table(spark, sf_dir, "documents").count()).withColumn("idf", F.round("idf", 6))


@query("tfidf_weights", f"""WITH {EMAILS}, {vocabulary_sql(500)}
SELECT email_id, term, round(weight, 6) AS weight FROM wt""")
def tfidf_weights(spark, sf_dir):
    docs = documents(spark, sf_dir)
    vocab = text_vectors.Vocabulary.fit(
        docs, 500, n_docs=table(spark, sf_dir, "documents").count()).table(spark)
    return text_vectors.weights(docs, vocab).select("email_id", "term", F.round("weight", 6).alias("weight"))


def labelled(spark, sf_dir):
    messages = emails(spark, sf_dir)
    return messages, rules.classify(messages)


@query("training_rows", f"""WITH {RULES}
SELECT email_id, (label = 'BAD')::INT AS y, concat(subject, ' ', snippet) AS txt FROM r WHERE label IN ('GOOD', 'BAD')""")
def training_rows(spark, sf_dir):
    return classifier.training_set(*labelled(spark, sf_dir)).select(
        "email_id", "y", classifier_text().alias("txt"))


@query("class_weights", f"""WITH {RULES}, y AS (
  SELECT (label = 'BAD')::INT AS y, count(*) AS n FROM r WHERE label IN ('GOOD', 'BAD') GROUP BY 1)
SELECT y, n, round((SELECT sum(n) FROM y) / (2.0 * n), 6)::DOUBLE AS weight FROM y""")
def class_weights(spark, sf_dir):
    decided = rules.classify(emails(spark, sf_dir)).filter("label <> 'UNKNOWN'")
    return classifier.class_weights(decided.select((F.col("label") == "BAD").cast("int").alias("y"))) \
        .withColumn("weight", F.round("weight", 6))


@query("feature_stats", f"""WITH {RULES}, {FEATURES_SQL}
SELECT {', '.join(f'round(avg({n}), 6) AS mean_{n}, round(stddev_pop({n}), 6) AS std_{n}'
                  for n in K.FEATURE_NAMES)} FROM f WHERE label <> 'UNKNOWN'""")
def feature_stats(spark, sf_dir):
    rows = features.numeric_features(classifier.training_set(*labelled(spark, sf_dir)))
    return rows.agg(*[c for n in K.FEATURE_NAMES for c in (
        F.round(F.avg(n), 6).alias(f"mean_{n}"), F.round(F.stddev_pop(n), 6).alias(f"std_{n}"))])


@query("split_counts", f"""WITH {RULES}, y AS (
  SELECT (label = 'BAD')::INT AS y, count(*) AS n FROM r WHERE label <> 'UNKNOWN' GROUP BY 1)
SELECT y, true AS is_test, round(n * 0.2)::BIGINT AS n FROM y
UNION ALL SELECT y, false, n - round(n * 0.2)::BIGINT FROM y""")
def split_counts(spark, sf_dir):
    split = classifier.stratified_split(classifier.training_set(*labelled(spark, sf_dir)))
    return split.groupBy("y", "is_test").agg(F.count("*").alias("n"))


def trained(spark, sf_dir):
    messages = emails(spark, sf_dir)
    by_rules = materialize(rules.classify(messages), "rules")
    messages = classifier.prepare(messages)
    model, scored = classifier.train(messages, by_rules)
    return messages, by_rules, model, scored


@query("ml_train", f"""WITH {RULES}, y AS (
  SELECT label, count(*) AS n, round(count(*) * 0.2)::BIGINT AS t FROM r WHERE label <> 'UNKNOWN' GROUP BY 1)
SELECT true AS is_test, sum(t)::BIGINT AS n, true AS accurate FROM y
UNION ALL SELECT false, sum(n - t)::BIGINT, true FROM y""")
def ml_train(spark, sf_dir):
    """Size of both parts, and whether the model tells nine of ten rows that it saw and most of those that it did not."""
    parts = classifier.quality(trained(spark, sf_dir)[3])
    return parts.select("is_test", "n", (F.col("accuracy") >= F.when(F.col("is_test"), 0.5).otherwise(0.9)).alias("accurate"))


@query("ml_score", f"""WITH {RULES}
SELECT email_id, fingerprint, 1.0::DOUBLE AS total, true AS possible FROM r WHERE label = 'UNKNOWN'""")
def ml_score(spark, sf_dir):
    """Every open message once, with two probabilities that make one."""
    messages, by_rules, model, _ = trained(spark, sf_dir)
    scored = model.score(rules.undecided(messages, by_rules))
    return scored.select("email_id", "fingerprint", F.round(F.col("prob_good") + F.col("prob_bad"), 9).alias("total"),
                         F.col("prob_good").between(0, 1).alias("possible"))


@query("model_roundtrip", f"""WITH {RULES}
SELECT count(*) AS n, 0.0::DOUBLE AS largest_change FROM r WHERE label = 'UNKNOWN'""")
def model_roundtrip(spark, sf_dir):
    """Largest change of a probability after saving and loading the model: zero."""
    messages, by_rules, model, _ = trained(spark, sf_dir)
    path = shared_path(spark, "model")
    model.save(path)
    open_rows = rules.undecided(messages, by_rules)
    again = classifier.TriageModel.load(path).score(open_rows).select(
        "email_id", F.col("prob_bad").alias("reloaded"))
    return model.score(open_rows).join(again, "email_id").agg(
        F.count("*").alias("n"), F.max(F.abs(F.col("prob_bad") - F.col("reloaded"))).alias("largest_change"))


@query("eval_accuracy", "SELECT avg((quality = toxic)::INT)::DOUBLE AS accuracy FROM labels")
def eval_accuracy(spark, sf_dir):
    return evaluation.accuracy(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("eval_confusion", """SELECT quality AS truth, count(*) FILTER (toxic = 0) AS predicted_0,
  count(*) FILTER (toxic = 1) AS predicted_1 FROM labels GROUP BY quality""")
def eval_confusion(spark, sf_dir):
    return evaluation.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("eval_report", """
WITH k AS (SELECT unnest([0, 1]) AS k),
c AS (SELECT k, count(*) FILTER (quality = k AND toxic = k) AS hit, count(*) FILTER (toxic = k) AS said,
  count(*) FILTER (quality = k) AS support FROM k, labels GROUP BY k),
p AS (SELECT k, support, CASE WHEN said = 0 THEN 0 ELSE hit / said END AS precision,
  CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall FROM c),
f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM p),
a AS (SELECT k::VARCHAR AS class, precision, recall, f1, support FROM f
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), sum(support) FROM f
UNION ALL SELECT 'accuracy', q, q, q, n FROM (SELECT avg((quality = toxic)::INT) AS q, count(*) AS n FROM labels))
SELECT class, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall,
  round(f1, 6)::DOUBLE AS f1, support::BIGINT AS support FROM a""")
def eval_report(spark, sf_dir):
    rows = evaluation.report(table(spark, sf_dir, "labels"), "quality", "toxic")
    return rows.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")

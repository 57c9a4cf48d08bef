"""Cluster, representative and batch-scoring queries; embedding labels serve as cluster ids."""

import numpy as np
from pyspark.sql import functions as F

from tiersift.operators import clusters, rules, scoring
from tiersift.runtime import materialize, shared_path
from tiersift.sources.clusters import load_clusters, save_clusters
from workload.fixtures import emails, table
from workload.learning import vocabulary_sql
from workload.labeller import wording_labeller
from workload.registry import query
from workload.sqlbase import EMAILS, RULES


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("email_id"), "embedding")


def assignments(spark, sf_dir):
    """Label 9 plays the noise cluster."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("email_id"),
        F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("cluster_id"))


def reps(spark, sf_dir):
    return clusters.representatives(vectors(spark, sf_dir), assignments(spark, sf_dir))


GROUPS_SQL = f"""{EMAILS},
a AS (SELECT vec_id AS email_id, label AS cluster_id, embedding::DOUBLE[] AS v FROM embeddings WHERE label <> 9),
d AS (SELECT email_id, cluster_id, unnest(v) AS x, unnest(range(len(v))) AS dim FROM a),
cn AS (SELECT cluster_id, dim, avg(x) AS value FROM d GROUP BY cluster_id, dim),
ct AS (SELECT cluster_id, list(value ORDER BY dim) AS center FROM cn GROUP BY cluster_id),
rp AS (SELECT cluster_id, arg_min(email_id, {{'d': list_distance(v, center), 'i': email_id}}) AS rep_email_id
  FROM a JOIN ct USING (cluster_id) GROUP BY cluster_id),
sz AS (SELECT cluster_id, count(*) AS size, min(email_id) AS first_id FROM a GROUP BY cluster_id)"""


def over_groups(select):
    return f"WITH {GROUPS_SQL} {select}"


@query("choose_k", """WITH n AS (SELECT count(*) AS n FROM documents)
SELECT n, CASE WHEN n < 2 THEN n ELSE least(greatest(2, n // 10), 100) END AS k_text,
  CASE WHEN n < 2 THEN n ELSE least(least(20, n // 2), greatest(greatest(2, n // 10), n // 5)) END AS k_embedding FROM n""")
def choose_k(spark, sf_dir):
    return clusters.cluster_counts(table(spark, sf_dir, "documents"))


@query("cluster_sizes", over_groups("SELECT cluster_id, size FROM sz"))
def cluster_sizes(spark, sf_dir):
    return clusters.sizes(assignments(spark, sf_dir))


@query("cluster_centroids", over_groups("SELECT cluster_id, dim, round(value, 6) AS value FROM cn"))
def cluster_centroids(spark, sf_dir):
    centers = clusters.centroids(vectors(spark, sf_dir), assignments(spark, sf_dir))
    long = centers.select("cluster_id", F.posexplode("center").alias("dim", "value"))
    return long.select("cluster_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query("cluster_reps", over_groups("SELECT cluster_id, rep_email_id FROM rp"))
def cluster_reps(spark, sf_dir):
    return reps(spark, sf_dir)


@query("rep_emails", over_groups("""SELECT rp.cluster_id, e.email_id, e.subject, e.from_hdr
FROM rp JOIN e ON e.email_id = rp.rep_email_id"""))
def rep_emails(spark, sf_dir):
    return clusters.representative_emails(emails(spark, sf_dir), reps(spark, sf_dir)).select(
        "cluster_id", "email_id", "subject", "from_hdr")


@query("cluster_savings", over_groups("""SELECT sum(size)::BIGINT AS emails, count(*) AS clusters,
  round(sum(size) / count(*), 6)::DOUBLE AS average_size,
  round((1 - count(*) / sum(size)) * 100, 6)::DOUBLE AS reduction_percent FROM sz"""))
def cluster_savings(spark, sf_dir):
    rows = clusters.totals(assignments(spark, sf_dir))
    return rows.select("emails", "clusters", F.round("average_size", 6).alias("average_size"),
                       F.round("reduction_percent", 6).alias("reduction_percent"))


_SUMMARY_SQL = over_groups("""
SELECT sz.cluster_id, size, rep_email_id AS representative_id, e.fingerprint AS representative_fingerprint,
  e.subject AS representative_subject, e.from_hdr AS representative_from, p.member_preview
FROM sz JOIN rp USING (cluster_id) LEFT JOIN e ON e.email_id = rp.rep_email_id
JOIN (SELECT cluster_id, array_to_string(list(email_id ORDER BY email_id)[1:10], '|') AS member_preview
  FROM a GROUP BY cluster_id) p ON p.cluster_id = sz.cluster_id""")


@query("cluster_summary", _SUMMARY_SQL)
def cluster_summary(spark, sf_dir):
    rows = clusters.summary(emails(spark, sf_dir), assignments(spark, sf_dir), reps(spark, sf_dir))
    return rows.withColumn("member_preview", F.array_join(
        F.transform("member_preview", lambda i: i.cast("string")), "|"))


@query("cluster_roundtrip", _SUMMARY_SQL)
def cluster_roundtrip(spark, sf_dir):
    """Saves and reloads a cluster result; the noise cluster takes no part in it."""
    path = shared_path(spark, "clusters")
    assigned, chosen = assignments(spark, sf_dir), materialize(reps(spark, sf_dir), "reps")
    save_clusters(path, assigned, chosen, clusters.summary(emails(spark, sf_dir), assigned, chosen))
    loaded, reloaded, summaries = load_clusters(spark, path)
    sizes = clusters.sizes(loaded).join(reloaded, "cluster_id")
    return sizes.join(summaries.drop("size", "representative_id"), "cluster_id").withColumnRenamed(
        "rep_email_id", "representative_id").withColumn("member_preview", F.array_join(
            F.transform("member_preview", lambda i: i.cast("string")), "|"))


@query("top_clusters", over_groups("""
SELECT t.cluster_id, t.size, substring(coalesce(e.subject, 'No subject'), 1, 60) AS subject,
  substring(coalesce(e.from_hdr, 'Unknown'), 1, 60) AS from_hdr
FROM (SELECT * FROM sz ORDER BY size DESC, first_id LIMIT 5) t
JOIN rp USING (cluster_id) LEFT JOIN e ON e.email_id = rp.rep_email_id"""))
def top_clusters(spark, sf_dir):
    return clusters.largest(emails(spark, sf_dir), assignments(spark, sf_dir), reps(spark, sf_dir))


def against_all_centres(rows, assigned, centers):
    """``email_id, nearest``: whether no other centre is nearer than a row's own."""
    placed = [(r["cluster_id"], r["center"]) for r in centers.collect()]  # one row a cluster
    ids, points = np.array([p[0] for p in placed]), np.array([p[1] for p in placed])

    few = max(1, (1 << 22) // max(points.size, 1))  # every row meets every centre in every dimension

    def run(frames):
        for pdf in (frame.iloc[low:low + few] for frame in frames for low in range(0, len(frame), few)):
            far = ((np.stack(pdf["embedding"].to_list())[:, None, :] - points[None]) ** 2).sum(2)
            own = far[np.arange(len(pdf)), [int(np.flatnonzero(ids == c)[0]) for c in pdf["cluster_id"]]]
            yield pdf[["email_id"]].assign(nearest=own <= far.min(axis=1) + 1e-9)

    joined = clusters.as_arrays(rows).join(assigned, "email_id").repartition(16, "email_id").select("email_id", "cluster_id", "embedding")
    return joined.mapInPandas(run, "email_id long, nearest boolean")


@query("kmeans_assign", "SELECT vec_id AS email_id, true AS nearest FROM embeddings")
def kmeans_assign(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return against_all_centres(rows, *clusters.kmeans(rows))


@query("kmeans_text", f"""WITH {RULES}
SELECT email_id, true AS nearest, true AS represented FROM r WHERE label = 'UNKNOWN'""")
def kmeans_text(spark, sf_dir):
    """Text clusters of the open messages: every one at its nearest centre, in a cluster led by a member of it."""
    messages = materialize(emails(spark, sf_dir), "emails")
    rows = clusters.text_embedding(rules.undecided(messages, rules.classify(messages)))
    rows = materialize(rows, "vectors")
    assigned, centers = clusters.kmeans(rows, text_clusters=True)
    summary = clusters.summary(messages, assigned, clusters.representatives(rows, assigned, centers))
    led = summary.join(assigned.select(F.col("email_id").alias("representative_id"), F.col("cluster_id").alias("home")), "representative_id")
    led = led.select("cluster_id", (F.col("home") == F.col("cluster_id")).alias("represented"))
    placed = assigned.join(F.broadcast(led), "cluster_id", "left").select(  # one row a cluster
        "email_id", F.coalesce("represented", F.lit(False)).alias("represented"))
    return against_all_centres(rows, assigned, centers).join(placed, "email_id")


_PLAIN = "concat_ws(' ', nullif(subject, ''), nullif(snippet, ''), nullif(sender_domain, ''))"


@query("embed_default", f"""WITH {EMAILS}, {vocabulary_sql(500, _PLAIN)}
SELECT email_id, (SELECT count(*) FROM v)::INT AS dimensions, (count(term) > 0)::INT::DOUBLE AS length
FROM e LEFT JOIN wt USING (email_id) GROUP BY email_id""")
def embed_default(spark, sf_dir):
    rows = clusters.as_arrays(clusters.text_embedding(emails(spark, sf_dir)))
    return rows.select("email_id", F.size("embedding").alias("dimensions"), F.round(F.sqrt(F.aggregate(
        "embedding", F.lit(0.0), lambda t, x: t + x * x)), 6).alias("length"))


# One representative per sender: the smallest message id of every From header.
_LINE_SQL = """concat('id:rep_', k, ' | from:''', from_hdr, ''' | subject:''', subject, ''' | snippet:''',
  CASE WHEN length(snippet) > 500 THEN concat(substring(snippet, 1, 500), '...') ELSE snippet END, '''',
  CASE WHEN len(url_domains) > 0 THEN concat(' | url_domains:[', array_to_string(list_transform(url_domains[1:5],
    lambda d: concat('''', d, '''')), ', '), ']') ELSE '' END,
  CASE WHEN sender_domain <> '' THEN concat(' | sender_domain:''', sender_domain, '''') ELSE '' END)"""
LINES_SQL = f"""{EMAILS},
g AS (SELECT min(email_id) AS cluster_id FROM e GROUP BY from_hdr),
i AS (SELECT e.*, g.cluster_id, row_number() OVER (ORDER BY g.cluster_id) - 1 AS k FROM g JOIN e ON e.email_id = g.cluster_id),
l AS (SELECT cluster_id, concat('rep_', k) AS id, k // 10 AS batch_id, k % 10 + 1 AS position, {_LINE_SQL} AS line FROM i)"""


def items(spark, sf_dir):
    messages = emails(spark, sf_dir)
    first = messages.groupBy("from_hdr").agg(F.min("email_id").alias("cluster_id")).select(
        "cluster_id", F.col("cluster_id").alias("rep_email_id"))
    return scoring.batch_items(clusters.representative_emails(messages, first))


@query("prompt_lines", f"WITH {LINES_SQL} SELECT cluster_id, id, line FROM l")
def prompt_lines(spark, sf_dir):
    return items(spark, sf_dir).select("cluster_id", "id", "line")


@query("prompt_batches", f"""WITH {LINES_SQL}
SELECT batch_id, concat('Classify these emails:', chr(10), chr(10),
  string_agg(concat(position, ') ', line), concat(chr(10), chr(10)) ORDER BY position)) AS prompt,
  string_agg(id, '|' ORDER BY position) AS expected_ids FROM l GROUP BY batch_id""")
def prompt_batches(spark, sf_dir):
    return scoring.batch_prompts(items(spark, sf_dir)).withColumn(
        "expected_ids", F.array_join("expected_ids", "|"))


@query("score_batches", f"""WITH {LINES_SQL},
h AS (SELECT batch_id, id, lower(line) AS txt FROM l),
c AS (SELECT batch_id, id, len(list_filter(['verify', 'urgent', 'expired', 'click here', 'bit.ly'],
  lambda w: contains(txt, w))) AS n FROM h)
SELECT batch_id, id, CASE WHEN n > 0 THEN 'BAD' ELSE 'GOOD' END AS label,
  round(least(1.0, 0.6 + 0.1 * n), 6)::DOUBLE AS confidence, concat(n, ' signals') AS reason FROM c""")
def score_batches(spark, sf_dir):
    prompts = scoring.batch_prompts(items(spark, sf_dir))
    answered = scoring.score_batches(prompts, wording_labeller)
    return scoring.parse_responses(answered).withColumn("confidence", F.round("confidence", 6))


# Answers with planted faults: one JSON item per message, one response per ten messages.
_ITEM = r"""concat('{{', CASE WHEN doc_id % 13 = 1 THEN '' WHEN doc_id % 13 = 7 THEN concat('"id": ', doc_id, ', ')
    WHEN doc_id % 130 = 38 THEN concat('<twice>"id": "m', doc_id, '", ')
    ELSE concat('"id": "m', doc_id, '", ') END,
  CASE WHEN doc_id % 70 = 12 THEN '"label": 5' WHEN doc_id % 13 = 0 THEN '"label": "maybe"'
    WHEN doc_id % 3 = 0 THEN '"label": "Good"' ELSE '"label": "bad"' END,
  CASE WHEN doc_id % 130 = 24 THEN ', "confidence": <nan>' WHEN doc_id % 130 = 76 THEN ', "confidence": <low>' ELSE '' END,
  CASE WHEN doc_id % 130 IN (24, 76) THEN '' ELSE CASE doc_id % 13 WHEN 2 THEN ', "confidence": "0.9"' WHEN 3 THEN ', "confidence": true' WHEN 4 THEN ', "confidence": 7.5'
    WHEN 6 THEN '' WHEN 8 THEN ', "confidence": -3' WHEN 9 THEN ', "confidence": null'
    ELSE concat(', "confidence": 0.', doc_id % 9 + 1) END END,
  CASE doc_id % 13 WHEN 6 THEN '' WHEN 9 THEN ', "reason": null' WHEN 10 THEN ', "reason": false'
    ELSE concat(', "reason": "from ', source, '"') END, '}}')"""
# Faults that strict JSON does not know: a repeated key, of which the last counts, and numbers beyond it.
_LOOSE = {"<twice>": '"id": "old", ', "<nan>": "NaN", "<low>": "-Infinity"}
_PLAIN_FORM = {"<twice>": "", "<nan>": "1.0", "<low>": "0.0"}


def _with(text, forms):
    for mark, form in forms.items():
        text = text.replace(mark, form)
    return text


_RESPONSE = r"""CASE batch_id % 6
  WHEN 0 THEN concat('```json', chr(10), '[', items, ']', chr(10), '```')
  WHEN 1 THEN concat('{{"results": [', items, ']}}')
  WHEN 2 THEN concat('[', items)
  WHEN 3 THEN concat(chr(10), '  [', items, ', "just text", 17, []]  ')
  ELSE concat('[', items, ']') END"""
_RESPONSES_SQL = f"""i AS (SELECT doc_id // 10 AS batch_id, doc_id, {_with(_ITEM, _PLAIN_FORM).replace('{{', '{').replace('}}', '}')} AS item FROM documents),
q AS (SELECT batch_id, string_agg(item, ', ' ORDER BY doc_id) AS items, list(concat('m', doc_id)) AS expected_ids FROM i GROUP BY batch_id),
a AS (SELECT batch_id, expected_ids, {_RESPONSE.replace('{{', '{').replace('}}', '}')} AS response FROM q),
b AS (SELECT batch_id, trim(regexp_replace(regexp_replace(trim(response, chr(10) || ' '), '^```json', ''), '```$', ''), chr(10) || ' ') AS txt FROM a),
n AS (SELECT batch_id, unnest(json_extract(txt, '$[*]')) AS item FROM b WHERE json_valid(txt) AND json_type(txt) = 'ARRAY'),
o AS (SELECT batch_id, item, json_type(item, '$.label') AS kind, json_type(item, '$.confidence') AS ckind, json_type(item, '$.reason') AS rkind FROM n
  WHERE json_type(item) = 'OBJECT' AND json_exists(item, '$.id') AND json_exists(item, '$.label')),
z AS (SELECT batch_id, json_extract_string(item, '$.id') AS id, upper(json_extract_string(item, '$.label')) AS label,
  CASE WHEN ckind = 'BOOLEAN' THEN CASE WHEN json_extract_string(item, '$.confidence') = 'true' THEN 1.0 ELSE 0.0 END
    WHEN ckind IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN greatest(0.0, least(1.0, json_extract_string(item, '$.confidence')::DOUBLE))
    ELSE 0.5 END::DOUBLE AS confidence,
  CASE WHEN rkind IS NULL THEN 'No reason provided' WHEN rkind = 'NULL' THEN 'None'
    WHEN rkind = 'BOOLEAN' THEN CASE WHEN json_extract_string(item, '$.reason') = 'true' THEN 'True' ELSE 'False' END
    ELSE json_extract_string(item, '$.reason') END AS reason
  FROM o WHERE batch_id NOT IN (SELECT batch_id FROM o WHERE kind <> 'VARCHAR')
    AND lower(json_extract_string(item, '$.label')) IN ('good', 'bad'))"""


def responses(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    items = spark.sql(f"SELECT doc_id div 10 AS batch_id, doc_id, {_with(_ITEM, _LOOSE)} AS item FROM {{documents}}",
                      documents=documents)
    grouped = items.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("doc_id", "item"))).alias("rows"))
    joined = grouped.select(
        "batch_id", F.array_join(F.transform("rows", lambda r: r["item"]), ", ").alias("items"),
        F.transform("rows", lambda r: F.concat(F.lit("m"), r["doc_id"].cast("string"))).alias("expected_ids"))
    return spark.sql(f"SELECT batch_id, expected_ids, {_RESPONSE} AS response FROM {{joined}}", joined=joined)


@query("response_parse", f"WITH {_RESPONSES_SQL} SELECT batch_id, id, label, round(confidence, 6) AS confidence, reason FROM z")
def response_parse(spark, sf_dir):
    return scoring.parse_responses(responses(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query("missing_ids", f"""WITH {_RESPONSES_SQL}, x AS (SELECT batch_id, unnest(expected_ids) AS id FROM a)
SELECT batch_id, id FROM x WHERE (batch_id, id) NOT IN (SELECT (batch_id, id) FROM z)""")
def missing_ids(spark, sf_dir):
    answered = responses(spark, sf_dir)
    return scoring.missing_ids(answered, scoring.parse_responses(answered))


# Every message belongs to the cluster of its ten; the answer to the first of them, item m<doc_id>, is spread.
@query("propagate_labels", f"""WITH {_RESPONSES_SQL},
k AS (SELECT z.*, TRY_CAST(substring(id, 2) AS BIGINT) AS doc FROM z WHERE id LIKE 'm%'),
f AS (SELECT doc AS cluster_id, label, confidence, reason FROM k),
m AS (SELECT doc_id AS email_id, doc_id // 10 * 10 AS cluster_id FROM documents)
SELECT email_id, f.label, round(confidence * 0.9, 6)::DOUBLE AS confidence,
  concat('Propagated from cluster ', cluster_id, ': ', reason) AS reason, 'llm_propagated' AS source
FROM m JOIN f USING (cluster_id)""")
def propagate_labels(spark, sf_dir):
    found = scoring.parse_responses(responses(spark, sf_dir))
    ids = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("cluster_id"))
    tens = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("email_id"), F.expr("doc_id DIV 10 * 10").alias("cluster_id"))
    return scoring.propagate(found, ids, tens).withColumn(
        "confidence", F.round("confidence", 6))

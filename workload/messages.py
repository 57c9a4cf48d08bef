"""Field derivation, rule tier and numeric features over the derived messages."""

from pyspark.sql import functions as F

from tiersift import constants as K
from tiersift.functions import fields
from tiersift.operators import features, rules
from workload.fixtures import emails, message_parts
from workload.registry import query
from workload.sqlbase import alternatives, hits, over_emails, over_rules, quoted


def _list(column):
    return F.array_join(F.array_sort(column), "|")


@query("parse_fields", over_emails("""
SELECT email_id, snippet, url_count, content_length, has_html, from_hdr, subject,
  array_to_string(url_domains, '|') AS url_domains FROM e"""))
def parse_fields(spark, sf_dir):
    return emails(spark, sf_dir).select(
        "email_id", "snippet", "url_count", "content_length", "has_html", "from_hdr", "subject",
        _list("url_domains").alias("url_domains"))


@query("extract_urls", over_emails(
    "SELECT email_id, array_to_string(urls, '|') AS urls, url_count FROM e"))
def extract_urls(spark, sf_dir):
    return emails(spark, sf_dir).select("email_id", _list("urls").alias("urls"), "url_count")


@query("url_domains", f"""
WITH u AS (SELECT page_id, list_distinct(list_concat([url],
  regexp_extract_all(html, {quoted(K.URL_PATTERN)}, 0))) AS urls FROM pages)
SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(urls,
  lambda u: lower(regexp_extract(u, {quoted(K.NETLOC_PATTERN)}, 1))), lambda d: d <> ''))), '|') AS url_domains
FROM u""")
def url_domains(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = F.concat(F.array("url"), fields.urls(F.col("html")))
    return pages.select("page_id", _list(fields.url_domains(urls)).alias("url_domains"))


@query("sender_domain", over_emails("SELECT email_id, from_hdr, sender_domain FROM e"))
def sender_domain(spark, sf_dir):
    return emails(spark, sf_dir).select("email_id", "from_hdr", "sender_domain")


_AUTH_HEADER = ("concat('mx; SPF=', CASE WHEN spf_pass THEN 'Pass' ELSE 'fail' END, '; dkim=', "
                "CASE WHEN dkim_pass THEN 'pass' ELSE 'none' END, '; dmarc=', "
                "CASE WHEN dmarc_pass THEN 'pass' ELSE 'fail' END)")


@query("auth_flags", over_emails(f"""
SELECT email_id, {_AUTH_HEADER} AS auth_hdr, spf_pass, dkim_pass, dmarc_pass FROM e"""))
def auth_flags(spark, sf_dir):
    header = message_parts(spark, sf_dir).select("email_id", F.expr(_AUTH_HEADER).alias("auth_hdr"))
    return header.select("email_id", "auth_hdr", *[
        fields.auth_passed(F.col("auth_hdr"), m).alias(f"{m}_pass") for m in ("spf", "dkim", "dmarc")])


@query("fingerprint", over_emails("SELECT email_id, fingerprint FROM e"))
def fingerprint(spark, sf_dir):
    return emails(spark, sf_dir).select("email_id", "fingerprint")


@query("embed_text_tagged", over_emails("""
SELECT email_id, concat_ws(' | ',
  CASE WHEN subject <> '' THEN concat('Subject: ', subject) END,
  CASE WHEN snippet <> '' THEN concat('Content: ', snippet) END,
  CASE WHEN sender_domain <> '' THEN concat('From: ', sender_domain) END,
  CASE WHEN len(url_domains) > 0 THEN concat('URLs: ', array_to_string(url_domains[1:5], ', ')) END) AS txt
FROM e"""))
def embed_text_tagged(spark, sf_dir):
    return emails(spark, sf_dir).select("email_id", fields.embedding_text_tagged().alias("txt"))


@query("embed_text_plain", over_emails("""
SELECT email_id, concat_ws(' ', nullif(subject, ''), nullif(snippet, ''), nullif(sender_domain, '')) AS txt
FROM e"""))
def embed_text_plain(spark, sf_dir):
    return emails(spark, sf_dir).select("email_id", fields.embedding_text_plain().alias("txt"))


def _flag(name, column):
    @query(f"rule_{name}", over_rules(f"SELECT email_id, {column} AS fires FROM r"))
    def run(spark, sf_dir):
        return rules.score(emails(spark, sf_dir)).select(
            "email_id", F.col(f"risk_factors.{column}").alias("fires"))


for _name, _column in {"domain_mismatch": "domain_mismatch", "auth_failure": "auth_failure",
                       "urgent": "urgent_language", "headers": "suspicious_headers"}.items():
    _flag(_name, _column)


@query("rule_keywords", over_rules(f"""
SELECT email_id, phishing_keywords AS fires, array_to_string(list_filter([{', '.join(
    quoted(k) for k in K.PHISHING_KEYWORDS)}], lambda k: contains(txt, k)), '|') AS found FROM r"""))
def rule_keywords(spark, sf_dir):
    return rules.rule_inputs(emails(spark, sf_dir)).select(
        "email_id", (rules.keyword_hits() >= 2).alias("fires"),
        F.array_join(rules.keywords_found(), "|").alias("found"))


@query("rule_suspicious_urls", over_rules(f"""
SELECT email_id, suspicious_urls AS fires, array_to_string(flatten(list_transform(url_domains,
  lambda d: list_transform(list_filter([{', '.join(quoted('(?i)' + p) for p in K.SUSPICIOUS_DOMAINS)}],
    lambda p: regexp_matches(d, p)), lambda p: d))), '|') AS found FROM r"""))
def rule_suspicious_urls(spark, sf_dir):
    return rules.rule_inputs(emails(spark, sf_dir)).select(
        "email_id", rules.suspicious_urls().alias("fires"),
        F.array_join(rules.suspicious_urls_found(), "|").alias("found"))


@query("rule_trusted", over_rules("SELECT email_id, is_trusted_domain AS fires FROM r"))
def rule_trusted(spark, sf_dir):
    return rules.score(emails(spark, sf_dir)).select("email_id", F.col("is_trusted_domain").alias("fires"))


@query("rule_scores", over_rules("SELECT email_id, risk_score, strong_bad_indicators FROM r"))
def rule_scores(spark, sf_dir):
    return rules.score(emails(spark, sf_dir)).select("email_id", "risk_score", "strong_bad_indicators")


_FACTORS = ["domain_mismatch", "phishing_keywords", "suspicious_urls", "auth_failure",
            "urgent_language", "suspicious_headers"]


@query("rules_classify", over_rules(f"""
SELECT email_id, fingerprint, label, round(confidence, 6) AS confidence, 'rules' AS source,
  risk_score, {', '.join(_FACTORS)}, is_trusted_domain, strong_bad_indicators FROM r"""))
def rules_classify(spark, sf_dir):
    return rules.classify(emails(spark, sf_dir)).select(
        "email_id", "fingerprint", "label", F.round("confidence", 6).alias("confidence"), "source",
        "context.risk_score", *[f"context.risk_factors.{f}" for f in _FACTORS],
        "context.is_trusted_domain", "context.strong_bad_indicators")


@query("rules_custom", over_rules("""
SELECT email_id, risk_score + 2 * (content_length > 2000)::BIGINT AS risk_score,
  CASE WHEN strong_bad_indicators >= 2 OR risk_score + 2 * (content_length > 2000)::BIGINT >= 5 THEN 'BAD'
    WHEN is_trusted_domain AND risk_score + 2 * (content_length > 2000)::BIGINT <= 1 THEN 'GOOD'
    ELSE 'UNKNOWN' END AS label FROM r"""))
def rules_custom(spark, sf_dir):
    extended = rules.default_rules().add("long_body", 2, F.col("content_length") > 2000)
    return rules.classify(emails(spark, sf_dir), extended).select(
        "email_id", "context.risk_score", "label")


@query("label_counts", over_rules("SELECT label, count(*) AS n FROM r GROUP BY label"))
def label_counts(spark, sf_dir):
    return rules.classify(emails(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("n"))


@query("tier_unknown", over_rules(
    "SELECT email_id, fingerprint, subject FROM r WHERE label = 'UNKNOWN'"))
def tier_unknown(spark, sf_dir):
    messages = emails(spark, sf_dir)
    return rules.undecided(messages, rules.classify(messages)).select(
        "email_id", "fingerprint", "subject")


FEATURES_SQL = f"""f AS (SELECT email_id, label,
  length(subject)::DOUBLE AS subject_length, length(snippet)::DOUBLE AS snippet_length,
  length(body)::DOUBLE AS body_length, len(urls)::DOUBLE AS url_count,
  len(url_domains)::DOUBLE AS url_domain_count, (len(urls) > 0)::INT::DOUBLE AS has_urls,
  spf_pass::INT::DOUBLE AS spf_pass, dkim_pass::INT::DOUBLE AS dkim_pass, dmarc_pass::INT::DOUBLE AS dmarc_pass,
  (spf_pass::INT + dkim_pass::INT + dmarc_pass::INT)::DOUBLE AS auth_score, has_html::INT::DOUBLE AS has_html,
  length(snippet)::DOUBLE / greatest(length(body), 1) AS content_ratio,
  length(sender_domain)::DOUBLE AS domain_length, (sender_domain <> '')::INT::DOUBLE AS has_domain,
  {hits('txt', K.FEATURE_KEYWORDS)}::DOUBLE AS suspicious_keyword_count,
  (length(txt) - length(replace(txt, '!', '')))::DOUBLE AS exclamation_count,
  len(regexp_extract_all(txt, '\\p{{Lu}}'))::DOUBLE / greatest(length(txt), 1) AS caps_ratio,
  len(regexp_extract_all(txt, '[0-9]+'))::DOUBLE AS number_count FROM r)"""


@query("features", over_rules("").rstrip() + f""", {FEATURES_SQL}
SELECT email_id, {', '.join(f'round({n}, 6) AS {n}' for n in K.FEATURE_NAMES)},
  round(url_count / body_length, 6) AS links_per_character FROM f""")
def numeric_features(spark, sf_dir):
    extra = {"links_per_character": F.size("urls") / F.length("body")}
    table = features.numeric_features(emails(spark, sf_dir), extra)
    return table.select("email_id", *[F.round(n, 6).alias(n) for n in table.columns if n != "email_id"])

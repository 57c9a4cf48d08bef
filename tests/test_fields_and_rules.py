import hashlib

from pyspark.sql import functions as F

from tiersift import constants as K
from tiersift.functions import fields
from tiersift.functions.html import squeezed, text_nodes
from tiersift.operators import features, rules, text_vectors


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_urls_stop_at_characters_outside_the_pattern(spark):
    text = 'see HTTP://A.com/x?a=1#frag "https://b.org/y" (http://c.net/z), http://d.io/é http://A.com/x?a=1'
    assert one(spark, fields.urls(F.col("t")), t=text) == [
        "HTTP://A.com/x?a=1", "http://A.com/x?a=1", "http://c.net/z),", "http://d.io/", "https://b.org/y"]


def test_url_domains_keep_user_and_port_and_drop_broken_brackets(spark):
    urls = ["http://User@Host.com:80/x", "http://a]b/", "https://[::1]:8/", "http:///only"]
    found = spark.range(1).select(fields.url_domains(F.array(*map(F.lit, urls))).alias("d")).first()["d"]
    assert found == ["[::1]:8", "user@host.com:80"]


def test_sender_domain(spark):
    cases = {"A <x@Y.com>": "y.com", "x@sub.Z.org": "sub.z.org", "<a@b@c.com>": "b@c.com", "nobody": "", "": ""}
    for header, domain in cases.items():
        assert one(spark, fields.sender_domain(F.col("h")), h=header) == domain


def test_fingerprint_matches_a_plain_md5(spark, make_emails):
    df = make_emails({"from_hdr": "A <a@b.c>", "subject": "s", "snippet": "x" * 300,
                      "url_domains": ["o'neil.com", "b\\c.com", "a.com"]})
    shown = "[" + ", ".join(repr(d) for d in sorted(["o'neil.com", "b\\c.com", "a.com"])) + "]"
    want = hashlib.md5("|".join(["A <a@b.c>", "s", "x" * 200, shown]).encode()).hexdigest()
    assert df.select(fields.fingerprint().alias("f")).first()["f"] == want


def fired(df, match="loose"):
    rows = rules.score(df, rules.default_rules(match)).orderBy("email_id").collect()
    return [({k for k, v in r["risk_factors"].asDict().items() if v}, r["is_trusted_domain"]) for r in rows]


def test_each_rule_on_its_edges(make_emails):
    df = make_emails(
        {"from_hdr": "bob@bank.com <x@evil.com>", "sender_domain": "evil.com"},
        {"from_hdr": "paypal@evil.com <x@evil.com>", "sender_domain": "evil.com"},
        {"from_hdr": "Apple Store <x@pineapple.com>", "sender_domain": "pineapple.com"},
        {"subject": "Gift Card", "snippet": "invoice"},
        {"subject": "invoice invoice"},
        {"url_domains": ["reddit.com"]},
        {"spf_pass": None, "dkim_pass": None, "dmarc_pass": False},
        {"subject": "It EXPIRES today"}, {"subject": "expiresoon"},
        {"from_hdr": "No-Reply at x"}, {"from_hdr": "José"}, {"from_hdr": None, "subject": None, "snippet": None})
    got = fired(df)
    assert got[0] == ({"domain_mismatch", "suspicious_headers"}, False)
    assert got[1] == ({"suspicious_headers"}, False)  # the display domain ends the evaluation
    assert got[2] == ({"suspicious_headers"}, True)   # unanchored trusted pattern
    assert got[3][0] == {"phishing_keywords"} and got[4][0] == set()
    assert got[5][0] == {"suspicious_urls"}           # dots of the shortener patterns are live
    assert got[6][0] == {"auth_failure"}
    assert got[7][0] == {"urgent_language"} and got[8][0] == set()
    assert got[9][0] == {"suspicious_headers"} and got[10][0] == {"suspicious_headers"}
    assert got[11][0] == set()
    anchored = fired(df, "suffix")
    assert anchored[2][1] is False and anchored[5][0] == set()


def test_labels_and_confidence(make_emails):
    df = make_emails(
        {"url_domains": ["bit.ly"], "spf_pass": False, "dkim_pass": False, "dmarc_pass": False},
        {"sender_domain": "gmail.com"}, {"sender_domain": "example.org"})
    rows = rules.classify(df).orderBy("email_id").collect()
    assert [(r["label"], round(r["confidence"], 6)) for r in rows] == [
        ("BAD", 0.95), ("GOOD", 0.9), ("UNKNOWN", 0.5)]
    assert rows[0]["context"]["strong_bad_indicators"] == 2


def test_rule_regexes_are_not_repeated_by_a_filter_on_the_label(make_emails):
    plan = rules.classify(make_emails({})).filter("label = 'BAD'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("donotreply") == 1


def test_features_follow_the_fixed_order(make_emails):
    df = features.numeric_features(make_emails({"subject": "Act! NOW 12 3", "snippet": "verify", "body": "verify me"}))
    assert df.columns == ["email_id", *K.FEATURE_NAMES]
    r = df.first()
    assert (r["exclamation_count"], r["number_count"], r["suspicious_keyword_count"], r["caps_ratio"]) == (1, 2, 1, 0)
    assert round(r["content_ratio"], 6) == round(6 / 9, 6)


def test_terms_of_short_texts(spark):
    def terms(text):
        return text_vectors.with_terms(spark.range(1), F.lit(text)).first()["terms"]
    assert terms("") == [] and terms("a I x") == [] and terms("Alpha") == ["alpha"]
    assert terms("red the blue_1 x été") == ["red", "blue_1", "été", "red blue_1", "blue_1 été"]


def test_html_text(spark):
    page = "<html><!DOCTYPE x><title>T</title><script>if (a<b) '</p>'</script><p>one<b>two</b> &amp; three</p><!-- no --></html>"
    assert text_nodes(page) == "Tonetwo & three"
    assert one(spark, squeezed(F.col("t")), t="\n  a b  \r\n\n c   d  e  ") == "a b c d e"

"""Weighted rule tier: named boolean columns, a score, a label. One projection, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersift import constants as K
from tiersift.functions.fields import classifier_text, flag, strings, text
from tiersift.runtime import compute_once

RULE_TEXT = "rule_text"        # lower-cased subject and snippet, available to every rule
DISPLAY_NAME = "rule_display"  # lower-cased display name of the From header
LINK_HOSTS = "rule_hosts"      # link domains, one per line


def _any_of(patterns: list[str]) -> str:
    return "(?i)" + "|".join(dict.fromkeys(patterns))


def _suffix_of(domains: list[str]) -> str:
    return r"(?i)(^|\.)(" + "|".join(d.replace(".", r"\.") for d in dict.fromkeys(domains)) + ")$"


def domain_mismatch() -> Column:
    shown, domain = F.col(DISPLAY_NAME), text("sender_domain")
    claimed = F.regexp_extract(shown, K.DISPLAY_DOMAIN_PATTERN, 1)
    imitates = reduce(or_, [F.contains(shown, F.lit(c)) & ~F.contains(domain, F.lit(c))
                            for c in K.IMITATED_COMPANIES])
    return (F.when((shown == "") | (domain == ""), F.lit(False))
            .when(claimed != "", claimed != domain)
            .otherwise(imitates))


def keyword_hits() -> Column:
    return reduce(add, [F.contains(F.col(RULE_TEXT), F.lit(k)).cast("int")
                        for k in K.PHISHING_KEYWORDS])


def keywords_found() -> Column:
    return F.array_compact(F.array(*[
        F.when(F.contains(F.col(RULE_TEXT), F.lit(k)), F.lit(k)) for k in K.PHISHING_KEYWORDS]))


def suspicious_urls(match: str = "loose") -> Column:
    if match == "suffix":
        pattern = _suffix_of(K.SUSPICIOUS_DOMAINS)
        return F.exists(strings("url_domains"), lambda d: F.rlike(d, F.lit(pattern)))
    return F.col(LINK_HOSTS).rlike(_any_of(K.SUSPICIOUS_DOMAINS))


def suspicious_urls_found() -> Column:
    """One entry per (domain, matching pattern), as the list form reports it."""
    return F.flatten(F.transform(strings("url_domains"), lambda d: F.array_compact(F.array(*[
        F.when(F.rlike(d, F.lit("(?i)" + p)), d) for p in K.SUSPICIOUS_DOMAINS]))))


def auth_failure() -> Column:
    return ~(flag("spf_pass") | flag("dkim_pass") | flag("dmarc_pass"))


def trusted_sender(match: str = "loose") -> Column:
    pattern = _suffix_of(K.TRUSTED_DOMAINS) if match == "suffix" else _any_of(K.TRUSTED_DOMAINS)
    return text("sender_domain").rlike(pattern)


def urgent_language() -> Column:
    return F.col(RULE_TEXT).rlike("|".join(K.URGENT_PATTERNS))


def suspicious_headers() -> Column:
    return text("from_hdr").rlike("(?i)" + "|".join(K.ODD_HEADER_PATTERNS))


@dataclass(frozen=True)
class Rule:
    name: str
    weight: int
    fires: Column
    strong: bool = False


@dataclass(frozen=True)
class RuleSet:
    """An ordered list of rules; ``add`` returns a longer list."""

    rules: tuple[Rule, ...]
    trusted: Column
    strong_cut: int = 2
    score_cut: int = 5
    clean_cut: int = 1

    def add(self, name: str, weight: int, fires: Column, strong: bool = False) -> RuleSet:
        return RuleSet(self.rules + (Rule(name, weight, fires, strong),), self.trusted,
                       self.strong_cut, self.score_cut, self.clean_cut)


def default_rules(match: str = "loose") -> RuleSet:
    """``match='loose'`` keeps the domain patterns unanchored, ``'suffix'`` anchors them."""
    return RuleSet((
        Rule("domain_mismatch", 3, domain_mismatch(), strong=True),
        Rule("phishing_keywords", 2, keyword_hits() >= 2, strong=True),
        Rule("suspicious_urls", 2, suspicious_urls(match), strong=True),
        Rule("auth_failure", 2, auth_failure(), strong=True),
        Rule("urgent_language", 1, urgent_language()),
        Rule("suspicious_headers", 1, suspicious_headers()),
    ), trusted_sender(match))


def rule_inputs(emails: DataFrame) -> DataFrame:
    """Adds the columns several rules share, so each is computed once per row."""
    return emails.withColumns({
        RULE_TEXT: F.lower(classifier_text()),
        DISPLAY_NAME: F.lower(F.trim(
            F.regexp_extract(text("from_hdr"), K.DISPLAY_NAME_PATTERN, 1))),
        LINK_HOSTS: F.array_join(strings("url_domains"), "\n"),
    })


def score(emails: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """Input columns plus ``risk_factors``, ``risk_score``, ``strong_bad_indicators`` and trust."""
    rules = rules or default_rules()
    fired = compute_once(rule_inputs(emails), {
        f"_fires_{r.name}": r.fires for r in rules.rules} | {"is_trusted_domain": rules.trusted})

    def count(selected):
        return reduce(add, selected, F.lit(0)).cast("long")

    return (fired.withColumns({
        "risk_score": count(F.col(f"_fires_{r.name}").cast("int") * r.weight for r in rules.rules),
        "strong_bad_indicators": count(
            F.col(f"_fires_{r.name}").cast("int") for r in rules.rules if r.strong),
        "risk_factors": F.struct(*[F.col(f"_fires_{r.name}").alias(r.name) for r in rules.rules]),
    }).drop(RULE_TEXT, DISPLAY_NAME, LINK_HOSTS, *[f"_fires_{r.name}" for r in rules.rules]))


def classify(emails: DataFrame, rules: RuleSet | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rule results: ``email_id, fingerprint, label, confidence, source, context`` (+ ``keep``)."""
    rules = rules or default_rules()
    risk = F.col("risk_score")
    bad = (F.col("strong_bad_indicators") >= rules.strong_cut) | (risk >= rules.score_cut)
    good = F.col("is_trusted_domain") & (risk <= rules.clean_cut)
    labelled = score(emails, rules).withColumn(
        "label", F.when(bad, "BAD").when(good, "GOOD").otherwise("UNKNOWN"))
    return labelled.select(
        "email_id", "fingerprint", "label",
        F.when(F.col("label") == "BAD", F.least(F.lit(0.95), F.lit(0.6) + risk * F.lit(0.1)))
        .when(F.col("label") == "GOOD", F.lit(0.9)).otherwise(F.lit(0.5)).alias("confidence"),
        F.lit("rules").alias("source"),
        F.struct("risk_score", "risk_factors", "is_trusted_domain",
                 "strong_bad_indicators").alias("context"),
        *keep)


def undecided(emails: DataFrame, results: DataFrame) -> DataFrame:
    """E-mails the given results leave UNKNOWN."""
    open_ids = results.filter(F.col("label") == "UNKNOWN").select("email_id")
    return emails.join(open_ids, "email_id", "left_semi")

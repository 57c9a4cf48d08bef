"""Columns derived from message headers and body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersift import constants as K
from tiersift.runtime import compute_once


def text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def strings(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def snippet(body: Column) -> Column:
    return F.substring(body, 1, K.SNIPPET_LENGTH)


def classifier_text() -> Column:
    return F.concat(text("subject"), F.lit(" "), text("snippet"))


def urls(body: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(K.URL_PATTERN), 0)))


def url_domain(url: Column) -> Column:
    """Lower-cased authority part; empty when brackets do not form an IP literal."""
    host = F.lower(F.regexp_extract(url, K.NETLOC_PATTERN, 1))
    bracketed = F.contains(host, F.lit("[")) | F.contains(host, F.lit("]"))
    valid = host.rlike(r"^([^\[\]]*@)?\[[0-9a-f:.]+\](:[^\[\]]*)?$")
    return F.when(bracketed & ~valid, F.lit("")).otherwise(host)


def url_domains(url_list: Column) -> Column:
    hosts = F.transform(url_list, url_domain)
    return F.array_sort(F.array_distinct(F.filter(hosts, lambda h: h != "")))


def sender_domain(header: Column) -> Column:
    angle = F.regexp_extract(header, K.ANGLE_ADDRESS_PATTERN, 1)
    bare = F.regexp_extract(header, K.BARE_ADDRESS_PATTERN, 1)
    address = F.coalesce(F.nullif(angle, F.lit("")), bare)
    return F.lower(F.regexp_extract(address, K.ADDRESS_DOMAIN_PATTERN, 1))


def auth_passed(header: Column, method: str) -> Column:
    return F.contains(F.lower(F.coalesce(header, F.lit(""))), F.lit(f"{method}=pass"))


def _shown_as_list(domains: Column) -> Column:
    def shown(d: Column) -> Column:
        escaped = F.replace(d, F.lit("\\"), F.lit("\\\\"))
        quote = F.when(F.contains(d, F.lit("'")), F.lit('"')).otherwise(F.lit("'"))
        return F.concat(quote, escaped, quote)

    return F.concat(F.lit("["), F.array_join(F.transform(domains, shown), ", "), F.lit("]"))


def fingerprint() -> Column:
    """Content key over From, subject, the head of the snippet and the sorted link domains."""
    return F.md5(F.concat_ws(
        "|", text("from_hdr"), text("subject"),
        F.substring(text("snippet"), 1, K.FINGERPRINT_SNIPPET_LENGTH),
        _shown_as_list(F.array_sort(strings("url_domains")))))


def derive_fields(parts: DataFrame) -> DataFrame:
    """Complete records that carry headers, body and auth flags with every derived column.

    Narrow all the way: no shuffle, and the URL regex runs once per body.
    """
    found = compute_once(parts, {"urls": urls(text("body")),
                                 "sender_domain": sender_domain(text("from_hdr"))})
    hosts = compute_once(found, {"url_domains": url_domains(F.col("urls"))})
    return hosts.withColumns({
        "snippet": snippet(text("body")),
        "has_html": flag("has_html"),
        "content_length": F.length(text("body")).cast("long"),
        "url_count": F.size("urls").cast("long"),
    }).withColumn("fingerprint", fingerprint())


def embedding_text_tagged() -> Column:
    def tagged(tag: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(tag), value))

    domains = F.slice(F.array_sort(strings("url_domains")), 1, K.PREVIEW_DOMAINS)
    return F.concat_ws(
        " | ", tagged("Subject: ", text("subject")), tagged("Content: ", text("snippet")),
        tagged("From: ", text("sender_domain")),
        tagged("URLs: ", F.array_join(domains, ", ")))


def embedding_text_plain() -> Column:
    return F.concat_ws(" ", *[F.nullif(text(c), F.lit(""))
                              for c in ("subject", "snippet", "sender_domain")])


def prompt_line(item_id: Column) -> Column:
    body = text("snippet")
    shown = F.when(F.length(body) > K.PROMPT_SNIPPET_LENGTH, F.concat(
        F.substring(body, 1, K.PROMPT_SNIPPET_LENGTH), F.lit("..."))).otherwise(body)
    domains = F.array_sort(strings("url_domains"))
    return F.concat(
        F.lit("id:"), item_id,
        F.lit(" | from:'"), text("from_hdr"), F.lit("' | subject:'"), text("subject"),
        F.lit("' | snippet:'"), shown, F.lit("'"),
        F.when(F.size(domains) > 0, F.concat(
            F.lit(" | url_domains:"),
            _shown_as_list(F.slice(domains, 1, K.PREVIEW_DOMAINS)))).otherwise(F.lit("")),
        F.when(text("sender_domain") != "", F.concat(
            F.lit(" | sender_domain:'"), text("sender_domain"), F.lit("'")))
        .otherwise(F.lit("")))

"""Common table expressions the equivalent SQL builds on."""

from __future__ import annotations

from tiersift import constants as K
from workload.fixtures import message_sql


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return ", ".join(quoted(v) for v in values)


def hits(column: str, words) -> str:
    return "(" + " + ".join(
        f"CAST(contains({column}, {quoted(w)}) AS BIGINT)" for w in words) + ")"


def alternatives(patterns) -> str:
    return quoted("(?i)" + "|".join(dict.fromkeys(patterns)))


FINGERPRINT = r"""md5(concat(from_hdr, '|', subject, '|', substring(snippet, 1, 200), '|[',
  array_to_string(list_transform(url_domains, lambda d: concat(
    CASE WHEN contains(d, '''') THEN '"' ELSE '''' END, replace(d, '\', '\\'),
    CASE WHEN contains(d, '''') THEN '"' ELSE '''' END)), ', '), ']'))"""

# e: every derived column of the message table.
EMAILS = f"""
m AS ({message_sql('documents', duckdb=True)}),
m1 AS (SELECT *, substring(body, 1, {K.SNIPPET_LENGTH}) AS snippet,
  list_sort(list_distinct(regexp_extract_all(body, {quoted(K.URL_PATTERN)}, 0))) AS urls,
  CASE WHEN regexp_extract(from_hdr, {quoted(K.ANGLE_ADDRESS_PATTERN)}, 1) <> ''
    THEN regexp_extract(from_hdr, {quoted(K.ANGLE_ADDRESS_PATTERN)}, 1)
    ELSE regexp_extract(from_hdr, {quoted(K.BARE_ADDRESS_PATTERN)}, 1) END AS address,
  CAST(length(body) AS BIGINT) AS content_length FROM m),
m2 AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(urls,
    lambda u: lower(regexp_extract(u, {quoted(K.NETLOC_PATTERN)}, 1))), lambda d: d <> ''))) AS url_domains,
  lower(regexp_extract(address, '@([^\\n]+)', 1)) AS sender_domain,
  CAST(len(urls) AS BIGINT) AS url_count FROM m1),
e AS (SELECT * EXCLUDE (address), {FINGERPRINT} AS fingerprint FROM m2)
""".replace("\\\\n", "\\n")

# r: rule flags, score, label and confidence of every message.
_DISPLAY = f"lower(trim(regexp_extract(from_hdr, {quoted(K.DISPLAY_NAME_PATTERN)}, 1)))"
_CLAIMED = f"regexp_extract(display, {quoted(K.DISPLAY_DOMAIN_PATTERN)}, 1)"
_IMITATES = " OR ".join(
    f"(contains(display, '{c}') AND NOT contains(sender_domain, '{c}'))"
    for c in K.IMITATED_COMPANIES)
RULES = EMAILS + f""",
r0 AS (SELECT *, lower(concat(subject, ' ', snippet)) AS txt, {_DISPLAY} AS display FROM e),
r1 AS (SELECT *,
  CASE WHEN display = '' OR sender_domain = '' THEN false
       WHEN {_CLAIMED} <> '' THEN {_CLAIMED} <> sender_domain
       ELSE ({_IMITATES}) END AS domain_mismatch,
  {hits('txt', K.PHISHING_KEYWORDS)} AS keyword_hits,
  len(list_filter(url_domains, lambda d: regexp_matches(d, {alternatives(K.SUSPICIOUS_DOMAINS)}))) > 0 AS suspicious_urls,
  NOT (spf_pass OR dkim_pass OR dmarc_pass) AS auth_failure,
  regexp_matches(sender_domain, {alternatives(K.TRUSTED_DOMAINS)}) AS is_trusted_domain,
  regexp_matches(txt, {quoted('|'.join(K.URGENT_PATTERNS))}) AS urgent_language,
  regexp_matches(from_hdr, {alternatives(K.ODD_HEADER_PATTERNS)}) AS suspicious_headers FROM r0),
r2 AS (SELECT *, keyword_hits >= 2 AS phishing_keywords,
  CAST(3 * domain_mismatch::INT + 2 * (keyword_hits >= 2)::INT + 2 * suspicious_urls::INT
    + 2 * auth_failure::INT + urgent_language::INT + suspicious_headers::INT AS BIGINT) AS risk_score,
  CAST(domain_mismatch::INT + (keyword_hits >= 2)::INT + suspicious_urls::INT
    + auth_failure::INT AS BIGINT) AS strong_bad_indicators FROM r1),
r AS (SELECT *, CASE WHEN strong_bad_indicators >= 2 OR risk_score >= 5 THEN 'BAD'
    WHEN is_trusted_domain AND risk_score <= 1 THEN 'GOOD' ELSE 'UNKNOWN' END AS label,
  CASE WHEN strong_bad_indicators >= 2 OR risk_score >= 5 THEN least(0.95, 0.6 + risk_score * 0.1)
    WHEN is_trusted_domain AND risk_score <= 1 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM r2)
"""


def over_emails(select: str) -> str:
    return f"WITH {EMAILS} {select}"


def over_rules(select: str) -> str:
    return f"WITH {RULES} {select}"

"""Messages and tiers that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiersift.functions.fields import derive_fields
from tiersift.runtime import spread

# Headers, body and authentication flags of one message per document. The same text is valid in
# Spark SQL and in DuckDB after the replacements in ``message_sql``.
_MESSAGE_SQL = r"""
SELECT doc_id AS email_id,
  concat('mail/', CAST(doc_id AS STRING), '.eml') AS file_path,
  CASE doc_id % 5
    WHEN 0 THEN concat('PayPal Support <help@', source, '.example.com>')
    WHEN 1 THEN 'Alice <alice@gmail.com>'
    WHEN 2 THEN concat('bob@bank.com <no-reply@', source, '.example.net>')
    WHEN 3 THEN concat('billing@', source, '.example.org')
    ELSE 'José Núñez <jose@microsoft.com>' END AS from_hdr,
  'team@example.com' AS to_hdr,
  concat(CASE doc_id % 7
    WHEN 0 THEN 'URGENT: verify your account, click here '
    WHEN 1 THEN 'Invoice expired '
    WHEN 2 THEN 'Act now - limited time! ' ELSE '' END,
    trim(regexp_replace(substring(text, 1, 60), '[ \t\r\n]+', ' '{global}))) AS subject,
  'Mon, 01 Jan 2024 00:00:00 +0000' AS date_hdr,
  concat('<', CAST(doc_id AS STRING), '@example.com>') AS message_id,
  concat(text, CASE doc_id % 6
    WHEN 0 THEN concat(' http://bit.ly/', CAST(doc_id AS STRING))
    WHEN 1 THEN ' https://www.microsoft.com/a?id=1#top'
    WHEN 2 THEN ' http://Shop.Example.com/x http://shop.example.com/y' ELSE '' END) AS body,
  doc_id % 2 = 0 AS spf_pass, doc_id % 3 = 0 AS dkim_pass, doc_id % 4 = 0 AS dmarc_pass,
  doc_id % 10 = 9 AS has_html
FROM {table}
"""


def message_sql(table: str, duckdb: bool) -> str:
    return _MESSAGE_SQL.format(table=table, **{"global": ", 'g'" if duckdb else ""})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return spark.sql(message_sql("{documents}", duckdb=False), documents=documents)


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_fields(message_parts(spark, sf_dir))

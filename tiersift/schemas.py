"""Declared table schemas."""

from pyspark.sql import types as T

_S, _B, _L, _D = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType()
_A = T.ArrayType(T.StringType())


def _table(*fields):
    return T.StructType([T.StructField(n, t) for n, t in fields])


RAW_MESSAGE = _table(("path", _S), ("modificationTime", T.TimestampType()),
                     ("length", _L), ("content", T.BinaryType()))

# What leaves the message parser: everything else is derived with Column expressions.
PARSED_PARTS = _table(
    ("email_id", _S), ("file_path", _S), ("from_hdr", _S), ("to_hdr", _S), ("subject", _S),
    ("date_hdr", _S), ("message_id", _S), ("auth_hdr", _S), ("body", _S), ("has_html", _B),
    ("corrupt", _S))

EMAIL = _table(
    ("email_id", _L), ("file_path", _S), ("from_hdr", _S), ("to_hdr", _S), ("subject", _S),
    ("date_hdr", _S), ("message_id", _S), ("sender_domain", _S), ("snippet", _S), ("body", _S),
    ("urls", _A), ("url_domains", _A), ("spf_pass", _B), ("dkim_pass", _B), ("dmarc_pass", _B),
    ("url_count", _L), ("has_html", _B), ("content_length", _L), ("fingerprint", _S))

CLASSIFICATION = _table(
    ("fingerprint", _S), ("label", _S), ("confidence", _D), ("source", _S), ("context", _S),
    ("created_at", T.TimestampType()), ("updated_at", T.TimestampType()))

EMAIL_METADATA = _table(
    ("fingerprint", _S), ("file_path", _S), ("subject", _S), ("sender_domain", _S),
    ("created_at", T.TimestampType()))

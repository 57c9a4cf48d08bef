"""Format-preserving pseudonyms for personal data by a keyed Feistel network, with column expressions only.

Numbers and dates are found by pattern and validated: real dates, octets up to 255, numbers that pass the Luhn test, telephone and
social security numbers with possible parts; addresses and access keys are treated alike, by character. A value becomes a row of small numbers,
each with its base; eight rounds add to one half of the free ones (base above 1) a keyed digest of the other half and of the fixed ones (those of an
address or key, the first digit of a card), modulo the bases. A single free number has no other half: it is shifted by the digest of the fixed ones. This permutes the
values of a format, so equal values stay equal in all documents, different ones stay different, and the
result is a valid value of the same form. Whoever has the key can undo it by subtracting in reverse order.

Kept as they are: the first digit of a card number, whose check digit follows from the rest, the country code of a telephone number, the domain
of an address, the name before a secret, and everything that does not validate. Not looked for: names, postal addresses, dates with words or two-digit
years, dates with the month first and a day after the 28th, local parts above 64 characters, values of a secret shorter than 8 or
longer than 256, telephone numbers written without separators. Equal values in another writing (separators, the name before a secret) stay equal.

Edge cases: null texts stay null, empty ones empty; rows with any id are treated, repeated rows alike; very long texts and unbroken runs
take time in proportion to their length; an empty table gives an empty one; of overlapping finds the first counts, of those at one
place the first of ``PATTERNS``. All columns are kept whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersift.llm.naming import unused

ROUNDS = 8
#: Fixed patterns of the values looked for, in order of preference.
PATTERNS = {
    "secret": r"(?<![A-Za-z])(?i:password|passwd|secret|token|api[_-]?key|access[_-]?key)[\"']?(?: ?[=:] ?[\"']|=|: ?(?=[A-Za-z+/_.-]*\d))"
              r"[A-Za-z0-9+/_.-]{8,256}+(?![A-Za-z0-9+/_.-])",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}",
    "octets": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "slashed": r"(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])",
    "security": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "foreign": r"(?<![\d+])\+(?!1[ -])\d{1,3}(?:[ -]\d{2,4}){2,4}(?!\d)",
    "telephone": r"(?<![\d(])(?:\+1[ -]?)?(?:\(\d{3}\) ?|\d{3}[-. ])\d{3}[-. ]\d{4}(?!\d)",
    "card": r"(?<!\d)(?:(?:\d{4}[ -]){3}\d{4}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
    "key": r"AKIA[0-9A-Z]{16}(?![0-9A-Z])",
}
_SECRET_NAME = r"^[A-Za-z_-]+[\"']?(?: ?[=:] ?[\"']|=|: ?)"
ANY = "|".join(PATTERNS.values())
#: 400 years from this day are 27 * 5411 days.
FIRST_DAY, DAY_BASES = "1800-01-01", (27, 5411)


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn test over digits given from the right, the check digit first."""
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d)


def _digits(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d"), F.lit(0)), lambda d: d.cast("int"))


def _kind(x: Column) -> Column:
    found = F.lit("none")
    for kind in reversed(PATTERNS):
        found = F.when(x.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(found)
    return F.when((found == "slashed") & _day(x, "dd/MM/yyyy").isNull(), "american").otherwise(found)


def _day(x: Column, form: str) -> Column:
    return F.datediff(F.try_to_timestamp(x, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")


def _numbers(kind: Column, x: Column) -> Column:
    """Whole numbers of the kinds that are not treated by character; null if the value is not valid."""
    ints = F.transform(F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0)), lambda d: d.cast("long"))
    octets = F.when(F.forall(ints, lambda d: d <= 255), ints)
    day = F.when(kind == "date", _day(x, "yyyy-MM-dd")).otherwise(_day(x, "dd/MM/yyyy"))
    date = F.when((day >= 0) & (day < DAY_BASES[0] * DAY_BASES[1]), F.array(F.floor(day / DAY_BASES[1]), day % DAY_BASES[1]))
    area, group, serial = (F.get(ints, i) for i in range(3))
    possible = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    security = F.when(possible, F.array(area - F.when(area > 666, 2).otherwise(1), group - 1, serial - 1))
    month, late, year = area - 1, group - 13, serial - 1800  # month first, days 13 to 28: any year has them
    american = F.when(month.between(0, 11) & late.between(0, 15) & year.between(0, 399), F.array(month, late, year))
    return F.when(kind == "octets", octets).when(kind.isin("date", "slashed"), date).when(kind == "security", security).when(
        kind == "american", american)


def _char_base(kind: Column, x: Column, c: Column, i: Column) -> Column:
    """How many values a character may take; 1 leaves it as it is."""
    digits_before = F.length(F.regexp_replace(F.substr(x, F.lit(1), i), "[^0-9]", ""))
    country = F.when(x.startswith("+1"), 1).otherwise(0)
    inside = F.when(kind == "address", i < F.instr(x, "@") - 1).when(kind == "key", i >= 4).when(
        kind == "card", (digits_before > 0) & (i < F.length(x) - 1)).when(
        kind == "telephone", digits_before >= country).when(
        kind == "foreign", digits_before >= F.length(F.regexp_extract(x, r"^\+(\d+)", 1))).when(
        kind == "secret", i >= F.length(F.regexp_extract(x, _SECRET_NAME, 0))).otherwise(True)
    lead = (kind == "telephone") & ((digits_before == country) | (digits_before == country + 3))
    free = F.when(c.rlike("[0-9]"), F.when(lead, 8).otherwise(10)).when(
        c.rlike("[a-zA-Z]"), 26).otherwise(1)
    return F.when(inside, free).otherwise(1)


def _valid_text(kind: Column, x: Column) -> Column:
    digits = _digits(x)
    national = F.when(x.startswith("+1"), F.slice(digits, 2, 10)).otherwise(digits)
    return F.when(kind == "card", _luhn(F.reverse(digits)) % 10 == 0).when(
        kind == "telephone", (F.get(national, F.lit(0)) >= 2) & (F.get(national, F.lit(3)) >= 2)).otherwise(
        kind.isin("address", "key", "secret", "foreign"))


def _base(kind: Column, i: Column) -> Column:
    return F.when(kind == "octets", 256).when(
        kind.isin("date", "slashed"), F.when(i == 0, DAY_BASES[0]).otherwise(DAY_BASES[1])).when(
        kind == "american", F.when(i == 0, 12).when(i == 1, 16).otherwise(400)).otherwise(
        F.when(i == 0, 898).when(i == 1, 99).otherwise(9999))


def _round(found: Column, key: str, turn: int) -> Column:
    """Add to one half of every value the keyed digest of its other half."""

    def one(s: Column) -> Column:
        half = F.floor(F.size(s["free"]) / 2).cast("int")
        other = F.slice(s["free"], half + 1, F.size(s["free"])) if turn % 2 == 0 else F.slice(s["free"], F.lit(1), half)
        values = F.transform(other, lambda p: F.get(s["v"], p))
        digest = F.sha2(F.concat(F.lit(f"{key}:{turn}:"), s["kind"], F.lit(":"), s["fixed"], F.lit(":"), F.array_join(values, ",")), 512)

        def moved(e: Column, i: Column) -> Column:
            rank = F.array_position(s["free"], i).cast("int") - 1  # -1 if fixed
            mine = (rank >= 0) & (rank < half) if turn % 2 == 0 else rank >= half
            block = F.floor(rank / 32)  # a digest has 32 steps, longer values take more digests
            more = F.when(block == 0, digest).otherwise(F.sha2(F.concat(digest, F.lit(":"), block.cast("string")), 512))
            step = F.conv(F.substr(more, (rank % 32) * 4 + 1, F.lit(4)), 16, 10).cast("long")
            return F.when(mine, (e + step) % F.get(s["b"], i)).otherwise(e)

        return F.struct(s["x"].alias("x"), s["kind"].alias("kind"), F.transform(s["v"], moved).alias("v"),
                        s["b"].alias("b"), s["o"].alias("o"), s["free"].alias("free"), s["fixed"].alias("fixed"))

    return F.transform(found, one)


def _rendered(s: Column) -> Column:
    v, kind = s["v"], s["kind"]
    text = F.array_join(F.transform(v, lambda e, i: F.char(e + F.get(s["o"], i))), "")
    rest = F.reverse(F.slice(_digits(text), F.lit(1), F.size(_digits(text)) - 1))
    check = (10 - _luhn(F.concat(F.array(F.lit(0)), rest)) % 10) % 10
    card = F.concat(F.substr(text, F.lit(1), F.length(text) - 1), check.cast("string"))
    octets = F.array_join(F.transform(v, lambda e: e.cast("string")), ".")
    day = F.get(v, F.lit(0)) * DAY_BASES[1] + F.get(v, F.lit(1))
    calendar = F.date_add(F.lit(FIRST_DAY).cast("date"), day.cast("int"))
    american = F.concat_ws("/", *[F.lpad((F.get(v, F.lit(k)) + low).cast("string"), w, "0") for k, (low, w) in enumerate(((1, 2), (13, 2), (1800, 4)))])
    area = F.get(v, F.lit(0)) + 1
    security = F.concat_ws("-", *[F.lpad(e.cast("string"), w, "0") for e, w in (
        (F.when(area >= 666, area + 1).otherwise(area), 3), (F.get(v, F.lit(1)) + 1, 2), (F.get(v, F.lit(2)) + 1, 4))])
    return F.when(F.size(v) == 0, s["x"]).when(kind == "card", card).when(kind == "octets", octets).when(
        kind == "date", F.date_format(calendar, "yyyy-MM-dd")).when(kind == "slashed", F.date_format(calendar, "dd/MM/yyyy")).when(
        kind == "american", american).when(kind == "security", security).otherwise(text)


def with_pseudonyms(documents: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All rows and columns, the text with pseudonyms, plus ``_n_replaced``."""
    text = F.col(text_col)
    x, f, new, parts = unused(documents.columns, "x", "f", "new", "parts")
    rows = documents.withColumn(x, F.coalesce(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), F.array().cast("array<string>")))
    rows = rows.withColumn(f, F.transform(x, lambda x: F.struct(x.alias("x"), _kind(x).alias("kind"))))
    rows = rows.withColumn(f, F.transform(f, lambda s: F.struct(
        s["x"].alias("x"), s["kind"].alias("kind"), _numbers(s["kind"], s["x"]).alias("numbers"),
        _valid_text(s["kind"], s["x"]).alias("valid"))))

    def prepared(s: Column) -> Column:
        chars = F.split(s["x"], "")
        bases = F.transform(chars, lambda c, i: _char_base(s["kind"], s["x"], c, i).cast("long"))
        low = F.transform(chars, lambda c, i: F.when(_char_base(s["kind"], s["x"], c, i) == 1, F.ascii(c)).when(
            _char_base(s["kind"], s["x"], c, i) == 8, 50).when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).otherwise(65).cast("long"))
        values = F.zip_with(chars, low, lambda c, o: F.ascii(c).cast("long") - o)
        none = F.array().cast("array<long>")
        by_number, by_char = s["numbers"].isNotNull(), s["valid"]
        return F.struct(
            s["x"].alias("x"), s["kind"].alias("kind"),
            F.when(by_number, s["numbers"]).when(by_char, values).otherwise(none).alias("v"),
            F.when(by_number, F.transform(s["numbers"], lambda _, i: _base(s["kind"], i).cast("long"))).when(
                by_char, bases).otherwise(none).alias("b"),
            F.when(by_char & ~by_number, low).otherwise(none).alias("o"))

    rows = rows.withColumn(f, F.transform(f, prepared))

    def split(s: Column) -> Column:
        places = F.transform(s["b"], lambda b, i: F.when(b > 1, i).otherwise(-1))
        fixed = F.transform(s["b"], lambda b, i: F.when(b > 1, F.lit("")).otherwise((F.get(s["v"], i) + F.get(s["o"], i)).cast("string")))
        # separators do not tell numbers apart, and a check digit follows from the digits that change
        tweak = F.when(s["kind"] == "telephone", "").when(s["kind"] == "foreign", F.regexp_extract(s["x"], r"^\+\d+", 0)).when(
            s["kind"] == "secret", F.regexp_replace(F.regexp_replace(s["x"], _SECRET_NAME, ""), "[A-Za-z0-9]", "")).when(s["kind"] == "card", F.substr(s["x"], F.lit(1), F.lit(1))).otherwise(
            F.array_join(fixed, ","))
        return F.struct(*[s[c].alias(c) for c in ("x", "kind", "v", "b", "o")],
                        F.filter(places, lambda i: i >= 0).alias("free"), tweak.alias("fixed"))

    rows = rows.withColumn(f, F.transform(f, split))
    for turn in range(ROUNDS):
        rows = rows.withColumn(f, _round(F.col(f), key, turn))
    rows = rows.withColumn(new, F.transform(f, _rendered))
    rows = rows.withColumn(parts, F.when(F.size(new) > 0, F.split(text, ANY, -1)))
    whole = F.concat(F.get(parts, F.lit(0)), F.array_join(F.zip_with(new, F.slice(
        parts, F.lit(2), F.size(new)), lambda a, b: F.concat(a, b)), ""))
    replaced = F.when(F.size(new) > 0, whole).otherwise(text)
    return rows.select(*[replaced.alias(c) if c == text_col else F.col(c) for c in documents.columns],
                       F.size(F.filter(f, lambda s: F.size(s["v"]) > 0)).alias("_n_replaced"))

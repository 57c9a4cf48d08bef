"""Learned decision lists over text statistics, with column expressions only.

Statistics of whole texts are counted once and kept as numbers. Sequential covering then works on labelled rows whose numbers are
replaced by their bins between candidate thresholds: a conjunction grows by the condition with the largest information gain on
two thirds of them and is cut back to the prefix that does best on the rest; rows it covers are set aside and the next rule is
learnt. Each step is one grouped count of at most features x thresholds rows. The list is applied as one
ordered conditional expression.

Edge cases: null and empty texts count nothing and fail the base test; without labels of both kinds the list is empty;
null labels are ignored; repeated rows count and are returned as often as they occur; long texts are counted whole; of conditions
with equal gain the first by feature, threshold and direction is taken; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiersift.runtime import materialize

WINDOW = 5
CUTS = 24  # candidate thresholds per feature and class
MAX_RULES, MAX_CONDITIONS, MIN_COVERED, MIN_PRECISION = 12, 4, 3, 0.8
_GAP, _WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"

#: Features as expressions over the counts.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "exclaims_per_word": "n_exclaims / greatest(n_words, 1)",
    "bars_per_word": "n_bars / greatest(n_words, 1)",
    "capitals_share": "n_capitals / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "same_neighbours": "n_same_neighbours / greatest(n_words, 1)",
    "duplicate_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "words": "double(n_words)",
}


def _without(text: Column, mark: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(mark), F.lit("")))


def with_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the counts of every row. Arrays are columns of their own, so that lambdas do not compute them again."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", _GAP), ""))
    rows = rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("n", F.size("hashes"))
    rows = rows.withColumn("windows", F.when(F.col("n") < WINDOW, F.array().cast("array<long>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("n") - WINDOW, F.lit(0))),
        lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))))
    rows = rows.withColumn("placed", F.when(  # only texts in which a window occurs again
        F.size("windows") > F.size(F.array_distinct("windows")),
        F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.withColumn("again", F.sort_array(F.transform(F.filter("placed", lambda x, j: (
        F.coalesce(F.get("placed", j - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get("placed", j + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("again", lambda p, j: F.least(
        F.coalesce(F.get("again", j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda s, x: s + x)
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD)))
    same = F.filter("hashes", lambda h, i: h == F.get("hashes", i - 1))
    counts = {
        "n_words": F.col("n"), "word_chars": F.char_length(F.regexp_replace("text", _GAP, "")),
        "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.coalesce(covered, F.lit(0)), "n_lines": F.size("lines"),
        "n_distinct_words": F.size(F.array_distinct("hashes")), "n_same_neighbours": F.size(same),
        "n_exclaims": _without(F.col("text"), "!"), "n_bars": _without(F.col("text"), "|"),
        "n_capitals": F.regexp_count("text", F.lit("[A-ZÀ-ÖØ-Þ]")),
    }
    return rows.select("doc_id", *[c.cast("long").alias(n) for n, c in counts.items()])


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.cut if self.above else value <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule) -> Column:
    found = F.lit(True)
    for c in rule:
        found = found & c.column()
    return found


def rejected_by(rules: list[Rule]) -> Column:
    """The first rule that holds, as text; null if none does."""
    if not rules:
        return F.lit(None).cast("string")
    found = F.when(_holds(rules[0]), " and ".join(map(str, rules[0])))
    for rule in rules[1:]:
        found = found.when(_holds(rule), " and ".join(map(str, rule)))
    return found


def _gain(p: float, n: float, before: float) -> float:
    return p * (math.log2(p / (p + n)) - before) if p else 0.0


def _bin(value: str, cuts: list[float]) -> Column:
    """How many of the ascending ``cuts`` lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.expr(value)))


def learn(labelled: DataFrame) -> list[Rule]:
    """Rules for the rows with ``bad`` = 1 of a table of counts with ``bad`` and a ``part`` 0, 1 (grow) or 2 (prune)."""
    names = list(FEATURES)
    shares = [(i + 0.5) / CUTS for i in range(CUTS)]
    found = labelled.agg(*[F.percentile_approx(F.when(F.col("bad") == c, F.expr(FEATURES[f])), shares, 2000).alias(f"{f}{c}")
                           for f in names for c in (0, 1)]).first()
    if any(found[f"{names[0]}{c}"] is None for c in (0, 1)):
        return []
    cuts = {f: sorted({*found[f"{f}0"], *found[f"{f}1"]}) for f in names}
    bins = F.array(*[_bin(FEATURES[f], cuts[f]) for f in names])
    rows = materialize(labelled.withColumn("bins", bins), "binned")

    def grouped(left: DataFrame) -> dict[int, dict[int, tuple[int, int]]]:
        table: dict[int, dict[int, tuple[int, int]]] = {}
        counted = left.select("bad", F.posexplode_outer("bins").alias("f", "b")).groupBy("f", "b").agg(
            F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n"))
        for f, b, p, n in counted.collect():
            table.setdefault(f, {})[b] = (p, n)
        return table

    def best(left: DataFrame) -> tuple[Condition | None, int, int]:
        table = grouped(left)
        if not table:
            return None, 0, 0
        p0, n0 = (sum(v[k] for v in table[0].values()) for k in (0, 1))
        if not p0 or not n0:
            return None, p0, n0
        before, choice, most = math.log2(p0 / (p0 + n0)), None, 1e-9
        for f, name in enumerate(names):
            p = n = 0
            for b, cut in enumerate(cuts[name]):  # rows of bins 0..b have a value <= cut
                more = table[f].get(b, (0, 0))
                p, n = p + more[0], n + more[1]
                for above, x, y in ((False, p, n), (True, p0 - p, n0 - n)):
                    gain = _gain(x, y, before)
                    if gain > most:
                        choice, most = Condition(name, above, cut), gain
        return choice, p0, n0

    rules: list[Rule] = []
    for _ in range(MAX_RULES):
        left = rows.filter(rejected_by(rules).isNull())
        rule: Rule = ()
        while len(rule) < MAX_CONDITIONS:
            condition, _, _ = best(left.filter((F.col("part") < 2) & _holds(rule)))
            if condition is None:
                break
            rule += (condition,)
        if not rule:
            break
        sums = left.filter("part = 2").agg(*[F.sum(F.when(_holds(rule[:k]), w).otherwise(0)).alias(f"{s}{k}")
                                             for k in range(1, len(rule) + 1)
                                             for s, w in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]).first()
        worth = [((sums[f"p{k}"] or 0), (sums[f"n{k}"] or 0)) for k in range(1, len(rule) + 1)]
        k = max(range(len(rule)), key=lambda i: ((worth[i][0] - worth[i][1]) / max(sum(worth[i]), 1), -i))
        p, n = worth[k]
        if p < MIN_COVERED or p < MIN_PRECISION * (p + n):
            break
        rules.append(rule[:k + 1])
    return rules


def judge(documents: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and the ``rule`` that rejects a text, if any.

    Labels whose crc32(doc_id as text) mod 5 is 0 are not learnt from.
    """
    counts = materialize(with_counts(documents), "counts")
    labels = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()
                           & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    labelled = counts.join(labels.select("doc_id", (F.col(label_col) == 0).cast("int").alias("bad")), "doc_id")
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)).cast("int")
    rules = learn(materialize(labelled.withColumn("part", part), "labelled"))
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    judged = counts.withColumn("base_failed", failed).withColumn("rule", rejected_by(rules))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")

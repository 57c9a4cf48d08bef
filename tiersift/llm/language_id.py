"""Language identification by interpolated Kneser-Ney character models, one per language, held as sorted hash arrays.

A text is its lower-cased words, runs of letters and marks, each between two boundaries. Every character and closing boundary is
predicted from up to ``ORDER - 1`` characters before it in its word. Counts of the longest n-grams of all learnt rows are summed in every task and
then over all; shorter orders count the different characters seen before an n-gram (those at a word's start, which have none,
their occurrences). Discounts come from the counts of counts, probabilities from joins of each order with the one below. A model is
the sorted hashes of its n-grams with logarithms of probability and back-off weight. The language with the least
cross-entropy a character is chosen.

A tenth of the learnt rows, chosen by hash, is kept out of the counts and calibrates: the margin to the second language gives the
score by isotonic regression, and ``rejected`` tells texts whose score is below ``least_score`` or whose cross-entropy
lies ``DEVIATIONS`` above that of the calibrating texts: probably none of the languages.

Model size: n-grams of all learnt rows count, whatever their number. Up to ``max_entries`` n-grams of all languages, 20 bytes each, go to
every task. A larger model stays a stored table: tasks get the finished scores of the most frequent longest n-grams in the same space,
every other n-gram of a text is scored by joins with the table, once for all texts. The results are the same.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and rejected, as is everything when nothing can be learnt; rows with a
null language, or a null id, are not learnt from; ties go to the alphabetically first language; with one language its share
is the score; long words and texts are read whole; rows repeated with one id are scored each; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, replace
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tiersift.llm.quality_model import remainder
from tiersift.runtime import join_per_key, materialize, release

ORDER = 5
MAX_ENTRIES = 4_000_000
CALIBRATING, DEVIATIONS = 10, 5.0
BINS = 8  # of the calibration, for each doubling of the margin
CHUNK = 1 << 19  # characters handled at once
HELD_GRAMS, REMEMBERED = 1_000_000, 400_000  # distinct n-grams a task holds before it passes counts on, and scores it remembers
_BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: belongs to a word, is a letter."""
    kinds = np.array([unicodedata.category(chr(i))[0] for i in range(0x110000)])
    return (kinds == "L") | (kinds == "M"), kinds == "L"


@dataclass
class Symbols:
    """Symbols of consecutive texts: 0 for a boundary, else a code point, and where predictions are made."""

    codes: np.ndarray
    events: np.ndarray  # positions of the symbols that are predicted
    length: np.ndarray  # of the longest n-gram that ends there
    text: np.ndarray  # whose event it is
    lettered: np.ndarray  # by text

    def windows(self, at: np.ndarray) -> np.ndarray:
        """The last ``ORDER`` symbols up to each event, the last one first; what lies before the word is not to be read."""
        return self.codes[np.maximum(self.events[at][:, None] - np.arange(ORDER), 0)]

    def keys(self) -> np.ndarray:
        """A hash of the longest n-gram of every event."""
        value, total = self.codes.astype(np.uint64) + np.uint64(1), np.zeros(len(self.events), dtype=np.uint64)
        factor = np.uint64(1)
        for k in range(ORDER):
            part = value[np.maximum(self.events - k, 0)] * factor
            total += part if k < 2 else np.where(self.length > k, part, np.uint64(0))
            factor = np.uint64((int(factor) * int(_BASE)) % (1 << 64))
        return total

    def grams(self, at: np.ndarray) -> list[str]:
        """The longest n-gram of each event as text; a blank stands for a boundary."""
        window, length = self.windows(at), self.length[at]
        window = np.where(window == 0, 32, window)
        turned = np.zeros_like(window)  # first symbol first, zeros behind
        for k in range(2, ORDER + 1):
            turned[length == k, :k] = window[length == k, :k][:, ::-1]
        return np.ascontiguousarray(turned).view(f"<U{ORDER}").ravel().tolist()


def symbols(texts: list[str]) -> Symbols:
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le"), dtype=np.uint32)
    in_word, letter = _letters()
    solid = in_word[codes]
    size = np.fromiter((len(t) + 1 for t in low), dtype=np.int64, count=len(low))
    ends = np.concatenate([[1], 1 + np.cumsum(size)])  # a text owns the separator behind it
    seen = np.concatenate([[0], np.cumsum(letter[codes])])
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    keep[0] = True
    text = np.searchsorted(ends, np.flatnonzero(keep), "right") - 1
    kept = np.where(solid, codes, 0)[keep]
    place = np.arange(len(kept))
    since = place - np.maximum.accumulate(np.where(kept == 0, place, 0))  # from the boundary before, 0 on a boundary
    since[1:] = np.where(kept[1:] == 0, since[:-1] + 1, since[1:])
    return Symbols(kept, place[1:], np.minimum(since[1:] + 1, ORDER), text[1:], np.diff(seen[ends]) > 0)


def _stretches(texts: list[str | None]):
    """First row and texts of about ``CHUNK`` characters."""
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        part.append(t or "")
        size += len(part[-1])
        if size >= CHUNK:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


def gram_counts(rows: DataFrame) -> DataFrame:
    """``lang, gram, c`` of the longest n-gram at every event of ``lang, text``."""

    def count(batches):
        held: dict[tuple[str, str], int] = {}

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.string()),
                 pa.array(list(held.values()), pa.int64())], ["lang", "gram", "c"])

        for batch in batches:
            frame = pd.DataFrame({"lang": batch.column(0).to_pylist(), "text": batch.column(1).to_pylist()})
            for lang, own in frame.groupby("lang"):
                for _, part in _stretches(own["text"].tolist()):
                    found = symbols(part)
                    if not len(found.events):
                        continue
                    codes, kinds = pd.factorize(found.keys())
                    some = np.zeros(len(kinds), dtype=np.int64)
                    some[codes] = np.arange(len(codes))
                    n = np.bincount(codes)
                    for gram, c in zip(found.grams(some), n.tolist(), strict=True):
                        held[lang, gram] = held.get((lang, gram), 0) + c
                    if len(held) > HELD_GRAMS:
                        yield flush()
                        held.clear()
        if held:
            yield flush()

    return rows.select("lang", "text").mapInArrow(count, "lang string, gram string, c long").groupBy("lang", "gram").agg(
        F.sum("c").alias("c"))


def probabilities(events: DataFrame) -> DataFrame:
    """``lang, n, gram, c, p, weight``: interpolated probability of the last symbol and back-off weight as a context.

    An n-gram shares its context with at most as many others as there are symbols, so no window is large.
    """
    levels = {}
    for n in range(ORDER, 0, -1):
        level = events.filter(F.length("gram") == n)
        if n < ORDER:
            level = level.unionByName(levels[n + 1].groupBy("lang", F.expr("substr(gram, 2)").alias("gram")).agg(
                F.count("*").alias("c")))
        levels[n] = materialize(level, f"order{n}")
    n_symbols = levels[1].agg(F.count_distinct("gram")).first()[0] + 1  # one for symbols never seen
    below, out = None, None
    for n in range(1, ORDER + 1):
        counts = levels[n].groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
        discount = counts.select("lang", F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (
            F.col("n1") + 2 * F.col("n2"))).otherwise(0.5).alias("discount"))  # one row a language
        context = Window.partitionBy("lang", "context")
        rows = levels[n].join(F.broadcast(discount), "lang").withColumn("context", F.substr("gram", F.lit(1), F.lit(n - 1))).withColumns(
            {"total": F.sum("c").over(context), "kinds": F.count("*").over(context)})
        weight = F.col("discount") * F.col("kinds") / F.col("total")
        if below is None:
            rows = rows.withColumn("lower", F.lit(1.0 / n_symbols))
        else:
            lower = below.select("lang", F.col("gram").alias("rest"), F.col("p").alias("lower"))
            rows = rows.withColumn("rest", F.expr("substr(gram, 2)")).join(lower, ["lang", "rest"])
        rows = materialize(rows.select("lang", "gram", "c", "context", weight.alias("weight"), (
            (F.col("c") - F.col("discount")) / F.col("total") + weight * F.col("lower")).alias("p")), f"model{n}")
        weights = rows.groupBy("lang", F.col("context").alias("gram")).agg(F.first("weight").alias("weight"))
        if below is None:  # the empty context: what a symbol never seen gets
            out = weights.select("lang", F.lit(0).alias("n"), "gram", F.lit(0).cast("long").alias("c"),
                                 F.lit(1.0 / n_symbols).alias("p"), "weight")
        else:
            out = out.unionByName(below.drop("weight", "context").join(weights, ["lang", "gram"], "left").select(
                "lang", F.lit(n - 1).alias("n"), "gram", "c", "p", F.coalesce("weight", F.lit(1.0)).alias("weight")))
        below = rows
    return out.unionByName(below.select("lang", F.lit(ORDER).alias("n"), "gram", "c", "p", F.lit(1.0).alias("weight")))


def _gram_hash(grams: list[str]) -> np.ndarray:
    matrix = np.zeros((len(grams), ORDER), dtype=np.uint32)
    for row, g in zip(matrix, grams, strict=True):
        row[:len(g)] = [0 if c == " " else ord(c) for c in reversed(g)]
    length = np.fromiter(map(len, grams), dtype=np.int64, count=len(grams))
    total, factor = np.zeros(len(grams), dtype=np.uint64), 1
    for k in range(ORDER):
        total += np.where(length > k, (matrix[:, k].astype(np.uint64) + np.uint64(1)) * np.uint64(factor), np.uint64(0))
        factor = factor * int(_BASE) % (1 << 64)
    return total


@dataclass
class LanguageModel:
    """Sorted n-gram hashes of one language; ``unseen`` is the log probability of a symbol never seen."""

    name: str
    hashes: np.ndarray
    p: np.ndarray
    weight: np.ndarray
    unseen: float

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return at, self.hashes[at] == h


@dataclass
class Identifier:
    models: list[LanguageModel]  # by name
    knots: np.ndarray
    values: np.ndarray
    limit: float  # cross-entropy beyond which a text is rejected
    least_score: float
    #: Of a model too large for every task: all its n-grams, ``gram, p, weight`` with a value for each language. The arrays above
    #: then hold finished scores of whole n-grams.
    table: DataFrame | None = None
    partial: bool = False

    def for_tasks(self) -> Identifier:
        return replace(self, table=None)

    def scores(self, window: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Log probability of each event (its last symbols, the predicted one first) by language; NaN if only the table knows."""
        value = window.astype(np.uint64) + np.uint64(1)
        factor = [1]
        for _ in range(ORDER):
            factor.append(factor[-1] * int(_BASE) % (1 << 64))
        grams, contexts, gram, context = [], [], 0, 0
        for k in range(ORDER):
            gram = gram + value[:, k] * np.uint64(factor[k])
            grams.append(gram)
            contexts.append(context)  # of k symbols before the predicted one
            if k + 1 < ORDER:
                context = context + value[:, k + 1] * np.uint64(factor[k])
        out = np.zeros((len(window), len(self.models)))
        if self.partial:
            whole = np.stack(grams, axis=1)[np.arange(len(window)), length - 1]
            for column, model in enumerate(self.models):
                if len(model.hashes):
                    at, known = model.find(whole)
                    out[:, column] = np.where(known, model.p[at], np.nan)
                else:
                    out[:, column] = np.nan
            return out
        for column, model in enumerate(self.models):
            open_ = np.ones(len(window), dtype=bool)
            for n in range(ORDER, 0, -1):
                turn = np.flatnonzero(open_ & (length >= n))
                at, known = model.find(grams[n - 1][turn])
                out[turn[known], column] += model.p[at[known]]
                open_[turn[known]] = False
                rest = turn[~known]
                if n > 1:
                    at, known = model.find(contexts[n - 1][rest])
                    out[rest[known], column] += model.weight[at[known]]
            out[open_, column] += model.unseen
        return out

    def judge(self, texts: list[str | None], memory: dict) -> pd.DataFrame:
        """``lettered, best`` (place of the language), ``margin`` in nats over the whole text and ``entropy`` in nats a symbol."""
        parts = [verdict(found.lettered, total, n) for _, found, total, n, _, _ in self.sums(texts, memory)]
        return pd.concat(parts) if parts else pd.DataFrame({"lettered": [], "best": [], "margin": [], "entropy": []})

    def sums(self, texts: list[str | None], memory: dict):
        """Of stretches of texts: first row, symbols, log probabilities by text and language, events by text, and what these lack:
        an event of every kind without a score, and ``text, kind, c``, how often a text has it."""
        for first, part in _stretches(texts):
            found = symbols(part)
            codes, kinds = pd.factorize(found.keys())
            some = np.zeros(len(kinds), dtype=np.int64)
            some[codes] = np.arange(len(codes))
            by_kind = self._remembered(kinds, some, found, memory)
            lacking = np.flatnonzero(np.isnan(by_kind).any(1)) if self.partial else np.zeros(0, dtype=np.int64)
            by_kind[lacking] = 0.0
            total = np.column_stack([np.bincount(found.text, weights=by_kind[codes, j], minlength=len(part))
                                     for j in range(len(self.models))])
            place = np.full(len(kinds), -1)
            place[lacking] = np.arange(len(lacking))
            own = np.flatnonzero(place[codes] >= 0)
            pairs, c = np.unique(found.text[own] * np.int64(max(len(lacking), 1)) + place[codes[own]], return_counts=True)
            yield (first, found, total, np.bincount(found.text, minlength=len(part)), some[lacking],
                   (*np.divmod(pairs, max(len(lacking), 1)), c))

    def _remembered(self, kinds: np.ndarray, some: np.ndarray, found: Symbols, memory: dict) -> np.ndarray:
        """Scores of different events; those met before are looked up."""
        known, scores = memory.get("known", np.zeros(0, np.uint64)), memory.get("scores", np.zeros((0, len(self.models))))
        at = np.minimum(np.searchsorted(known, kinds), max(len(known) - 1, 0))
        old = known[at] == kinds if len(known) else np.zeros(len(kinds), dtype=bool)
        new = np.flatnonzero(~old)
        out = np.zeros((len(kinds), len(self.models)))
        out[old] = scores[at[old]]
        out[new] = self.scores(found.windows(some[new]), found.length[some[new]])
        if len(known) + len(new) > REMEMBERED:
            known, scores, new = known[:0], scores[:0], np.arange(len(kinds))
        if len(new):
            every = np.concatenate([known, kinds[new]])
            order = np.argsort(every, kind="stable")
            memory["known"], memory["scores"] = every[order], np.concatenate([scores, out[new]])[order]
        return out

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        """Probability that the choice is right; a thousandth of the margin keeps order inside flat steps."""
        z = np.log2(1 + np.maximum(margin, 0))
        return np.clip(0.999 * np.interp(z, self.knots, self.values) + 0.001 * z / (z + 8), 0, 1)


def verdict(lettered: np.ndarray, total: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """What ``judge`` returns, of log probabilities by text and language and events by text."""
    order = np.argsort(-total, axis=1, kind="stable")
    best = np.take_along_axis(total, order[:, :1], 1)[:, 0]
    second = np.take_along_axis(total, order[:, 1:2], 1)[:, 0] if total.shape[1] > 1 else best
    return pd.DataFrame({"lettered": lettered, "best": order[:, 0], "margin": best - second, "entropy": -best / np.maximum(n, 1)})


def isotonic(bins: list[tuple[float, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rising shares of right answers at ascending ``(place, right, total)``, smoothed by half a right and half a wrong answer."""
    blocks: list[list] = []
    for place, right, total in sorted(bins):
        blocks.append([right, total, [place]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            right, total, places = blocks.pop()
            blocks[-1] = [blocks[-1][0] + right, blocks[-1][1] + total, blocks[-1][2] + places]
    level = [(r + 0.5) / (t + 1) for r, t, _ in blocks]
    level = np.maximum.accumulate(level) if level else []
    knots = [(p, v) for (_, _, places), v in zip(blocks, level, strict=True) for p in places]
    return (np.array([k[0] for k in knots]), np.array([k[1] for k in knots])) if knots else (np.zeros(1), np.full(1, 0.5))


def _array(values) -> Column:
    return F.array(*values).cast("array<double>")


def _by_gram(table: DataFrame, names: list[str]) -> DataFrame:
    """``gram, p, weight``: one row an n-gram, with a value or null for each language."""
    def values(column):
        return _array(F.max(F.when(F.col("lang") == name, F.col(column))) for name in names)

    return table.groupBy("gram").agg(values("p").alias("p"), values("weight").alias("weight"))


def _gram_scores(wanted: DataFrame, table: DataFrame, unseen: list[float]) -> DataFrame:
    """``wanted`` (a row for every ``gram``) with ``scores``, the log probability of its last symbol by language.

    An n-gram without an entry takes its context's weight and the score of the n-gram one symbol shorter, so every end of an n-gram
    is scored, the shortest first. At most as many n-grams as there are symbols share a context or an end.
    """
    ends = F.transform(F.sequence(F.lit(1), F.length("gram")), lambda n: F.right(F.col("gram"), n))
    needed = materialize(wanted.select(F.explode(ends).alias("gram")).distinct(), "needed")
    p, weight = table.select("gram", "p"), table.select(F.col("gram").alias("context"), "weight")
    below, out = None, None
    for n in range(1, ORDER + 1):
        rows = needed.filter(F.length("gram") == n).join(p, "gram", "left")
        if n == 1:
            rows = rows.withColumn("lower", _array(F.lit(u) for u in unseen))
        else:
            rows = rows.withColumns({"context": F.expr(f"substr(gram, 1, {n - 1})"), "rest": F.expr("substr(gram, 2)")}).join(
                weight, "context", "left").join(below.select(F.col("gram").alias("rest"), F.col("scores").alias("under")), "rest").withColumn(
                "lower", _array(F.coalesce(F.get("weight", F.lit(j)), F.lit(0.0)) + F.get("under", F.lit(j)) for j in range(len(unseen))))
        below = materialize(rows.select("gram", _array(
            F.coalesce(F.get("p", F.lit(j)), F.get("lower", F.lit(j))) for j in range(len(unseen))).alias("scores")), f"scores{n}")
        out = below if out is None else out.unionByName(below)
    return wanted.join(out, "gram")


def _most_frequent(events: DataFrame, most: int) -> DataFrame:
    """The ``gram`` with the largest counts over all languages, at most ``most`` of them."""
    grams = events.groupBy("gram").agg(F.sum("c").alias("c")).withColumn("level", F.floor(8 * F.log2("c")))
    sizes = grams.groupBy("level").count().collect()  # 504 rows at most
    levels, left = [], most
    for r in sorted(sizes, key=lambda r: -r["level"]):
        left -= r["count"]
        if left < 0:
            break
        levels.append(r["level"])
    return grams.filter(F.col("level").isin(levels)).select("gram") if levels else grams.filter("false").select("gram")


def _models(table: DataFrame, names: list[str]) -> list[LanguageModel]:
    places = pa.array(names, pa.string())

    def hashed(batches):
        for batch in batches:
            key = _gram_hash(batch.column(1).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pc.index_in(batch.column(0), places), pa.array(key), batch.column(2), batch.column(3)],
                                             ["place", "key", "p", "weight"])

    entries = table.select("lang", "gram", "p", "weight").mapInArrow(
        hashed, "place int, key long, p float, weight float").toArrow()  # at most max_entries, 20 bytes each
    models, place = [], entries.column("place").to_numpy()
    for i, name in enumerate(names):
        own = place == i
        key, p, weight = (entries.column(c).to_numpy()[own] for c in ("key", "p", "weight"))
        empty = int(np.flatnonzero(key == 0)[0])  # the hash of no symbol
        order = np.argsort(key.view(np.uint64))
        models.append(LanguageModel(name, key.view(np.uint64)[order], p[order], weight[order], float(p[empty] + weight[empty])))
    return models


def _frequent_models(events: DataFrame, table: DataFrame, by_gram: DataFrame, names: list[str], most: int) -> list[LanguageModel]:
    """Finished scores of the most frequent longest n-grams instead of n-grams."""
    empty = {r["lang"]: float(np.float32(r["p"]) + np.float32(r["weight"])) for r in table.filter("n = 0").collect()}  # one row a language
    unseen = [empty[name] for name in names]
    scored = _gram_scores(_most_frequent(events, most // len(names)), by_gram, unseen)

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_gram_hash(batch.column(0).to_pylist()).view(np.int64)), batch.column(1)],
                                             ["key", "scores"])

    entries = scored.select("gram", "scores").mapInArrow(hashed, "key long, scores array<double>").toArrow()  # max_entries scores at most
    key = entries.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    values = pc.list_flatten(entries.column("scores")).to_numpy().reshape(len(key), len(names))[order]
    return [LanguageModel(name, key[order], np.ascontiguousarray(values[:, j]), np.zeros(0, np.float32), unseen[j])
            for j, name in enumerate(names)]


def _judged(rows: DataFrame, column: str, model: Identifier, then, schema: str) -> DataFrame:
    """``then(column, judged)`` of every batch of ``rows``, with ``judged`` as ``Identifier.judge`` gives it for ``text``."""
    own = model.for_tasks()

    def whole(batches):
        memory: dict = {}
        for batch in batches:
            yield then(batch.column(0), own.judge(batch.column(1).to_pylist(), memory))

    if not model.partial:
        return rows.select(column, "text").mapInArrow(whole, schema)
    kind = rows.schema[column].dataType
    names = ["row", "own", "lettered", "n", "total", "gram", "c"]

    def known(batches):
        """A row for every text with the sums of known scores, one for every n-gram of it that only the table knows."""
        memory: dict = {}
        for batch in batches:
            for first, found, total, n, lacking, (text, place, c) in own.sums(batch.column(2).to_pylist(), memory):
                row = batch.column(0).slice(first, len(n))
                yield pa.RecordBatch.from_arrays(
                    [row, batch.column(1).slice(first, len(n)), pa.array(found.lettered), pa.array(n.astype(np.int64)),
                     pa.array(list(total), pa.list_(pa.float64())), pa.nulls(len(n), pa.string()), pa.nulls(len(n), pa.int64())], names)
                if len(c):
                    some = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [row.take(some), pa.nulls(len(c), batch.column(1).type), pa.nulls(len(c), pa.bool_()), pa.nulls(len(c), pa.int64()),
                         pa.nulls(len(c), pa.list_(pa.float64())), pa.array(found.grams(lacking), pa.string()).take(pa.array(place)),
                         pa.array(c.astype(np.int64))], names)

    parts = materialize(rows.select(F.monotonically_increasing_id().alias("row"), F.col(column).alias("own"), "text").mapInArrow(
        known, f"row long, own {kind.simpleString()}, lettered boolean, n long, total array<double>, gram string, c long"), "known")
    lacking = parts.filter("gram IS NOT NULL").select("row", "gram", "c")
    wanted = materialize(lacking.groupBy("gram").agg(F.count("*").alias("n")), "wanted")
    scored = materialize(_gram_scores(wanted, model.table, [m.unseen for m in own.models]), "scored")
    rest = join_per_key(lacking, scored, "gram", "row").groupBy("row").agg(
        _array(F.sum(F.col("c") * F.get("scores", F.lit(j))) for j in range(len(own.models))).alias("rest"))
    total = F.when(F.col("rest").isNull(), F.col("total")).otherwise(F.zip_with("total", "rest", lambda a, b: a + b))
    summed = parts.filter("gram IS NULL").join(rest, "row", "left").select("own", "lettered", "n", total.alias("total"))

    def settled(batches):
        for batch in batches:
            total = batch.column(3).flatten().to_numpy().reshape(len(batch), -1)
            lettered, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            yield then(batch.column(0), verdict(lettered, total, n))

    done = materialize(summed.mapInArrow(settled, schema), "judged")
    release(parts, wanted, scored)
    return done


def fit(rows: DataFrame, max_entries: int = MAX_ENTRIES, least_score: float = 0.5) -> Identifier | None:
    """Models and calibration from ``doc_id, text, lang``; None if there is nothing to learn from."""
    rows = rows.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    aside = F.pmod(F.xxhash64("doc_id", F.lit(41)), F.lit(CALIBRATING)) == 0
    events = materialize(gram_counts(rows.filter(~aside)), "events")

    table = materialize(probabilities(events).withColumns(
        {c: F.log(c).cast("float") for c in ("p", "weight")}), "model")
    names = sorted(r[0] for r in table.select("lang").distinct().collect())  # one row a language
    by_gram = None
    if table.count() <= max_entries:
        models = _models(table, names)
    else:
        by_gram = materialize(_by_gram(table, names), "grams")
        models = _frequent_models(events, table, by_gram, names, max_entries)
    if not models:
        return None
    draft = Identifier(models, np.zeros(1), np.full(1, 0.5), np.inf, least_score, by_gram, by_gram is not None)

    def measure(lang, judged):
        z = np.floor(np.log2(1 + judged["margin"].to_numpy()) * BINS)
        right = np.array([names[i] for i in judged["best"]], dtype=object) == np.array(lang.to_pylist(), dtype=object)
        out = pd.DataFrame({"z": z.astype(np.int64), "right": right.astype(np.int64), "n": 1, "e": judged["entropy"].to_numpy()})
        out = out[judged["lettered"].to_numpy()]
        out["ee"] = out["e"] ** 2
        return pa.RecordBatch.from_pandas(out.groupby("z", as_index=False).sum(), preserve_index=False)

    bins = _judged(rows.filter(aside), "lang", draft, measure, "z long, right long, n long, e double, ee double").groupBy("z").agg(
        *[F.sum(c).alias(c) for c in ("right", "n", "e", "ee")]).collect()  # BINS for each doubling of a margin
    knots, values = isotonic([((b["z"] + 0.5) / BINS, b["right"], b["n"]) for b in bins])
    n = sum(b["n"] for b in bins)
    mean = sum(b["e"] for b in bins) / n if n else 0.0
    spread = max(sum(b["ee"] for b in bins) / n - mean * mean, 0.0) ** 0.5 if n else np.inf
    return replace(draft, knots=knots, values=values, limit=mean + DEVIATIONS * max(spread, 0.05))


def identify(documents: DataFrame, model: Identifier | None) -> DataFrame:
    """``doc_id, lang_pred, score, entropy, rejected`` of every row."""

    kind = documents.schema["doc_id"].dataType.simpleString()
    if model is None:
        return documents.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                                F.lit(0.0).alias("entropy"), F.lit(True).alias("rejected"))
    own = model.for_tasks()

    def work(doc_id, judged):
        lettered = judged["lettered"].to_numpy(dtype=bool)
        names = np.array([m.name for m in own.models], dtype=object)[judged["best"].to_numpy(dtype=int)]
        score = np.where(lettered, own.calibrated(judged["margin"].to_numpy(dtype=float)), 0.0)
        entropy = judged["entropy"].to_numpy(dtype=float)
        rejected = ~lettered | (score < own.least_score) | (entropy > own.limit)
        return pa.RecordBatch.from_arrays(
            [doc_id, pa.array(np.where(lettered, names, "und"), pa.string()), pa.array(score),
             pa.array(entropy), pa.array(rejected)], ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return _judged(documents, "doc_id", model, work, f"doc_id {kind}, lang_pred string, score double, entropy double, rejected boolean")


def language_scores(documents: DataFrame, parts: int = 4, held_out: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, entropy, rejected`` of every row; rows with the held-out remainder are not learnt from."""
    learnt = documents.select("doc_id", "text", "lang").filter(remainder("doc_id", parts) != held_out)
    found = identify(documents, fit(learnt))
    aside = F.coalesce(remainder("doc_id", parts) == held_out, F.lit(False))
    return found.select("doc_id", aside.alias("held_out"), "lang_pred", "score", "entropy", "rejected")

"""Language, whitening and resampling against plain Python, with their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tiersift.llm import importance, language_id, whitening

SF = "/root/testdata/sf0.001"


def docs(spark, rows, extra="lang string"):
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra}")


# --- language


def words_of(text):
    return re.findall(r"[^\W\d_]+", text.lower())


class PlainKneserNey:
    """Interpolated Kneser-Ney with dictionaries, by the recursive definition."""

    def __init__(self, texts, n_symbols):
        self.order, self.n_symbols = language_id.ORDER, n_symbols
        raw = defaultdict(Counter)
        for text in texts:
            for w in words_of(text):
                padded = f" {w} "
                for i in range(1, len(padded)):
                    for n in range(1, self.order + 1):
                        if i - n + 1 >= 0:
                            raw[n][padded[i - n + 1:i + 1]] += 1
        self.c = {self.order: raw[self.order]}
        for n in range(self.order - 1, 0, -1):
            own = Counter(g[1:] for g in self.c[n + 1])
            own.update({g: c for g, c in raw[n].items() if g[0] == " " and n > 1})
            self.c[n] = own
        self.d = {}
        for n, own in self.c.items():
            one, two = (sum(c == k for c in own.values()) for k in (1, 2))
            self.d[n] = one / (one + 2 * two) if one and two else 0.5

    def p(self, gram):
        if not gram:
            return 1 / self.n_symbols
        own, context = self.c[len(gram)], gram[:-1]
        mine = {g: c for g, c in own.items() if g[:-1] == context}
        total = sum(mine.values())
        if not total:
            return self.p(gram[1:])
        d = self.d[len(gram)]
        return max(mine.get(gram, 0) - d, 0) / total + d * len(mine) / total * self.p(gram[1:])

    def log(self, text):
        total = 0.0
        for w in words_of(text):
            padded = f" {w} "
            total += sum(math.log(self.p(padded[max(0, i - self.order + 1):i + 1])) for i in range(1, len(padded)))
        return total


TEXTS = {"en": "the cat sat on the mat and the hat", "fr": "le chat est sur la table et le chien été", "xx": "zzz yyxy zyzy"}


def test_character_model_equals_the_plain_definition(spark):
    rows = docs(spark, [(i, t, lang) for i, (lang, t) in enumerate(TEXTS.items())])
    table = language_id.probabilities(language_id.gram_counts(rows)).collect()
    n_symbols = len({c for t in TEXTS.values() for w in words_of(t) for c in w} | {" "}) + 1
    for lang, text in TEXTS.items():
        plain = PlainKneserNey([text], n_symbols)
        own = {r["gram"]: r for r in table if r["lang"] == lang}
        assert set(own) - {""} == {g for c in plain.c.values() for g in c}
        for gram, r in own.items():
            if gram:
                assert r["p"] == pytest.approx(plain.p(gram), rel=1e-9), (lang, gram)
        for context in {g[:-1] for g in own if len(g) == 3}:  # a context leaves no probability over
            inside = sum(plain.p(context + c) for c in {g[-1] for g in plain.c[1]})
            assert inside <= 1 + 1e-9


def test_scores_equal_the_plain_definition(spark):
    rows = docs(spark, [(i, f"{t} {t}", lang) for i in range(300) for lang, t in [list(TEXTS.items())[i % 3]]])
    model = language_id.fit(rows)
    aside = {r[0] for r in rows.selectExpr(f"doc_id", f"pmod(xxhash64(doc_id, 41), {language_id.CALIBRATING}) = 0 AS a").collect() if r[1]}
    n_symbols = len({c for t in TEXTS.values() for w in words_of(t) for c in w} | {" "}) + 1
    plain = []
    for k, (_, text) in enumerate(sorted(TEXTS.items())):
        place = list(TEXTS).index(sorted(TEXTS)[k])
        plain.append(PlainKneserNey([f"{text} {text}"] * sum(i % 3 == place and i not in aside for i in range(300)), n_symbols))
    for text in ("the chat", "ça va, Cat?", "q", "zyzyx y"):
        judged = model.judge([text], {}).iloc[0]
        logs = [p.log(text) for p in plain]
        n = sum(len(w) + 1 for w in words_of(text))
        assert judged["entropy"] == pytest.approx(-max(logs) / n, rel=1e-4)
        assert judged["margin"] == pytest.approx(sorted(logs)[-1] - sorted(logs)[-2], rel=1e-3, abs=1e-4)


def test_held_out_languages_are_told_and_others_rejected(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    known = language_id.language_scores(documents)
    assert known.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    got = {r["doc_id"]: r for r in known.collect()}
    want = {r["doc_id"]: r["lang"] for r in documents.collect()}
    aside = [d for d, r in got.items() if r["held_out"]]
    assert all((zlib.crc32(str(d).encode()) % 4 == 2) == r["held_out"] for d, r in got.items())
    assert sum(got[d]["lang_pred"] == want[d] for d in aside) >= 0.97 * len(aside)
    foreign = docs(spark, [(1, "Ζητώ συγγνώμη για την καθυστέρηση στην απάντηση", None), (2, "12 34 !!", None), (3, None, None), (4, "", None)])
    model = language_id.fit(documents)
    other = {r["doc_id"]: r for r in language_id.identify(foreign, model).collect()}
    assert all(r["rejected"] for r in other.values())
    assert [other[i]["lang_pred"] for i in (2, 3, 4)] == ["und"] * 3 and other[1]["lang_pred"] in set(want.values())


def test_language_edge_cases(spark):
    rows = [(1, "eins zwei drei", "de"), (1, "eins zwei drei", "de"), (None, "one two", "en"), (2, None, "en"), (3, "x" * 200_000, None),
            (5, "…", "de"), (6, "vier fünf sechs", "de")]
    more = docs(spark, [(*r, 1, 2) for r in rows], "lang string, score int, known int")
    got = language_id.language_scores(more).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} <= {"de", "und"}
    assert sum(r["lang_pred"] == "und" for r in got) == 2 and all(0 <= r["score"] <= 1 for r in got)
    empty = docs(spark, [])
    assert language_id.language_scores(empty).collect() == []
    nothing = docs(spark, [(1, "some text", None)])
    assert [r["lang_pred"] for r in language_id.language_scores(nothing).collect()] == ["und"]


def test_a_smaller_model_still_tells_languages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(documents, max_entries=3000)
    assert sum(len(m.hashes) for m in model.models) <= 3000
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(documents, model).collect()}
    want = {r["doc_id"]: r["lang"] for r in documents.collect()}
    assert sum(got[d] == want[d] for d in want) >= 0.95 * len(want)


@pytest.mark.parametrize("entries", [3, 3000])
def test_a_model_too_large_for_a_task_gives_the_same_results(spark, entries):
    learnt = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    whole, large = language_id.fit(learnt), language_id.fit(learnt, max_entries=entries)
    assert large.partial and not whole.partial
    assert large.limit == pytest.approx(whole.limit) and large.values == pytest.approx(whole.values)
    text = learnt.filter("text IS NOT NULL").first()["text"]
    odd = docs(spark, [(1, text, "x"), (1, text, "x"), (None, text, "x"), (2, "Ζητώ συγγνώμη", "x"), (3, None, "x"), (4, "12 !", "x"),
                       (5, "zzzq " * 400, "x"), (6, "", "x")])
    both = learnt.select("doc_id", "text", "lang").unionByName(odd)
    want, got = ([(r["doc_id"] or -1, *r[1:]) for r in language_id.identify(both, m).collect()] for m in (whole, large))
    assert len(got) == len(want) == 158
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert (g[:2], g[4]) == (w[:2], w[4]) and g[2:4] == pytest.approx(w[2:4], rel=1e-9, abs=1e-12), (g, w)


# --- whitening


def test_whitening_equals_dense_eigenvectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    pdf = table.select("vec_id", "embedding").toPandas()
    x = np.floor(256 * np.stack(pdf["embedding"]).astype(float)).astype(np.int64)
    distinct = np.unique(x, axis=0)
    n, mean, sums = len(distinct), distinct.mean(0), distinct.sum(0)
    values, vectors = np.linalg.eigh((distinct - mean).T @ (distinct - mean) / n)
    got = whitening.whiten(table).toPandas()
    assert len(got) == 4 * len(pdf) and (got["n"] == n).all() and got["identity_error"].max() < 1e-9
    deviation = dict(zip(pdf["vec_id"], ((n * x - sums) ** 2).sum(1), strict=True))
    assert all(deviation[v] == d for v, d in zip(got["vec_id"], got["deviation"], strict=True))
    for k in range(1, 5):
        own = got[got["component"] == k].set_index("vec_id").loc[pdf["vec_id"]]
        want = (x - mean) @ vectors[:, -k] / np.sqrt(values[-k])
        assert min(abs(own["whitened"] - want).max(), abs(own["whitened"] + want).max()) < 1e-8
        assert own["explained"].iloc[0] == pytest.approx(values[-k] / values.sum(), rel=1e-10)


@pytest.mark.parametrize("rank", [1, 3, 7])
def test_cholesky_and_jacobi_on_any_rank(rank):
    draw = np.random.default_rng(rank)
    a = draw.normal(size=(7, rank)) * [10.0 ** -k for k in range(rank)]
    v = a @ a.T
    g = whitening.pivoted_cholesky(v)
    assert g.shape == (7, rank) and np.allclose(g @ g.T, v)
    values, vectors = whitening.components_of(v)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-8)
    assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-9)
    assert np.allclose(v @ vectors, vectors * values, atol=1e-9 * values[0])


def test_whitening_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "b"), (None, [3.0, 2.5], "c"), (2, None, "d"), (3, [nan, 1.0], "e"), (4, [inf, 1.0], "f"),
            (5, [None, 1.0], "g"), (6, [], "h"), (7, [1.0, 2.0, 3.0], "i"), (8, [-0.5, 0.001], "j")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string")
    got = whitening.whiten(table).collect()
    assert sorted((r["vec_id"] or 0, r["component"]) for r in got) == sorted(
        (v, c) for v in (0, 1, 1, 8) for c in (1, 2)) and {r["n"] for r in got} == {3}
    assert whitening.whiten(table.filter("vec_id = 99")).collect() == []
    assert whitening.whiten(table.filter("vec_id = 1")).collect() == []  # one vector has no spread
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1.0)
    far = spark.createDataFrame([(1, [1e17]), (2, [-1e300]), (3, [0.5])], "vec_id long, embedding array<double>")
    x, s = [2**63 - 1, -2**63, 128], 127
    want = [v if (v := (3 * c - s) ** 2) < 1 << 63 else None for c in x]
    assert [r["deviation"] for r in sorted(whitening.whiten(far).collect(), key=lambda r: r["vec_id"])] == want


# --- resampling


def plain_resample(rows, target, percent=10, buckets=10_000, longest=1):
    def feats(text):
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % buckets
                            for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
    found = [(d, *feats(t)) for d, t in rows]
    raw, wanted = Counter(b for _, _, f in found for b in f), Counter(b for t in target for b in feats(t)[1])
    s_all, t_all = sum(raw.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets)))) for b, s in raw.items()}
    out = []
    for d, words, f in found:
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([d, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = i
    return out


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_plain_python(spark, longest, monkeypatch):
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["Übung", "naïve", "A1b", "x-y", "日本"]
    rows = [(i, " ".join(draw.choices(vocabulary, k=draw.randrange(0, 80)))) for i in range(900)]
    rows += [(i, "same text of copies " * 8) for i in range(900, 1200)] + [(1300, None), (1301, ""), (1302, "long " * 50_000)]
    target = [" ".join(draw.choices(vocabulary[:60], k=50)) for _ in range(20)] + [None]
    monkeypatch.setattr(importance, "ROWS_PER_SEGMENT", 50)
    got = importance.resample(docs(spark, [(*r, None) for r in rows]).repartition(5),
                              spark.createDataFrame([(t,) for t in target], "text string"), longest=longest)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain_resample(rows, target, longest=longest)))


def test_ranks_of_equal_scores_and_repeated_ids(spark):
    table = spark.range(0, 5000, 1, 7).selectExpr("id % 40 AS doc_id", "id % 3 AS score", "id AS rank_", "id % 50 > 0 AS ok")
    got = importance.ranked(table, table["ok"], 0.5).collect()
    assert len(got) == 5000
    drawn = sorted((r["rank"], -r["score"], r["doc_id"]) for r in got if r["rank"])
    assert [r[0] for r in drawn] == list(range(1, 2451)) and [r[1:] for r in drawn] == sorted(r[1:] for r in drawn)


def test_resampling_edge_cases(spark):
    empty = docs(spark, [])
    assert importance.resample(empty, empty).collect() == []
    rows = docs(spark, [(None, "a b", "x"), (1, None, "y"), (1, "word " * 30, "z")] * 5, "segment string")
    got = importance.resample(rows, empty).collect()
    assert len(got) == 15 and [r["rank"] for r in got] == [None] * 15  # a tenth of five rows is none
    got = importance.resample(rows, empty, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2]

"""Families of rows just below the threshold: few of their pairs are written, each about once, and no link is lost."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tiersift.llm import line_dedup, linking, ngram_join


def rest_join(monkeypatch, module, run):
    """``node, node`` of every row that the join of rows in different groups would write, were all rows groups of their own."""
    seen = {}

    def link(blocks, verify, possible, **options):
        payload = ("node", *options["columns"])
        left, extra = blocks, ()
        if options.get("details") is not None:
            left, extra = blocks.join(options["details"], "node"), [c for c in options["details"].columns if c != "node"]
        met = left.select("block", F.struct(*payload, *extra).alias("l")).join(
            left.select("block", F.struct(*payload, *extra).alias("r")), "block").filter("l.node < r.node").filter(
            possible(F.col("l"), F.col("r")))
        seen["possible"] = {tuple(r) for r in met.select("l.node", "r.node").collect()}
        if options.get("close") is not None:
            met = met.filter(options["close"](F.col("l"), F.col("r")))
        seen["rows"] = Counter(tuple(r) for r in met.select("l.node", "r.node").collect())
        return linking.link_blocks(blocks, verify, possible, **options)

    monkeypatch.setattr(module, "link_blocks", link)
    run()
    return seen["possible"], seen["rows"]


def jaccard(x, y):
    return len(x & y) / len(x | y)


def test_pairs_of_texts_are_written_in_few_of_their_blocks(spark, monkeypatch):
    draw = random.Random(4)
    base, texts = [f"w{draw.randrange(10**6)}" for _ in range(260)], {}
    for i in range(24):
        words = list(base)
        for at in draw.sample(range(260), 2 if i % 8 == 0 else 7):
            words[at] = f"x{draw.randrange(10**6)}"
        texts[i] = words
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    result = []
    possible, written = rest_join(monkeypatch, ngram_join, lambda: result.extend(ngram_join.ngram_components(rows).collect()))
    sets = {i: {tuple(w[k:k + 4]) for k in range(len(w) - 3)} for i, w in texts.items()}
    near = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.85}
    assert near and near <= set(written) <= possible
    assert sum(written.values()) <= 2 * len(written)
    linked = {i for pair in near for i in pair}
    assert {r["doc_id"] for r in result if r["component_id"] != r["doc_id"]} <= linked


def test_a_pair_is_written_where_it_meets_first(spark, monkeypatch):
    """A repeated id has several sets: none of its pairs is left out."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (1, "one two three four five six"), (2, " ".join(["x", *words])), (3, "one two three four five six")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    _, written = rest_join(monkeypatch, ngram_join, lambda: found.extend(ngram_join.ngram_components(table).collect()))
    assert (1, 2) in written and {r["component_id"] for r in found} == {1}


def line_family(draw):
    base, lines = "".join(draw.choices("abcdefghijkl ", k=320)), []
    for i in range(30):
        line = base
        for at in draw.sample(range(320), 2 if i % 10 == 0 else 9):
            line = line[:at] + draw.choice("xyz") + line[at + 1:]
        lines.append(line)
    return lines


def test_near_misses_of_lines_are_told_apart_before_pairs_are_written(spark, monkeypatch):
    lines = line_family(random.Random(6))
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found, stored = [], line_dedup.materialize

    def kept(df, name="stage"):
        done = stored(df, name)
        if name == "classes":
            found.extend(done.select("node", "line").collect())
        return done

    monkeypatch.setattr(line_dedup, "materialize", kept)
    possible, written = rest_join(monkeypatch, line_dedup, lambda: line_dedup.duplicate_lines(table).collect())
    sets = {r["node"]: {r["line"][i:i + 5] for i in range(len(r["line"]) - 4)} for r in found}
    near = {p for p in possible if jaccard(sets[p[0]], sets[p[1]]) >= 0.8}
    assert near <= set(written) and len(possible) > 100
    assert len(written) <= 0.4 * len(possible)


def test_sketches_of_lines_bound_their_difference(spark):
    lines = [*line_family(random.Random(9))[:12], "ab", "abcde", "x" * 700, "ü" * 3 + "abc def"]
    rows = {r["node"]: r for r in line_dedup.sketches(spark.createDataFrame(list(enumerate(lines)), "node long, line string")).collect()}
    sets = [{x[i:i + 5] for i in range(len(x) - 4)} or {x} for x in lines]
    for a, x in enumerate(sets):
        assert rows[a]["n"] == len(x) and sum((o & (1 << 64) - 1).bit_count() for o in rows[a]["odd"]) <= len(x)
        for b, y in enumerate(sets):
            apart = sum(((i ^ j) & (1 << 64) - 1).bit_count() for i, j in zip(rows[a]["odd"], rows[b]["odd"], strict=True))
            assert apart <= len(x ^ y) and (a == b or len(x ^ y) > 4) >= (apart == 0)


@pytest.mark.parametrize("limit", [0, 10**6])
def test_texts_of_lines_are_fetched_with_few_or_many_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "_BROADCAST_IDS", limit)
    monkeypatch.setattr(ngram_join, "_BROADCAST_IDS", limit)
    lines = line_family(random.Random(6))[:21:10] + ["some other line of text", "another line that stands alone"]
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.duplicate_lines(table).collect()} == {1, 2}
    words = [f"w{i}" for i in range(60)]
    texts = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(["x", *words])), (3, "apart from them all")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(texts).collect()} == {1: 1, 2: 1, 3: 3}


def test_keys_shared_by_lines_of_other_sizes_only_are_left_out(spark, monkeypatch):
    """A shingle that lines of all sizes have is a key of short ones; those that no line of a fitting size shares go no further."""
    lines = ["common" + "".join(chr(97 + (7 * i * k + k * k) % 26) for i in range(1, 3 + k)) for k in range(1, 26, 6)]
    lines += ["a line of words that has a near copy", "a line of words that has a near copy!"]
    stored, sizes = line_dedup.materialize, {}

    def counted(df, name="stage"):
        done = stored(df, name)
        sizes[name] = done.count()
        return done

    monkeypatch.setattr(line_dedup, "materialize", counted)
    table = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r["doc_id"] for r in line_dedup.duplicate_lines(table).collect()} == {6}
    assert sizes["nodes"] == 2

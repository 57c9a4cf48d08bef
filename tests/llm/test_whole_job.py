"""What the operators must find or keep beyond the planted cases of the given tables."""

import random

import corpus_pipeline
from tiersift.llm import decontaminate, line_dedup, pseudonyms


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def line_shingles(line):
    return {line[i:i + 5] for i in range(len(line) - 4)} if len(line) >= 5 else {line}


def alike(a, b):
    a, b = line_shingles(a), line_shingles(b)
    return len(a & b) >= 0.8 * len(a | b)


def found(spark, pairs):
    """Which of the pairs of lines lose their second line."""
    docs = [(2 * i + k, line) for i, pair in enumerate(pairs) for k, line in enumerate(pair)]
    gone = {r["doc_id"] for r in line_dedup.duplicate_lines(table(spark, docs)).collect()}
    assert all(d % 2 for d in gone)
    return [2 * i + 1 in gone for i in range(len(pairs))]


def run(draw, n, letters="abcdefghijklmnopqrstuvwxyz0123456789"):
    return "".join(draw.choice(letters) for _ in range(n))


def test_two_words_with_one_changed_are_found(spark):
    draw, pairs = random.Random(11), []
    for _ in range(60):
        first, second = run(draw, 30), run(draw, 30)
        pairs.append((f"{first} {second}", f"{first} #{second[1:]}"))
    assert all(alike(*p) for p in pairs)
    assert sum(found(spark, pairs)) >= 45


def edited(draw, line, letters):
    """The line with single characters changed while it stays similar."""
    new = line
    while True:
        i = draw.randrange(len(line))
        more = new[:i] + draw.choice(letters) + new[i + 1:]
        if not alike(line, more):
            return new
        new = more


def test_lines_without_blanks_and_short_lines_are_found(spark):
    draw, pairs = random.Random(12), []
    chinese = "".join(map(chr, range(0x4E00, 0x5000)))
    for _ in range(40):  # a change near the start, no blank anywhere
        line = run(draw, 80, chinese)
        pairs.append((line, "x" + line[1:3] + "y" + line[4:]))
        line = f"https://{run(draw, 70)}"
        pairs.append((line, line[:40] + "#" + line[41:]))
    latin = "abcdefghijklmnopqrstuvwxyz"
    for n_words in (1, 2, 3):
        for _ in range(40):
            line = " ".join(run(draw, draw.randrange(10, 30), latin) for _ in range(n_words))
            pairs.append((line, edited(draw, line, latin)))
    for length in (25, 34, 60, 90, 300):  # about the limits between the kinds of keys
        for _ in range(40):
            line = run(draw, length, latin + "    ")
            pairs.append((line, edited(draw, line, latin)))
    pairs = [p for p in pairs if p[0] != p[1] and alike(*p)]
    assert sum(found(spark, pairs)) >= 0.99 * len(pairs)


def test_every_character_of_an_address_changes_the_others(spark):
    names = ["anna.bell", "bnna.bell", "anna.belk", "anna.cell"]
    rows = [(i, f"{n}@mail.some-long-domain.example") for i, n in enumerate(names)] + [(9, "anna.bell@other.example")]
    got = {r["doc_id"]: r["text"] for r in pseudonyms.with_pseudonyms(table(spark, rows), "k").collect()}
    assert len(set(got.values())) == len(rows) and all(v.count("@") == 1 for v in got.values())
    for i in (1, 2, 3):
        assert got[i].split("@")[1] == "mail.some-long-domain.example"
        assert sum(a != b for a, b in zip(got[0].split("@")[0], got[i].split("@")[0], strict=True)) > 2


def test_near_copies_of_five_words_and_four_fifths_go(spark):
    base = [f"w{i}" for i in range(500)]
    other = base[:200] + [f"x{i}" for i in range(45)] + base[245:]
    docs = spark.createDataFrame([(1, " ".join(base), "en", "s", 1), (2, " ".join(other), "en", "s", 1)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.one_of_near_copies(spark, docs, "").collect()] == [1]


def test_a_long_item_does_not_loosen_short_ones(spark):
    draw = random.Random(13)
    short = [f"s{i}" for i in range(30)]
    long = [f"l{i}" for i in range(2000)]
    scattered = [f"n{i}" for i in range(3000)]
    for k, w in enumerate(draw.sample(short, 30)):
        scattered[k * 60] = w
    rows = [(1, " ".join(scattered)), (2, " ".join(scattered[:100:3] + short)), (3, " ".join(long))]
    items = [(1, " ".join(short)), (2, " ".join(long))] + [(i, " ".join(f"o{i}x{k}" for k in range(10 + i))) for i in range(3, 20)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one, several = (decontaminate.leaks(table(spark, rows), benchmark, max_words=m).collect() for m in (10**6, 500))
    assert {(r["doc_id"], r["item_id"]) for r in one} == {(2, 1), (3, 2)}
    assert sorted(map(tuple, one)) == sorted(map(tuple, several))


def test_separators_and_parts_do_not_change_results(spark):
    rows = [(1, "4111-1111-1111-1111 x 212-555-0100"), (2, "4111 1111 1111 1111 x 212.555.0100")]
    got = {r["doc_id"]: r["text"] for r in pseudonyms.with_pseudonyms(table(spark, rows), "k").collect()}
    assert [c for c in got[1] if c.isdigit()] == [c for c in got[2] if c.isdigit()]
    draw = random.Random(14)
    items = [(i, " ".join(draw.choices([f"u{k}" for k in range(80)], k=draw.randrange(14, 60)))) for i in range(40)]
    docs = [(i, text.rsplit(" ", 2)[0]) for i, text in items]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    one, several = ({(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.leaks(
        table(spark, docs), benchmark, max_words=m).collect()} for m in (10**6, 500))
    assert one and one.keys() == several.keys() and all(abs(one[k] - several[k]) < 1e-9 for k in one)

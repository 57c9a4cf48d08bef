"""Every stage works on what the one before kept."""

import corpus_pipeline
from pyspark.sql import functions as F

from tiersift.llm import decontaminate, line_dedup, ngram_join, quality_model
from tiersift.runtime import materialize

SF = "/root/testdata/sf0.001"


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_apply_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, SF), name)
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    before, after = kept["quality"]
    scored = quality_model.quality_scores(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(scored.filter("predicted = 1"))
    before, after = kept["lines"]
    words = after.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(line_dedup.WORD))
    assert ids(after) <= ids(before) and ids(words) <= ids(before.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(line_dedup.WORD)))
    emptied = ids(line_dedup.dedup_lines(before).filter("_n_kept < _n_lines").filter(~F.col("text").rlike(line_dedup.WORD)))
    assert ids(after) == ids(before) - emptied and emptied
    assert after.filter(F.col("n_chars") != F.char_length("text")).isEmpty()
    before, after = kept["near_copies"]
    assert ids(after) == ids(ngram_join.ngram_components(before, width=5, threshold_percent=80).filter("doc_id = component_id"))
    before, after = kept["leaks"]
    assert ids(after) == ids(before) - ids(decontaminate.leaks(before, spark.read.parquet(f"{SF}/benchmark.parquet")))
    before, after = kept["packing"]
    assert ids(after) == ids(before)


def test_rows_without_an_id_or_text_pass(spark):
    docs = spark.createDataFrame([(None, "a b", "en", "s", 3), (5, None, "en", "s", 0)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        docs = materialize(stage(spark, docs, SF), "stage")
        assert docs.count() == 2


def test_a_column_named_like_a_working_one_stays(spark):
    docs = spark.createDataFrame([(1, "a", "u"), (2, "b", "v")], "doc_id long, text string, _gone string")
    left = corpus_pipeline._without(docs, spark.createDataFrame([(1,)], "doc_id long"))
    assert [tuple(r) for r in left.collect()] == [(2, "b", "v")]

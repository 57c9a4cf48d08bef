import json

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tiersift.operators import classifier, clusters, evaluation, merge, reports, scoring
from tiersift.plans.triage import Settings, simple_triage, triage
from tiersift.runtime import materialize
from tiersift.sources.store import ResultStore
from workload.fixtures import emails
from workload.labeller import wording_labeller

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def messages(spark):
    return materialize(emails(spark, SF), "emails")


def tier(spark, *rows):
    return spark.createDataFrame(rows, "email_id long, label string, confidence double, source string")


def test_merge_prefers_confidence_then_the_earlier_tier(spark, make_emails):
    final = {r["email_id"]: r for r in merge.merge_tiers(make_emails({}, {}, {}, {}), [
        tier(spark, (0, "UNKNOWN", 0.5, "rules"), (1, "GOOD", 0.9, "rules"), (2, "UNKNOWN", 0.5, "rules")),
        tier(spark, (0, "BAD", 0.97, "ml"), (1, "BAD", 0.9, "ml")),
        tier(spark, (2, "BAD", 0.45, "llm_propagated"))]).collect()}
    assert (final[0]["label"], final[0]["all_sources"]) == ("BAD", ["rules", "ml"])
    assert (final[1]["label"], final[1]["source"]) == ("GOOD", "rules")
    assert (final[2]["label"], final[2]["all_sources"]) == ("UNKNOWN", ["rules", "llm_propagated"])
    assert (final[3]["label"], final[3]["confidence"], final[3]["source"], final[3]["all_sources"]) == ("UNKNOWN", 0.0, "none", [])


def test_missing_probability_is_ambiguous(spark):
    rows = spark.createDataFrame([(1, 0.96, 0.04), (2, 0.5, 0.5), (3, None, None)], "email_id long, prob_good double, prob_bad double")
    got = {r["email_id"]: (r["label"], r["auto"]) for r in merge.split_by_confidence(rows).collect()}
    assert got == {1: ("GOOD", True), 2: ("GOOD", False), 3: ("GOOD", False)}


def test_summary_of_an_empty_run_is_empty(spark):
    empty = spark.createDataFrame([], "label string, source string, confidence double")
    assert reports.run_summary(empty).count() == 0


def test_report_with_an_absent_class(spark):
    rows = spark.createDataFrame([(1, 1), (1, 1)], "t int, p int")
    got = {r["class"]: r for r in evaluation.report(rows, "t", "p").collect()}
    assert (got["0"]["precision"], got["0"]["support"], got["accuracy"]["f1"]) == (0.0, 0, 1.0)


def test_split_is_exact_per_class_and_independent_of_partitions(spark):
    rows = spark.range(1003).select(F.col("id").alias("email_id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    for buckets in (1, 16, 65536):
        split = classifier.stratified_split(rows.repartition(3), buckets=buckets)
        got = {(r["y"], r["is_test"]): r["n"] for r in split.groupBy("y", "is_test").agg(F.count("*").alias("n")).collect()}
        assert got == {(0, True): 150, (0, False): 602, (1, True): 50, (1, False): 201}
    ids = {r["email_id"] for r in split.filter("is_test").collect()}
    again = classifier.stratified_split(rows.repartition(7), buckets=4)
    assert len(ids) == 200 and again.filter("is_test").count() == 200


def test_fit_minimises_the_balanced_penalised_loss(spark, messages):
    """Against a dense Newton solve with centred features and population deviations."""
    from tiersift.operators import rules
    training = materialize(classifier.training_set(messages, rules.classify(messages)), "t")
    model = classifier.fit(training, tol=1e-12, max_features=40)
    stages = model.stages.stages
    rows = training
    assembled = classifier._assembled(training, None, ("email_id", "y"))
    for stage in stages[:-2]:
        assembled = stage.transform(assembled)
    rows = assembled.select("email_id", "y", vector_to_array("raw_features").alias("x")).orderBy("email_id").collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float)
    std = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(std > 0, std, 1)
    n = len(y)
    s = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    a, w = np.hstack([z, np.ones((n, 1))]), np.zeros(z.shape[1] + 1)
    penalty = np.r_[np.ones(z.shape[1]), 0]
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        gradient = a.T @ (s * (p - y)) + penalty * w
        hessian = (a * (s * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-12)
        w -= np.linalg.solve(hessian, gradient)
    want = 1 / (1 + np.exp(-a @ w))
    got = np.array([r["prob_bad"] for r in model.score(training).orderBy("email_id").collect()])
    assert np.abs(got - want).max() < 1e-3


def test_kmeans_assigns_to_the_nearest_centre_and_reps_are_members(spark):
    rng = np.random.default_rng(0)
    data = np.vstack([rng.normal(c, 0.1, size=(15, 3)) for c in (0, 5, 9)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(data)], "email_id long, embedding array<double>")
    assigned, centers = clusters.kmeans(df, k=3, n_init=3)
    where = {r["email_id"]: r["cluster_id"] for r in assigned.collect()}
    middle = {r["cluster_id"]: np.array(r["center"]) for r in centers.collect()}
    assert all(where[i] == min(middle, key=lambda c: np.linalg.norm(middle[c] - r)) for i, r in enumerate(data))
    reps = {r["cluster_id"]: r["rep_email_id"] for r in clusters.representatives(df, assigned, centers).collect()}
    for c, rep in reps.items():
        mine = [i for i in where if where[i] == c]
        assert rep == min(mine, key=lambda i: (np.linalg.norm(data[i] - middle[c]), i))


@pytest.mark.parametrize("n,text,embedding", [(0, 0, 0), (1, 1, 1), (2, 2, 1), (30, 3, 6), (5000, 100, 20)])
def test_cluster_counts(spark, n, text, embedding):
    r = clusters.cluster_counts(spark.range(n)).first()
    assert (r["n"], r["k_text"], r["k_embedding"]) == (n, text, embedding)


def parse(spark, *texts):
    df = spark.createDataFrame([(i, t, ["a"]) for i, t in enumerate(texts)], "batch_id long, response string, expected_ids array<string>")
    return df, scoring.parse_responses(df)


def test_response_validation(spark):
    ok = {"id": "a", "label": "GOOD", "confidence": 0.25, "reason": "r"}
    df, got = parse(
        spark, json.dumps([ok]), "```json\n" + json.dumps([ok]) + "\n```", "```\n[]\n```", "{}", "[1, \"x\", null, []]",
        json.dumps([ok, {"id": "b", "label": 5}]), json.dumps([ok, {"id": "b", "label": None}]), json.dumps([ok, {"label": 5}]),
        json.dumps([{"id": None, "label": "bad", "confidence": True}, {"id": 7, "label": "Bad", "confidence": "0.9", "reason": None},
                    {"id": True, "label": "bad", "confidence": 12}, {"id": "z", "label": "maybe"}]), None, "[{\"id\": ")
    rows = {}
    for r in got.collect():
        rows.setdefault(r["batch_id"], []).append((r["id"], r["label"], r["confidence"], r["reason"]))
    one = [("a", "GOOD", 0.25, "r")]
    assert rows.pop(0) == one and rows.pop(1) == one and rows.pop(7) == one
    assert sorted(rows.pop(8)) == [("7", "BAD", 0.5, "None"), ("None", "BAD", 1.0, "No reason provided"),
                                   ("True", "BAD", 1.0, "No reason provided")]
    assert rows == {}
    assert scoring.missing_ids(df, got).count() == 8


def test_a_failing_batch_does_not_stop_the_others(spark):
    def build():
        def call(prompt):
            if "bad" in prompt:
                raise ValueError("no")
            return "[]"
        return call
    prompts = spark.createDataFrame([(0, "bad", ["a"]), (1, "fine", ["b"])], "batch_id long, prompt string, expected_ids array<string>")
    got = {r["batch_id"]: (r["response"], r["error"]) for r in scoring.score_batches(prompts, build, parallelism=2).collect()}
    assert got == {0: (None, "ValueError: no"), 1: ("[]", None)}


def test_embed_builds_one_model_per_task(spark, make_emails):
    df = clusters.embed(make_emails({"subject": "ab"}, {"subject": "abc"}),
                        lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], F.col("subject"))
    assert sorted(map(tuple, (r["embedding"] for r in df.collect()))) == [(2.0, 1.0), (3.0, 1.0)]


def test_whole_run_labels_every_message_once(spark, messages, tmp_path):
    store = ResultStore(spark, str(tmp_path / "store"))
    settings = Settings(n_init=2)
    run = triage(messages, labeller=wording_labeller, store=store, settings=settings)
    final = run.final.collect()
    assert len(final) == messages.count() == len({r["email_id"] for r in final})
    assert sum(r["n"] for r in run.funnel().collect()) == len(final)
    members = {(r["email_id"], r["cluster_id"]) for r in run.assignments.collect()}
    assert all((r["rep_email_id"], r["cluster_id"]) in members for r in run.representatives.collect())
    assert store.current().count() == messages.select("fingerprint").distinct().count()
    assert store.metadata().count() == messages.select("fingerprint").distinct().count()
    again = simple_triage(messages, store=store)
    assert again.final.count() == len(final)


def test_without_a_model_every_open_message_is_ambiguous(spark, make_emails):
    rows = make_emails(*[{"fingerprint": f"f{i}", "sender_domain": "x.org", "snippet": f"word{i % 3} text"} for i in range(12)])
    run = triage(rows, labeller=wording_labeller, settings=Settings(n_init=1))
    assert run.by_model is None and run.ambiguous.count() == 12 and run.final.count() == 12


def test_kmeans_passes_over_a_small_table_use_every_core_and_add_entries(spark, monkeypatch):
    draw = np.random.default_rng(3)
    rows = [(i, [float(x) for x in draw.normal(10 * (i % 3), 0.1, 4)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "email_id long, embedding array<double>").coalesce(1)
    tasks, plain = set(), clusters._pass

    def watched(blocks, centers, running):
        tasks.add(blocks.rdd.getNumPartitions())
        sums, counts, cost = plain(blocks, centers, running)
        x = np.array([r[1] for r in rows])
        for own, (start, found) in zip(np.flatnonzero(running), enumerate(sums), strict=True):
            near = ((x[:, None] - centers[own]) ** 2).sum(2).argmin(1)
            for j in range(centers.shape[1]):
                assert np.allclose(found[j], x[near == j].sum(0)) and counts[start, j] == (near == j).sum()
        return sums, counts, cost

    monkeypatch.setattr(clusters, "_pass", watched)
    assigned, _ = clusters.kmeans(vectors, 3, n_init=2)
    assert tasks == {spark.sparkContext.defaultParallelism}
    groups = {}
    for r in assigned.collect():
        groups.setdefault(r["cluster_id"], set()).add(r["email_id"] % 3)
    assert sorted(map(len, groups.values())) == [1, 1, 1]

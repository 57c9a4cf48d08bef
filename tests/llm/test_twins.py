"""Learners and reductions against plain Python forms of the same definition."""

import itertools
import math
import random

import numpy as np
import pytest

from tiersift.llm import id_coder, packing, quality_model, toxicity


def test_ftrl_equals_the_loop_by_coordinate():
    draw = random.Random(1)
    examples = [(sorted({0, *draw.sample(range(1, 40), 6)}), float(draw.random() < 0.4)) for _ in range(300)]
    learner, z, n = toxicity.Ftrl.fresh(), dict.fromkeys(range(40), 0.0), dict.fromkeys(range(40), 0.0)

    def weight(i):
        limit = 0.0 if i == 0 else toxicity.L1
        if abs(z[i]) <= limit:
            return 0.0
        return -(z[i] - math.copysign(limit, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for at, y in examples * 3:
        learner.learn(np.array(at), y)
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - y
        for i in at:
            rate = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA
            z[i] += g - rate * w[i]
            n[i] += g * g
    assert np.allclose(learner.weights(np.arange(40)), [weight(i) for i in range(40)], atol=1e-12)


def test_ridge_equals_the_dense_solution_and_calibration_the_pooled_one(spark):
    draw = np.random.default_rng(2)
    width = len(quality_model.FEATURES)
    x = draw.normal(size=(300, width))
    y = (x[:, 0] + 0.3 * draw.normal(size=300) > 0).astype(int)
    stats = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, x array<double>")
    labels = spark.createDataFrame([(i, int(v), i % 4) for i, v in enumerate(y)], "doc_id long, y int, fold int")
    model = quality_model.fit(stats.repartition(3), labels)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    assert np.allclose(model.mean, mean) and np.allclose(model.scale, scale)
    p = quality_model.fourier(x, mean, scale)

    def ridge(rows):
        return np.linalg.solve(p[rows].T @ p[rows] + quality_model.RIDGE * np.eye(p.shape[1]), p[rows].T @ y[rows])

    assert np.allclose(model.weights, ridge(np.arange(300)), atol=1e-6)
    raw = np.empty(300)
    for fold in range(4):
        own = np.arange(300) % 4 == fold
        raw[own] = p[own] @ ridge(~own)
    bins = np.floor((np.clip(raw, -1, 2) + 1) / 3 * quality_model.BINS).astype(int)
    want = pooled(bins, y)
    got = np.interp(-1 + 3 * np.array(sorted(set(bins))) / quality_model.BINS, model.knots, model.values)
    assert np.abs(np.array([want[b] for b in sorted(set(bins))]) - got).max() < 0.35  # knots lie at the middle of a block
    assert np.allclose(sorted(set(np.round(list(want.values()), 9))), sorted(set(np.round(model.values, 9))))


def pooled(bins, y):
    """Isotonic means by the max-min formula: the largest over starts of the smallest mean up to any end."""
    order = sorted(set(bins))
    n, good = [(bins == b).sum() for b in order], [y[bins == b].sum() for b in order]
    up = lambda i, j: sum(good[i:j + 1]) / sum(n[i:j + 1])
    return {b: max(min(up(i, j) for j in range(k, len(order))) for i in range(k + 1)) for k, b in enumerate(order)}


def fewest(sizes, capacity):
    """The least number of sequences, by search."""
    best = [len(sizes)]

    def place(at, rooms):
        if len(rooms) >= best[0]:
            return
        if at == len(sizes):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[at]:
                rest = list(rooms)
                rest.remove(room)
                place(at + 1, [*rest, room - sizes[at]])
        place(at + 1, [*rooms, capacity - sizes[at]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum(seed):
    draw = random.Random(seed)
    capacity = draw.choice([10, 13, 20])
    sizes = sorted((draw.randrange(1, capacity + 1) for _ in range(draw.randrange(1, 10))), reverse=True)
    counts = {w: sizes.count(w) for w in set(sizes)}
    plan = packing._Plan(counts, capacity)
    packing._reduce(plan)
    left = sorted(itertools.chain.from_iterable([w] * n for w, n in plan.left.items()), reverse=True)
    assert plan.sequences + fewest(left, capacity) == fewest(sizes, capacity)


def test_blocks_are_coded_in_bounded_groups(monkeypatch):
    monkeypatch.setattr(id_coder, "LANES", 3)
    monkeypatch.setattr(id_coder, "BLOCK", 50)
    draw = np.random.default_rng(6)
    widest = []
    real = id_coder._Model.__init__

    def init(self, lanes):
        widest.append(lanes)
        real(self, lanes)

    monkeypatch.setattr(id_coder._Model, "__init__", init)
    for n in (0, 1, 49, 50, 151, 777):
        ids = draw.integers(0, 1 << 16, n)
        assert id_coder.decode_blocks(id_coder.encode_blocks(ids)).tolist() == ids.tolist()
    assert max(widest) == 3
    with pytest.raises(ValueError, match="65,536"):
        id_coder.encode_blocks(np.array([1 << 16]))

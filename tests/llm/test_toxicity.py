"""Toxicity: held-out accuracy, sparse weights, edge cases."""

import random

import numpy as np

from tidemark.llm import toxicity
from tidemark.llm.common import bucket_of


def test_learns_the_words_that_matter(spark):
    rng = random.Random(4)
    plain, bad = [f"w{i}" for i in range(400)], ["moron", "scum", "loser"]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 3 == 0
        words = [rng.choice(plain) for _ in range(rng.randint(20, 300))] + ([rng.choice(bad).title() + "," for _ in range(2)] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic) if i % 50 else None))
    rows += [(5000, None, "x"), (5001, "", "x"), (3, rows[3][1], "again"), (None, "moron scum", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    weights = toxicity.train(docs, known.where(~toxicity.held_out()), 500)
    assert 0 < np.count_nonzero(weights.values) < 2000
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(docs, weights).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    right = [(s >= 0.5) == (i % 3 == 0) for i, s in got if i is not None and i < 1200 and bucket_of(i, 5) == 0]
    assert sum(right) / len(right) > 0.98
    assert toxicity.score(docs.limit(0), weights).count() == 0
    none = toxicity.train(docs, known.where("toxic = 1"))
    assert toxicity.probability("moron", none) == 0.0


def test_weights_equal_the_plain_algorithm(monkeypatch):
    """Per-coordinate FTRL-proximal, one coordinate at a time, in the same order of examples."""
    import math

    monkeypatch.setattr(toxicity, "EPOCHS", 3)
    rng = random.Random(9)
    examples = [(np.unique([rng.randint(0, 40) + 40 * (y and rng.random() < 0.5) for _ in range(12)]).astype(np.int32), y) for y in (0, 1) * 60]
    got = toxicity.fit(examples)
    df = {}
    for at, _ in examples:
        for i in at.tolist():
            df[i] = df.get(i, 0) + 1
    z, n, bias = {}, {}, 2**toxicity.BITS

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= toxicity.L1 else -(v - math.copysign(toxicity.L1, v)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for epoch in range(3):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            at, y = [i for i in examples[k][0].tolist() if df[i] >= toxicity.MIN_DOCS] + [bias], examples[k][1]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i in at:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in z if weight(i) and i != bias}
    assert set(want) == set(got.at.tolist()) and all(abs(want[i] - v) < 1e-5 for i, v in zip(got.at.tolist(), got.values.tolist())) and abs(weight(bias) - got.bias) < 1e-5


def test_shift_restores_the_share():
    sums, labels = np.array([1.0] * 50 + [-1.0] * 50), np.array([1] * 40 + [0] * 10 + [1] * 10 + [0] * 40)
    even, rare = toxicity.shift(sums, labels, 0.5), toxicity.shift(sums, labels, 0.05)
    assert abs(even) < 0.1 and rare < -2

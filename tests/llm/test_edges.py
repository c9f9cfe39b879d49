"""Clashing columns, repeated ids and long texts in mixing, language ID and the shared helpers."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, langid, mixing, packing


def test_mix_keeps_clashing_columns_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    names = ["size", "taken", "passes", "quota", "shards", "picked", "target", "all", "copy", "_rest", "block"]
    rows = [(1, "a", long, *range(11)), (2, "b", "x y z " * 2000, *range(11)), (None, "b", "p q", *range(11)), (None, "b", "p q", *range(11)), (4, None, None, *range(11))]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = mixing.apply_mix(docs)
    assert got.columns == docs.columns
    found = got.collect()
    assert all([r[n] for n in names] == list(range(11)) for r in found)
    words = defaultdict(int)
    for r in found:
        words[r["source"]] += len(r["text"].split())
    goal = mixing.targets([("a", 100_000), ("b", 6004), (None, 0)], (5, 2, 1), 3)
    assert all(abs(words[s] - goal[s]) <= 1 for s in goal)
    assert mixing.mix(docs.withColumn("size", F.lit(3).cast("long"))).columns[-5:] == ["source_size", "target", "passes", "picked", "taken"]


def plain_kneser_ney(docs, order, k):
    """Interpolated Kneser-Ney by its recursion, from counts in dictionaries."""
    levels = {order: Counter(tuple(g) for d in docs for g in ngrams(d, order))}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])

    def probability(context, c):
        if len(context) == 0 and c is None:
            return 1 / k
        n = len(context) + 1
        counts = levels[n]
        once, twice = sum(v == 1 for v in counts.values()), sum(v == 2 for v in counts.values())
        discount = once / (once + 2 * twice) if once else 0.5
        lower = probability(context[1:], c) if context else 1 / k
        total = sum(v for g, v in counts.items() if g[:-1] == context)
        if not total:
            return lower
        kinds = sum(g[:-1] == context for g in counts)
        return max(counts.get((*context, c), 0) - discount, 0) / total + discount * kinds / total * lower

    return probability


def ngrams(classes, n):
    padded = [0] * (n - 1) + list(classes)
    return [padded[i:i + n] for i in range(len(classes))]


def test_language_model_is_interpolated_kneser_ney(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aab bcd") for _ in range(60)) for _ in range(8)]
    model = langid.Model({"xx": texts})
    learnt = [model._classes(langid.code_points(t)).tolist() for i, t in enumerate(texts) if i % 4]
    plain = plain_kneser_ney(learnt, langid.ORDER, model.k)
    probe = ["abcd aab", "zzz", "d d d dca", "ab" * 10]
    for t in probe:
        classes = model._classes(langid.code_points(t))
        want = [plain(tuple(g[:-1]), g[-1]) for g in ngrams(classes.tolist(), langid.ORDER)]
        assert np.allclose(model._probabilities(model.grams(classes), "xx"), want, atol=1e-12)
        assert math.isclose(model._entropies([classes])[0][0], -sum(map(math.log, want)) / len(want), rel_tol=1e-5)
    long = model._classes(langid.code_points("abcd aab dca " * 400))
    whole = model._entropies([long])
    monkeypatch.setattr(langid, "CHUNK", 1000)
    assert np.allclose(model._entropies([long, long]), whole, rtol=1e-6)


def test_language_sample_is_bounded_and_columns_replaced(spark):
    docs = spark.createDataFrame([(7, "abc abd abe", "aa", 0.5)] * 3000 + [(8, "xyz xyy xzz", "bb", 0.5)], "doc_id long, text string, lang string, score double")
    model = langid.train(docs, 5)
    got = langid.classify(docs.where("doc_id = 8"), model)
    assert model.langs == ["aa", "bb"] and got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "accepted"] and got.first()["lang_pred"] == "bb"


def test_a_length_shared_by_all_is_packed_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    parts = spark.createDataFrame([(i % 400 if i % 3 else None, 0, 0, 300 if i % 9 else 700, i) for i in range(900)], packing.PIECES)
    places = defaultdict(list)
    for r in packing.pack(parts).collect():
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sum(map(len, places.values())) == 900
    for found in places.values():
        assert [at for at, _ in sorted(found)] == np.cumsum([0] + [n for _, n in sorted(found)])[:-1].tolist() and sum(n for _, n in found) <= 2048
    assert len(places) <= math.ceil((800 * 300 + 100 * 700) / 2048 * 1.2)


def test_runs_and_slices():
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"a": np.sort(rng.integers(0, 60, 300)), "b": 0})
    batches = [frame.iloc[i:i + n] for i, n in ((0, 1), (1, 100), (101, 0), (101, 150), (251, 49))]
    got = list(common.runs(iter(batches), ["a", "b"]))
    sizes = frame.groupby("a").size()
    assert [(g["a"].iat[0], len(g)) for g in got] == [(k, n) for k, n in sizes.items() if n > 1]
    assert list(common.runs(iter([]), ["a"])) == [] and len(pd.concat(common.gathered(iter(got), 20))) == sizes[sizes > 1].sum()
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 50 + [None]})
    assert sum(s.num_rows for s in common.slices([batch], 4000)) == 51 and max(s.num_rows for s in common.slices([batch], 4000)) <= 5


def test_folds_of_any_length(spark):
    for n in (0, 1, 31, 32, 33, 1000):
        items = F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")
        got = spark.range(1).select(common.scan(items, F.lit(0), lambda s, x: F.struct((s + x).alias("state"), (s * 2).alias("out"))).alias("o")).first()["o"]
        assert (got or []) == [i * (i - 1) for i in range(1, n + 1)]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, name, default):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError):
        common.shared_folder(Session())

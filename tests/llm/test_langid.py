"""Language ID: held-out accuracy, probabilities that sum to one, edge cases."""

import random

import numpy as np

from tidemark.llm import langid

SYLLABLES = {"aa": ["the", "on", "ing", "er", "ou"], "bb": ["ción", "que", "ado", "ñe", "ll"], "cc": ["schen", "ung", "ß", "ver", "zu"]}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_predicts_and_rejects(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, lang), lang, "s") for i, lang in enumerate(list(SYLLABLES) * 100)]
    extra = [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "12 34 !!", "aa", "s"), (1003, "日本語の文章です " * 30, None, "s"), (0, text(rng, "aa"), None, "s"), (None, "the on ing", None, None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score string")
    model = langid.train(docs.where(~langid.held_out()), 40)
    assert model.langs == ["aa", "bb", "cc"]
    got = {}
    for r in langid.predictions(docs, model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(got[i][0]["lang_pred"] == r[2] for i, r in enumerate(rows) if i) >= 298 and len(got[0]) == 2
    for i in (1000, 1001, 1002):
        assert (got[i][0]["lang_pred"], got[i][0]["score"], got[i][0]["accepted"]) == ("und", 0.0, False)
    assert not got[1003][0]["accepted"] and all(0 <= r["score"] <= 1 for rs in got.values() for r in rs)
    assert sum(got[i][0]["accepted"] for i in range(1, 300)) == 299
    assert langid.predictions(docs.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.predictions(docs, langid.train(docs.where("lang = 'none'"))).collect()} == {"und"}


def test_model_is_a_distribution():
    rng = random.Random(2)
    model = langid.Model({"aa": [text(rng, "aa") for _ in range(20)], "bb": [text(rng, "bb") for _ in range(20)]})
    k = model.k
    for context in (0, 5, 17 * k + 3, (4 * k + 2) * k + 9, (k - 1) * (k * k + k + 1)):
        grams = np.arange(k, dtype=np.uint64) + np.uint64(context % k**3) * np.uint64(k)
        for lang in model.langs:
            assert abs(model._probabilities(grams, lang).sum() - 1) < 1e-9

"""Secret models on strings that they did not learn from, many matches in a text, clashing columns."""

import random

from pyspark.sql import functions as F

from tidemark.llm import secrets


def ordinary(rng):
    return "".join(rng.choice(["tion", "the", "ing", "er", "get", "Value", "_", "config", "2"]) for _ in range(8))


def test_recall_and_precision_on_unseen_tokens(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(ordinary(rng) for _ in range(20))) for i in range(200)], "doc_id long, text string")
    model = secrets.train(docs)
    unseen = secrets.made(spark, 300, seed=1).where(~F.col("t").rlike(secrets.ANY_BASE)).select(F.lit(1).alias("random"), F.col("t").alias("text"))
    plain = spark.createDataFrame([(0, ordinary(rng)) for _ in range(300)], "random int, text string")
    got = secrets.scan(unseen.unionByName(plain), model).groupBy("random").agg(F.avg((F.size("spans") > 0).cast("int")).alias("share")).collect()
    share = {r["random"]: r["share"] for r in got}
    assert share[1] >= 0.97 and share[0] <= 0.02


def test_many_matches_and_overlaps(spark):
    token = "Xk29fLq0PzT7vRw3Yb81Nc5MjH6"
    text = "".join(f"é secret={'a' * 9} {token} token=\U0001f600 api_key:{token} " for _ in range(1500))
    docs = spark.createDataFrame([(1, text), (2, "﻿secret=abcdefgh1 ﻿tail"), (3, token), (4, f"{token} password:{token}"), (5, None)], "doc_id long, text string")
    rng = random.Random(2)
    model = secrets.train(spark.createDataFrame([(i, ordinary(rng)) for i in range(500)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in secrets.scan(docs, model).collect()}
    assert len(got[1]["base"]) == 3000 and len(got[1]["spans"]) == 4500
    assert [text[s["start"]:s["end"]] for s in got[1]["spans"]][:3] == ["secret=aaaaaaaaa", token, f"api_key:{token}"]
    assert all(a["end"] <= b["start"] for a, b in zip(got[1]["spans"], got[1]["spans"][1:])) and len(got[4]["spans"]) == 2
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, model).collect()}
    assert clean[1] == "é [SECRET] [SECRET] token=\U0001f600 [SECRET] " * 1500
    assert clean[2] == "﻿[SECRET] ﻿tail" and clean[3] == "[SECRET]" and clean[4] == "[SECRET] [SECRET]" and clean[5] is None


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "secret=abcdefgh1", "keep", 7, "m", 16)], "doc_id long, text string, base string, spans int, row string, n_chars int")
    model = secrets.train(docs)
    assert secrets.scan(docs, model).columns == ["doc_id", "text", "row", "n_chars", "base", "spans"]
    assert secrets.redact(docs, model).collect()[0].asDict() == {"doc_id": 1, "text": "[SECRET]", "base": "keep", "spans": 7, "row": "m", "n_chars": 8}

"""Secret scans: random strings without a digit are found by their ratio; ordinary identifiers are not."""

import random
import string

from pyspark.sql import functions as F

from tidemark.llm import secrets


def test_recall_on_letter_only_strings(spark):
    rng = random.Random(5)
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    word = lambda: "".join(rng.choice(["the", "on", "re", "ing", "at", "er"]) for _ in range(9))
    rows = [(i, f"{word()} {word()} secret={draw(string.ascii_letters + string.digits, 40)} {word()}") for i in range(300)]
    kinds = [(20, 1000), (32, 2000), (40, 3000)]
    rows += [(base + i, f"{word()} {draw(string.ascii_letters, n)} {word()}") for n, base in kinds for i in range(200)]
    rows += [(4000 + i, f"{word()} {word()}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = secrets.train(docs.where("doc_id < 1000 OR doc_id >= 4000"))  # the strings asked for are held out
    found = secrets.scan(docs, model).where("doc_id >= 1000")
    hits = {r["k"]: r["n"] for r in found.groupBy(F.floor(F.col("doc_id") / 1000).alias("k")).agg(F.sum(F.size("spans")).alias("n")).collect()}
    print("letter-only strings found of 200:", {n: hits[base // 1000] for n, base in kinds}, "false findings:", hits[4])
    assert all(hits[base // 1000] >= 180 for _, base in kinds) and hits[4] == 0

"""Mixing: targets, apportionment against the plain method, quotas met, edge cases."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import mixing


def test_targets_share_the_excess():
    got = mixing.targets([("b", 10), ("a", 1), (None, 89)], (5, 2, 1), 3)
    assert got["a"] == 3 and got["b"] == 30 and abs(got[None] - 67) < 1e-9


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 9)), min_size=1, max_size=8), st.integers(0, 60))
def test_apportionment_is_highest_quotients(parties, seats):
    votes, caps = [float(v) for v, _ in parties], [c for _, c in parties]
    got = mixing.sainte_lague(votes, seats, caps)
    plain = [0] * len(votes)
    for _ in range(min(seats, sum(c for v, c in parties if v))):
        i = max((i for i in range(len(votes)) if votes[i] and plain[i] < caps[i]), key=lambda i: (votes[i] / (2 * plain[i] + 1), -i))
        plain[i] += 1
    assert sum(got) == sum(plain) and all(g <= c for g, c in zip(got, caps))
    quotients = lambda seats: sorted(v / (2 * k + 1) for v, n in zip(votes, seats) for k in range(n))
    assert all(abs(a - b) < 1e-9 for a, b in zip(quotients(got), quotients(plain)))


def test_mix_meets_targets_and_repeats(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, " ".join(["w"] * (i % 50)), i) for i in range(600)] + [(5, "s2", "w w", 0), (6, "s0", None, 0), (7, None, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, size2 long")
    got = mixing.documents_mixed(docs)
    assert got.count() == len(rows)
    sums = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal"), F.sum("size").alias("s"), F.first("source_size").alias("z")).collect()
    assert all(abs(r["t"] - r["goal"]) <= 2 and r["s"] == r["z"] for r in sums)
    assert got.where("taken > 3 * size").count() == 0
    assert sorted(map(tuple, got.select("doc_id", "size", "taken").collect())) == sorted(map(tuple, mixing.documents_mixed(docs.repartition(7)).select("doc_id", "size", "taken").collect()))
    applied = mixing.apply_mix(docs)
    assert applied.columns == docs.columns
    words = applied.select(F.sum(mixing.size_in_words(F.col("text")))).first()[0]
    assert words == got.agg(F.sum("taken")).first()[0]
    assert mixing.documents_mixed(docs.limit(0)).count() == 0

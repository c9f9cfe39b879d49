"""Mixing: small sources keep their targets beside very large ones; quotas are met to the word."""

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import mixing


@given(st.integers(1, 60), st.integers(1, 12), st.integers(0, 59), st.integers(0, 59))
def test_partial_takes_the_rest_exactly(size, block, rest, last):
    rest, n = rest % size, -(-size // block)
    last %= n
    widths = [block] * n
    widths[last] -= -size % block
    full, more = mixing._partial(rest, size, block, last)
    assert sum(widths[:full]) + more == rest and (more == 0 or more < widths[full])


def test_small_sources_beside_a_large_one(spark):
    """At five thousand million words, sources of a few words still come to their targets."""
    sizes = {"big": [1_000_000 + i for i in range(5000)], "tiny": [1] * 3, "small": [150] * 10, "little": [200] * 10 + [0], None: [700] * 30}
    rows = [(s, n) for s, all_ in sizes.items() for n in all_]
    sized = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(rows)], "doc_id long, source string, size long")
    got = mixing.mix(sized).cache()
    sums = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("goal")).collect()
    assert len(sums) == 5 and all(abs(r["t"] - r["goal"]) <= 1 for r in sums), sums
    assert got.where("taken > 3 * size").count() == 0
    wrong = got.where("exists(picked, r -> r.from < 0 or r.to <= r.from or r.to > size) or exists(sequence(2, greatest(size(picked), 2)), i -> try_element_at(picked, i).from < picked[i - 2].to)")
    assert wrong.count() == 0

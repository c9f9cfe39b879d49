"""Retrieval of near-dedup: pairs just above the threshold that share no bucket, whatever the number of bits."""

import math

import numpy as np
import pytest

from tidemark.llm import neardup
from tidemark.llm.vectors import unit


def close_pairs(n, dim, cosine=0.901):
    rng = np.random.default_rng(5)
    a, away = unit(rng.standard_normal((n, dim))), rng.standard_normal((n, dim))
    away = unit(away - (away * a).sum(1, keepdims=True) * a)
    return a, cosine * a + math.sqrt(1 - cosine**2) * away


@pytest.mark.parametrize("bits", [8, 11, 13, 16])
@pytest.mark.parametrize("dim", [16, 32, 64])
def test_longer_substrings_miss_no_more_pairs(bits, dim):
    a, b = close_pairs(3000, dim)
    projection = neardup.directions(np.concatenate([a, b]), bits * neardup.tables_for(bits, 0.9))
    codes = [neardup.signs(x, projection) for x in (a, b)]
    left, right = (neardup.substrings(c, bits) for c in codes)
    within = (codes[0] != codes[1]).sum(axis=1) <= neardup.radius(projection.shape[1], 0.9)
    assert (~((left == right).any(axis=1) & within)).mean() <= 0.003


def test_table_count():
    assert [neardup.tables_for(bits, 0.9) for bits in (8, 11, 13, 16)] == [24, 40, 56, 92]
    assert neardup.tables_for(8, 1.0) >= 1


def test_few_distinct_vectors_are_compared_whole(spark):
    """Each table holds pairs just above the threshold, some vectors many times; rare dimensions lie beside the main one."""
    rows, want = [], {}
    for dim, n in ((64, 5), (65, 10), (66, 15), (67, 100), (5, 3), (2, 1)):
        for a, b in zip(*close_pairs(n, dim)):
            at = len(rows)
            rows += [(at, a.tolist()), (at + 1, b.tolist()), (at + 2, a.tolist())]
        x = unit(np.array([v for _, v in rows if len(v) == dim]))
        first = len(rows) - len(x)
        want |= {first + i: int(k) - 1 for i, k in enumerate((x @ x.T >= 0.9).sum(1))}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in neardup.near_duplicates(frame).collect()}
    assert got == want


@pytest.mark.parametrize("rows", [6_000, 10_000_000])
def test_retrieval_finds_what_brute_force_finds(spark, rows):
    """Thousands of vectors, some in one large group, with the tables that so many rows would get."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    a, b = close_pairs(1200, 24, 0.91)
    group = unit(rng.standard_normal((1, 24)) + 0.05 * rng.standard_normal((600, 24)))
    x = unit(np.concatenate([a, b, group, rng.standard_normal((3000, 24))]).astype(np.float32).astype(np.float64))
    near = x @ x.T >= 0.9
    frame = spark.createDataFrame([(i, v.astype(np.float32).tolist(), 1, 24) for i, v in enumerate(x)], "rep long, embedding array<float>, n int, dim int").repartition(4)
    y = unit(x.astype(np.float32).astype(np.float64))
    near = y @ y.T >= 0.9
    found = neardup.links(frame, rows, 0.9).groupBy("rep").agg(F.sum("links").alias("n")).collect()
    total, want = sum(r["n"] for r in found), int(near.sum() - len(x))
    assert all(r["n"] <= near[r["rep"]].sum() - 1 for r in found) and total >= 0.998 * want

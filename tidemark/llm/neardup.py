"""Embedding near-dedup: iterative quantisation, multi-index Hamming tables, exact rerank.

1. Equal vectors collapse to one representative with a count.
2. On a bounded sample a rotation is learnt that balances and best preserves sign codes
   (alternating sign codes and an orthogonal Procrustes step); ``ROTATIONS`` of them from
   different starts give one code each.
3. The codes, one after the other, are cut into substrings of ``bits`` bits, growing with the
   logarithm of the table; rows that agree on a substring meet in that table's bucket. There are
   as many substrings as keep the chance of a miss under ``MISS``; where the learnt codes are too
   short for that, random directions lengthen them. What travels to the tables is the code.
4. Inside a bucket two rows are candidates if their whole codes are within a Hamming radius that
   a pair at the threshold exceeds with a chance of about ``FAR``, and if no earlier table has
   brought them together. Rows without a candidate go no further; the vectors of the others
   join their buckets.
5. There candidates are reranked with the original vectors in double precision; what leaves a
   bucket is a sum for each vector and a spanning forest, never the pairs. Buckets over ``BLOCK``
   rows are split into blocks, every two of which are one group. A dimension of up to ``BLOCK``
   distinct vectors is one bucket without codes, so nothing is missed there.

Two vectors at cosine 0.9 differ in a bit with probability 0.144: 24 tables of 8-bit substrings,
56 of 13 bits or 92 of 16 bits miss a pair about once in 3,000, and less often above. Found pairs
are exact.

Defined cases: null, empty, zero and non-finite vectors and null ids link with nothing;
vectors of different dimension never link; rows that repeat are links of each other; a cosine
equal to the threshold links; an empty table gives an empty result; extra columns are ignored.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, gathered, materialise, runs
from .vectors import matrix, sample, unit, usable

THRESHOLD = 0.9
ROTATIONS = 3
CODE_BITS = 64
SAMPLE_ROWS = 8_000
BLOCK = 2048
STEPS = 30
MISS = 1 / 3000
FAR = 1e-5
ENTRIES = 1 << 18


def learn(x: np.ndarray, seed: int) -> np.ndarray:
    """A projection whose signs are the code: principal directions, then the learnt rotation."""
    bits = min(CODE_BITS, x.shape[1])
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[:bits]
    low = x @ axes.T
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((axes.shape[0], axes.shape[0])))[0]
    for _ in range(STEPS):
        codes = np.where(low @ r >= 0, 1.0, -1.0)
        u, _, v = np.linalg.svd(codes.T @ low)
        r = (u @ v).T
    return axes.T @ r


def tables_for(bits: int, threshold: float) -> int:
    """How many tables keep the chance that a pair at the threshold shares no bucket under MISS."""
    agree = min((1 - math.acos(min(max(threshold, 0.0), 1.0)) / math.pi) ** bits, 0.999)
    return math.ceil(math.log(MISS) / math.log1p(-agree))


def directions(x: np.ndarray, length: int) -> np.ndarray:
    """The projections of a code of ``length`` bits: learnt ones first, then random ones."""
    out = [learn(x, seed) for seed in range(ROTATIONS)]
    more = max(length - sum(p.shape[1] for p in out), 0)
    out.append(np.random.default_rng(ROTATIONS).standard_normal((x.shape[1], more)))
    return np.concatenate(out, 1)[:, :length]


def signs(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The code of each row, a bit per direction."""
    return x @ projection >= 0


def substrings(code: np.ndarray, bits: int) -> np.ndarray:
    """One column per table: the substring of the code."""
    return code.reshape(len(code), -1, bits) @ (1 << np.arange(bits, dtype=np.int64))


def radius(length: int, threshold: float) -> int:
    """The Hamming distance of codes that a pair at the threshold exceeds with a chance of FAR,
    bits being independent (directions at right angles differ less)."""
    p = math.acos(min(max(threshold, 0.0), 1.0)) / math.pi
    return math.ceil(length * p + math.sqrt(2 * length * p * (1 - p) * -math.log(FAR)))


def _unpacked(blobs, length: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(blobs), np.uint8).reshape(len(blobs), -1), axis=1, count=length)


def _candidates(packed: np.ndarray, keys: np.ndarray, table: int, rows: np.ndarray, right: np.ndarray, same: bool, most: int):
    """Pairs (i, j) of rows of ``rows`` and ``right`` within ``most`` bits that no earlier table has."""
    near = np.bitwise_count(packed[rows, None] ^ packed[right]).sum(axis=2, dtype=np.int32) <= most
    i, j = np.nonzero(near)
    i, j = rows[i], right[j]
    i, j = (i[i < j], j[i < j]) if same else (i, j)
    if table and len(i):
        new = np.ones(len(i), bool)
        for at in range(0, len(i), 1 << 18):
            part = slice(at, at + (1 << 18))
            new[part] = ~(keys[i[part], :table] == keys[j[part], :table]).any(axis=1)
        i, j = i[new], j[new]
    return i, j


def links(classes: DataFrame, rows: int, threshold: float) -> DataFrame:
    """``classes``: rep, n, embedding, dim. Returns (rep, links, other): partial sums of linked
    vectors, and forest edges to ``other``, which is null on rows that only count."""
    spark = classes.sparkSession
    bits = int(min(max(math.log2(max(rows, 2)) - 7, 8), 16))
    tables = tables_for(bits, threshold)
    length = bits * tables
    models, small = {}, []
    for r in classes.groupBy("dim").count().collect():  # a row per dimension
        if r["count"] > BLOCK:
            x = sample(classes.where(F.col("dim") == r["dim"]), SAMPLE_ROWS, "rep").toPandas()["embedding"]
            models[r["dim"]] = directions(unit(matrix(x)), length)
        else:
            small.append(r["dim"])
    shared = spark.sparkContext.broadcast(models)
    most, width = radius(length, threshold), -(-length // 64) * 8

    def coded(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                step = max(ENTRIES // tables, 1)
                for at in range(0, len(part), step):
                    yield entries_of(dim, part[at : at + step])

    def entries_of(dim, part):
        code = signs(unit(matrix(part["embedding"])), shared.value[dim])
        keys = substrings(code, bits)
        blobs = np.array([x.tobytes().ljust(width, b"\0") for x in np.packbits(code, axis=1)], object)
        return pd.DataFrame({"dim": dim, "tab": np.tile(np.arange(tables), len(part)), "key": keys.ravel(), "rep": np.repeat(part["rep"].to_numpy(), tables),
                             "code": np.repeat(blobs, tables)})

    def members(pdf: pd.DataFrame) -> pd.DataFrame:
        same, table, hit = pdf["b1"].iat[0] == pdf["b2"].iat[0], int(pdf["tab"].iat[0]), np.zeros(len(pdf), bool)
        packed = np.frombuffer(b"".join(pdf["code"]), np.uint64).reshape(len(pdf), -1)
        keys = substrings(_unpacked(pdf["code"], length), bits).astype(np.uint16) if table else None
        left = np.flatnonzero(pdf["mine"].to_numpy() == pdf["b1"].to_numpy())
        right = left if same else np.flatnonzero(pdf["mine"].to_numpy() == pdf["b2"].to_numpy())
        step = max((1 << 19) // max(len(right), 1) // (width // 8) + 1, 1)
        for at in range(0, len(left), step):
            i, j = _candidates(packed, keys, table, left[at : at + step], right, same, most)
            hit[i] = hit[j] = True
        return pdf.loc[hit, ["dim", "tab", "key", "b1", "b2", "mine", "rep", "code"]]

    bucket = ["dim", "tab", "key"]
    group = [*bucket, "b1", "b2"]
    entries = classes.where(F.col("dim").isin(list(models))).select("dim", "rep", "embedding").mapInPandas(coded, "dim int, tab int, key int, rep long, code binary")
    sizes = entries.groupBy(bucket).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    spread = entries.join(sizes, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select("dim", "tab", "key", F.least("mine", "other").alias("b1"), F.greatest("mine", "other").alias("b2"), "mine", "rep", "code")
    met = spread.repartition(*group).sortWithinPartitions(*group)
    found = met.mapInPandas(lambda batches: gathered(map(members, runs(batches, group))), "dim int, tab int, key int, b1 int, b2 int, mine int, rep long, code binary")
    alone = classes.where(F.col("dim").isin(small)).select(
        "dim", F.lit(0).alias("tab"), F.lit(0).alias("key"), F.lit(0).alias("b1"), F.lit(0).alias("b2"), F.lit(0).alias("mine"), "rep", F.lit(None).cast("binary").alias("code"))
    chosen = materialise(found.unionByName(alone), "candidates").join(classes.select("rep", "n", F.col("embedding").alias("vec")), "rep")

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        same, table = pdf["b1"].iat[0] == pdf["b2"].iat[0], int(pdf["tab"].iat[0])
        reps, n, x = pdf["rep"].to_numpy(), pdf["n"].to_numpy(), unit(matrix(pdf["vec"]))
        coded = pdf["code"].iat[0] is not None
        packed = np.frombuffer(b"".join(pdf["code"]), np.uint64).reshape(len(pdf), -1) if coded else None
        keys = substrings(_unpacked(pdf["code"], length), bits).astype(np.uint16) if coded and table else None
        left = np.flatnonzero(pdf["mine"].to_numpy() == pdf["b1"].to_numpy())
        right = left if same else np.flatnonzero(pdf["mine"].to_numpy() == pdf["b2"].to_numpy())
        counts, label = np.zeros(len(pdf), np.int64), np.arange(len(pdf))
        pairs, step = [], max((1 << 19) // max(len(right), 1) // (width // 8) + 1, 1)
        for at in range(0, len(left), step):
            some = left[at : at + step]
            if coded:
                i, j = _candidates(packed, keys, table, some, right, same, most)
            else:
                i, j = np.nonzero(some[:, None] < right)
                i, j = some[i], right[j]
            if len(i) * 8 > len(some) * len(right):
                place, column = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
                place[some], column[right] = np.arange(len(some)), np.arange(len(right))
                near = (x[some] @ x[right].T)[place[i], column[j]] >= threshold
            else:
                near = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
            i, j = i[near], j[near]
            counts += np.bincount(i, n[j], len(pdf)).astype(np.int64) + np.bincount(j, n[i], len(pdf)).astype(np.int64)
            pairs.append((i, j))
        i, j = (np.concatenate(p) for p in zip(*pairs)) if pairs else (np.empty(0, int),) * 2
        while len(i):
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            label = label[label]
            if (label == before).all():
                break
        hit = counts > 0
        out = pd.DataFrame({"rep": reps[hit], "links": counts[hit], "other": reps[label[hit]]})
        return out.astype({"other": "Int64"})

    met = chosen.repartition(*group).sortWithinPartitions(*group)
    return met.mapInPandas(lambda batches: gathered(map(rerank, runs(batches, group))), "rep long, links long, other long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``embeddings``: vec_id, embedding. Returns vec_id, n_links, component_id, kept."""
    rows = embeddings.select("vec_id", "embedding")
    fit = usable() & F.col("vec_id").isNotNull()
    classes = (rows.where(fit).groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
               .withColumn("dim", F.size("embedding")))
    classes = materialise(classes, "classes")
    found = materialise(links(classes, classes.count(), threshold), "links")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    summed = (classes.join(sums, "rep", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
              .select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    linked = rows.where(fit).join(summed, "embedding").select("vec_id", "n_links", "component_id")
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

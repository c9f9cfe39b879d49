"""Approximate nearest neighbours over balanced posting lists.

Centroids come from spherical k-means on a bounded sample, lists that are too long there being
cut in two. A vector goes to its nearest list and, if it lies near a boundary, to up to
``REPLICAS`` lists whose centroid is almost as near. Queries search the centroids through an
in-memory neighbour graph (best-first, with a candidate pool) and read the lists whose distance
is within ``RATIO`` of the nearest. Posting lists that are still long, such as those of a very
common vector, are cut into parts, and lists and parts are dealt to as many groups as hold about
``GROUP_ROWS`` postings each. Scores come from the original vectors in double precision, summed
in the same order for every pair, so equal vectors score alike wherever they stand.

There is a list for ``LIST_ROWS`` rows, up to ``MAX_LISTS``; beyond, lists grow. Centroids are fitted
on ``SAMPLE_ROWS`` rows or ``SAMPLE_A_LIST`` a list, whichever is more.

Every row is indexed, but of equal vectors only the k + 1 smallest ids can ever be results, so
only those are. Measured recall is in the README; ``RATIO`` trades it against lists read.

Defined cases: null, empty, zero and non-finite vectors and null ids take no part, as queries or
candidates; a query meets only vectors of its dimension; ties go to the smaller id; fewer
candidates than k give fewer rows; an empty table gives an empty result.
"""

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .vectors import matrix, sample, unit, usable

SAMPLE_ROWS = 10_000
LIST_ROWS = 256
MAX_LISTS = 16_384
SAMPLE_A_LIST = 4
REPLICAS = 4
BOUNDARY = 1.05
RATIO = 1.25
GRAPH_DEGREE = 24
PART_ROWS = 4096
GROUPS = 64
GROUP_ROWS = 20_000
CELLS = 1 << 20


def _parts(x: np.ndarray, columns: int) -> list[np.ndarray]:
    """Rows in parts whose product with so many columns stays small."""
    step = max(1, CELLS // max(columns, 1))
    return [x[at : at + step] for at in range(0, len(x), step)]


def kmeans(x: np.ndarray, k: int, seed: int = 0, steps: int = 10) -> np.ndarray:
    """Spherical centroids; lists over twice the mean size are split, empty ones reseeded."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for step in range(steps):
        own = np.concatenate([(part @ c.T).argmax(1) for part in _parts(x, k)])
        size = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), c)
        if step < steps - 2:
            big = [i for i in np.argsort(-size) if size[i] > 2 * len(x) / k]
            for full, spare in zip(big, np.argsort(size, kind="stable")):
                c[spare] = x[rng.choice(np.flatnonzero(own == full))]
    return c


class CentroidGraph:
    """Best-first search over a nearest-neighbour graph of the centroids."""

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        near = np.concatenate([np.argsort(-(part @ centroids.T), axis=1, kind="stable")[:, 1 : GRAPH_DEGREE + 1] for part in _parts(centroids, len(centroids))])
        links = [set(row) for row in near.tolist()]
        for i, row in enumerate(near.tolist()):
            for j in row:
                links[j].add(i)
        for i in range(len(centroids) - 1):
            links[i].add(i + 1)  # one path through all keeps the graph connected
            links[i + 1].add(i)
        self.links = [np.fromiter(sorted(s), int) for s in links]

    def search(self, q: np.ndarray, ratio: float) -> np.ndarray:
        """Centroids within ``ratio`` times the distance of the nearest one found."""
        start = 0
        seen = np.zeros(len(self.c), bool)
        seen[start] = True
        d = float(np.sqrt(max(0.0, 2 - 2 * float(self.c[start] @ q))))
        best, heap, kept = d, [(d, start)], []
        slack = 1.0 + (ratio - 1.0) * 1.25  # explore a little beyond what is kept
        while heap:
            d, i = heapq.heappop(heap)
            if d > best * slack and len(kept) >= GRAPH_DEGREE:
                break
            kept.append((d, i))
            new = self.links[i][~seen[self.links[i]]]
            seen[new] = True
            for j, dist in zip(new.tolist(), np.sqrt(np.maximum(0.0, 2 - 2 * (self.c[new] @ q))).tolist()):
                best = min(best, dist)
                heapq.heappush(heap, (dist, j))
        return np.array(sorted(i for d, i in kept if d <= best * ratio), int)


def search(embeddings: DataFrame, queries: DataFrame, k: int = 5, ratio: float = RATIO) -> DataFrame:
    """``embeddings`` and ``queries``: vec_id, embedding. Returns query_id, rank, vec_id, score."""
    spark = embeddings.sparkSession
    fit = usable() & F.col("vec_id").isNotNull()
    rows = embeddings.where(fit).select("vec_id", "embedding", F.size("embedding").alias("dim"))
    order = Window.partitionBy("embedding").orderBy("vec_id")
    rows = materialise(rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).drop("_r"), "vectors")
    models, total = {}, 0
    for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect():  # a row per dimension
        lists = max(1, min(MAX_LISTS, r["n"] // LIST_ROWS))
        x = unit(matrix(sample(rows.where(F.col("dim") == r["dim"]), max(SAMPLE_ROWS, SAMPLE_A_LIST * lists)).toPandas()["embedding"]))
        models[r["dim"]], total = CentroidGraph(kmeans(x, lists)), total + r["n"]
    groups = max(GROUPS, total // GROUP_ROWS)
    shared = spark.sparkContext.broadcast(models)

    def post(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                ids, x, at = part["vec_id"].to_numpy(), matrix(part["embedding"]), 0
                for some in _parts(x, len(shared.value[dim].c)):
                    d = np.sqrt(np.maximum(0.0, 2 - 2 * (unit(some) @ shared.value[dim].c.T)))
                    top = min(REPLICAS, d.shape[1])
                    near = np.argpartition(d, top - 1, axis=1)[:, :top]
                    dist = np.take_along_axis(d, near, 1)
                    i, j = np.nonzero(dist <= BOUNDARY * dist.min(1, keepdims=True))
                    vec = np.array([v.tobytes() for v in some], object)
                    yield pd.DataFrame({"dim": dim, "list": near[i, j], "vec_id": ids[at + i], "vec": vec[i]})
                    at += len(some)

    def ask(batches):
        for pdf in batches:
            for dim, part in pdf.groupby("dim"):
                if dim not in shared.value:
                    continue
                x = matrix(part["embedding"])
                lists = [shared.value[dim].search(q, ratio) for q in unit(x)]
                i = np.repeat(np.arange(len(part)), [len(f) for f in lists])
                vec = np.array([v.tobytes() for v in x], object)
                yield pd.DataFrame({"dim": dim, "list": np.concatenate(lists), "query_id": part["vec_id"].to_numpy()[i], "vec": vec[i]})

    posted = materialise(rows.mapInPandas(post, "dim int, list long, vec_id long, vec binary"), "postings")
    asked = queries.where(fit).select("vec_id", "embedding", F.size("embedding").alias("dim")).repartition(F.col("vec_id")).mapInPandas(
        ask, "dim int, list long, query_id long, vec binary")
    parts = posted.groupBy("dim", "list").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("long").alias("parts"))  # a row per list
    posted = posted.join(F.broadcast(parts), ["dim", "list"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts"))
    asked = asked.join(F.broadcast(parts), ["dim", "list"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    group = F.pmod(F.xxhash64("list", "part"), F.lit(groups)).alias("g")

    def best(key, postings: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out, lists = [], dict(tuple(postings.groupby(["list", "part"])))
        for at, q in wanted.groupby(["list", "part"]):
            if at not in lists:
                continue
            p = lists[at]
            y = unit(np.frombuffer(b"".join(p["vec"]), np.float64).reshape(len(p), -1))
            x = unit(np.frombuffer(b"".join(q["vec"]), np.float64).reshape(len(q), -1))
            ids, own = p["vec_id"].to_numpy(), q["query_id"].to_numpy()
            s = x @ y.T
            s[own[:, None] == ids[None, :]] = -np.inf
            top = min(k, len(p))
            # everything about as near as the k-th, so that ties are settled by id
            cut = np.partition(s, -top, axis=1)[:, -top]
            i, j = np.nonzero((s >= cut[:, None] - 1e-9) & np.isfinite(s))
            out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[j], "score": (x[i] * y[j]).sum(axis=1)}))
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        found = pd.concat(out).drop_duplicates(["query_id", "vec_id"]).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return found.groupby("query_id").head(k)

    near = (posted.select(group, "dim", "list", "part", "vec_id", "vec").groupBy("g", "dim")
            .cogroup(asked.select(group, "dim", "list", "part", "query_id", "vec").groupBy("g", "dim"))
            .applyInPandas(best, "query_id long, vec_id long, score double"))
    # a copy of the pair from another list scores the same; one row per pair is enough
    once = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

"""Mixing sources to target weights by Sainte-Laguë apportionment, in equal-token blocks.

1. Every source gets a target: its weight's share of all words, capped at ``max_repeats``
   times its own size, the excess shared again by weight until no target is above its cap.
2. Words are given out by highest quotients, first to sources, then inside a source to its
   shards (hash shards of bounded size, so a hot source is many). No unit grows with the corpus.
3. A shard is cut into equal blocks, ``BLOCKS`` or so. Its quota is taken as whole passes over
   the shard plus blocks chosen by a seeded permutation of the block numbers, which needs no
   sort and no shared state; the last block chosen is cut, so that the quota is met to the word.

Defined cases: a null text has size 0; null sources are one source, last in order; rows that
repeat count each time, in any order among themselves; rows of one id or without one share a
shard; a very long text is split into words once; an empty table gives an empty result; extra
columns pass through, whatever their names.
The number of sources has to fit the driver (``MAX_SOURCES``); documents never go there. The plan
of a mix is broadcast for up to ``BROADCAST_SOURCES`` sources and joined by shuffle beyond.
"""

import heapq
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, let, materialise

MAX_SOURCES = 1_000_000
BROADCAST_SOURCES = 50_000
SHARD_ROWS = 20_000
BLOCKS = 1 << 14


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], max_repeats: int) -> dict:
    """Target words of each source by weighted shares with caps."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(ordered)}
    cap, left, active = {s: float(max_repeats * n) for s, n in ordered}, float(sum(n for _, n in ordered)), [s for s, _ in ordered]
    out = {}
    while active:
        total = sum(weight[s] for s in active)
        over = [s for s in active if left * weight[s] / total > cap[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in active}
        for s in over:
            out[s] = cap[s]
        left -= sum(cap[s] for s in over)
        active = [s for s in active if s not in set(over)]
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients vote / (2 * seats + 1), none above its cap.

    A divisor found by bisection gives all but a few seats; the rest go one by one.
    """
    seats = min(seats, sum(c for v, c in zip(votes, caps) if v > 0))
    given = [0] * len(votes)
    if seats <= 0:
        return given
    at = lambda d: [min(c, int(v / d + 0.5)) if v > 0 else 0 for v, c in zip(votes, caps)]
    low, high = 0.0, 2.0 * max(votes) + 1
    for _ in range(100):
        mid = (low + high) / 2
        if mid <= 0 or sum(at(mid)) > seats:
            low = mid
        else:
            high = mid
    given = at(high)
    heap = [(-votes[i] / (2 * given[i] + 1), i) for i in range(len(votes)) if votes[i] > 0 and given[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(given)):
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * given[i] + 1), i))
    return given


def _stride(n: int, seed: int) -> int:
    """A multiplier without a common factor with n, near the golden section."""
    a = max(1, int(n * 0.6180339887) + seed % 7)
    while math.gcd(a, n) != 1:
        a += 1
    return a


def _partial(rest: int, size: int, block: int, last: int) -> tuple[int, int]:
    """How many blocks in the order of the permutation, and how many words of the next one, make
    ``rest`` words, fewer than ``size``. The block at place ``last`` may be shorter than others."""
    if not rest:
        return 0, 0
    short = -size % block
    full = rest // block
    left = rest - full * block + (short if last < full else 0)
    while left >= (width := block - (short if last == full else 0)):
        full, left = full + 1, left - width
    return full, left


ADDED = ("source_size", "target", "passes", "picked", "taken")


def mix(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), max_repeats: int = 3, seed: int = 1, blocks: int = BLOCKS) -> DataFrame:
    """``sized``: doc_id, source, size and any other columns. Adds source_size, target, passes
    (whole copies), picked (ranges of words, [from, to) of one more partial copy) and taken;
    columns of these names are replaced."""
    spark = sized.sparkSession
    others = [c for c in sized.columns if c not in ("doc_id", "source", "size", *ADDED)]
    sized = sized.select("doc_id", "source", "size", F.struct(*[sized[c] for c in others]).alias("_rest") if others else F.lit(None).alias("_rest"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError("too many sources for one mix")
    goal = targets([(r["source"], r["size"]) for r in totals], weights, max_repeats)
    everything = sum(r["size"] for r in totals)
    quota = sainte_lague([goal[r["source"]] for r in totals], everything, [max_repeats * r["size"] for r in totals])
    plan = spark.createDataFrame(
        [(r["source"], int(r["size"]), float(goal[r["source"]]), int(q), max(1, -(-r["n"] // SHARD_ROWS))) for r, q in zip(totals, quota)],
        "source string, source_size long, target double, source_words long, shards long")
    small = len(totals) <= BROADCAST_SOURCES
    planned = sized.alias("d").join(F.broadcast(plan.alias("p")) if small else plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source"))).drop(F.col("p.source"))
    planned = planned.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "shards"))

    def allot(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_shard")
        sizes = [int(x) for x in pdf["shard_size"]]
        quotas = sainte_lague([float(x) for x in sizes], int(pdf["source_words"].iloc[0]), [max_repeats * x for x in sizes])
        rows = []
        for shard, size, quota in zip(pdf["_shard"].tolist(), sizes, quotas):
            passes, rest = divmod(quota, size) if size else (0, 0)
            block = max(1, size // blocks)
            n = max(1, -(-size // block))
            stride = _stride(n, seed + shard)
            rows.append((passes, block, n, stride, *_partial(rest, size, block, ((n - 1) * stride + seed) % n)))
        pdf[["passes", "block", "n_blocks", "stride", "full", "more"]] = rows
        return pdf.drop(columns=["source_words", "shard_size"])

    shards = planned.groupBy("source", "_shard", "source_words").agg(F.sum("size").alias("shard_size"))
    shards = shards.groupBy("source").applyInPandas(allot, "source string, _shard long, passes long, block long, n_blocks long, stride long, full long, more long")
    before = Window.partitionBy("source", "_shard").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = planned.withColumn("_start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    joined = placed.alias("d").join(shards.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d._shard") == F.col("s._shard")))
    joined = joined.drop(F.col("s.source"), F.col("s._shard"), "source_words", "shards")
    block, start, place = F.col("block"), F.col("_start"), lambda j: F.pmod(j * F.col("stride") + F.lit(seed), F.col("n_blocks"))
    first, last = F.floor(start / block), F.floor((start + F.col("size") - 1) / block)
    touched = F.when((F.col("size") > 0) & (F.col("full") + F.col("more") > 0), F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    chosen = F.filter(touched, lambda j: place(j) <= F.col("full"))
    ranges = F.transform(chosen, lambda j: F.struct(
        F.greatest(j * block - start, F.lit(0)).cast("long").alias("from"),
        F.least(j * block + F.when(place(j) < F.col("full"), block).otherwise(F.col("more")) - start, F.col("size")).cast("long").alias("to")))
    picked = F.filter(ranges, lambda r: r["from"] < r["to"])
    joined = joined.withColumn("picked", picked)
    part = F.aggregate("picked", F.lit(0).cast("long"), lambda acc, r: acc + r["to"] - r["from"])
    joined = joined.withColumn("taken", (F.col("passes") * F.col("size") + part).cast("long"))
    return joined.select("doc_id", "source", "size", *(["_rest.*"] if others else []), *ADDED)


def documents_mixed(docs: DataFrame) -> DataFrame:
    """The mix of a table with doc_id, source, text: one row per document, no text."""
    sized = materialise(docs.select("doc_id", "source", size_in_words(F.col("text")).alias("size")), "sizes")
    return mix(sized)


def apply_mix(docs: DataFrame) -> DataFrame:
    """The mixed table itself: whole copies, then the picked words of a partial copy, as rows of
    the input's columns. A document whose size is 0 stays out, as do those with nothing taken."""
    columns = docs.columns
    plan = mix(docs.select("doc_id", "source", size_in_words(F.col("text")).alias("size"), F.struct(*[docs[c] for c in columns]).alias("all")))
    text = F.col("all.text")
    pick = lambda words: F.flatten(F.transform("picked", lambda r: F.slice(words, (r["from"] + 1).cast("int"), (r["to"] - r["from"]).cast("int"))))
    partial = F.array_join(let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), pick), " ")
    copies = F.concat(F.array_repeat(F.lit(None).cast("string"), F.col("passes").cast("int")),
                      F.when(F.size("picked") > 0, F.array(partial)).otherwise(F.array().cast("array<string>")))
    out = plan.select("all", F.explode(copies).alias("copy")).withColumn("mixed", F.coalesce("copy", text))
    values = {c: F.col("all").getField(c) for c in columns} | {"text": F.col("mixed")}
    if "n_chars" in columns:
        values["n_chars"] = F.length("mixed").cast("long")
    return out.select([values[c].alias(c) for c in columns])

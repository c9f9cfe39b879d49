"""What the operators share: materialised tables, word and letter rules, components."""

import atexit
import itertools
import shutil
import tempfile
import uuid
import weakref
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space, in Java regex syntax.
WORD = r"[^\x20\x09-\x0D]+"


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it. Where it is unset, a folder of our own in
    local mode; on a cluster that is an error, because executors don't share such a folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        named = _own_folder()
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost
    executor costs its own tasks only."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = path
    weakref.finalize(out, _written.pop, id(out), None)
    return out


_written: dict[int, str] = {}


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and that no later step reads."""
    path = _written.pop(id(df), None)
    if path is not None:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def slices(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches in pieces of ``size`` bytes or so, at least a row each: a worker then holds
    few Python objects at a time."""
    for batch in batches:
        step = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def label_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def bucket_of(doc_id: int, n: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % n


def partitions_for(spark: SparkSession, df: DataFrame, bytes_each: int = 16 << 20) -> int:
    """A partition count in proportion to the size the optimizer sees, and no fewer than configured."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return int(min(max(size // bytes_each, int(spark.conf.get("spark.sql.shuffle.partitions"))), 100_000))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64) over an unsigned array."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes, by doubling."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    base = 0x9E3779B97F4A7C15
    total, span, power, done, step = None, 1, base, 0, hashes
    rest = n
    while rest:
        if rest & 1:
            part = step[done:]
            total = step[:] if total is None else total[: len(part)] * np.uint64(power) + part[: len(total)]
            done += span
        rest >>= 1
        if rest:
            step = step[: len(step) - span] * np.uint64(power) + step[span:]
            power, span = power * power % 2**64, span * 2
    return mix(total[: len(hashes) - n + 1])


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links to (id, component): the smallest id reachable, for every id with a link.

    Alternating large-star and small-star steps; each is one shuffle with a minimum per
    vertex, every edge list stays linear in the input, and the rounds grow with the logarithm
    of the longest path. No component is ever gathered in one place.
    """
    def settled(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = settled(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(floor, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(floor.select("u", F.col("m").alias("v"))).distinct())
        old, edges = edges, materialise(small, "links")
        discard(old)
        before, mark = mark, settled(edges)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")


def runs(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of two rows or more that have equal ``names``, from batches sorted by these.
    One group and one batch are held at a time."""
    held = None
    for pdf in itertools.chain(batches, [None]):
        if pdf is None:
            if held is None or len(held) < 2:
                return
            pdf, last = held, True
        else:
            pdf, last = pdf if held is None else pd.concat([held, pdf], ignore_index=True), False
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), bool)
        change[0] = True
        for name in names:
            values = pdf[name].to_numpy()
            change[1:] |= values[1:] != values[:-1]
        cuts = np.append(np.flatnonzero(change), len(pdf))
        if not last:
            held, cuts = pdf.iloc[cuts[-2] :], cuts[:-1]
        for i in np.flatnonzero(np.diff(cuts) > 1):
            yield pdf.iloc[cuts[i] : cuts[i + 1]]


def gathered(frames: Iterator[pd.DataFrame], rows: int = 10_000) -> Iterator[pd.DataFrame]:
    """The same rows in fewer frames."""
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def let(value: Column, f) -> Column:
    """``f(value)``, with the value computed once however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def scan(items: Column, zero: Column, step, block: int = 32) -> Column:
    """The outputs of an ordered fold: ``step(state, item)`` gives a struct of the next ``state``
    and an output ``out``. Outputs gather in blocks, since appending copies what is there. A step
    is computed up to four times, which is cheaper than copying it; it should be a few operations."""
    def add(acc, x):
        r = step(acc["state"], x)
        return F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out"))

    def whole(z):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / block).cast("int")), lambda i: F.slice(z, i * block + 1, F.lit(block)))
        one = F.array(step(zero, F.element_at(z, 1))["out"])  # for its type

        def more(acc, part):
            inner = F.aggregate(part, F.struct(acc["state"].alias("state"), F.slice(one, 1, 0).alias("out")), add)
            return F.struct(inner["state"].alias("state"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

        return F.aggregate(blocks, F.struct(zero.alias("state"), F.slice(F.array(one), 1, 0).alias("out")), more, lambda acc: F.flatten(acc["out"]))

    return F.when(F.size(items) > 0, let(items, whole))

"""Invariant checks: every function returns the violations, so an empty result is healthy."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


CHUNK = 1 << 20


def _with_previous(records: DataFrame, column: str, chunk: int) -> DataFrame:
    """``column`` of the record before, as ``_previous``.

    Windows run inside (partition, chunk of sequence numbers), so a busy partition is many tasks;
    the first record of a chunk gets the last value of the nearest chunk before it.
    """
    lean = records.select("partition", "lsn", F.col(column).alias("_value"), F.floor(F.col("lsn") / chunk).alias("_chunk"))
    ends = lean.groupBy("partition", "_chunk").agg(F.max_by("_value", "lsn").alias("_end"))  # a row per chunk
    ends = ends.withColumn("_before", F.lag("_end").over(Window.partitionBy("partition").orderBy("_chunk"))).drop("_end")
    inside = F.lag("_value").over(Window.partitionBy("partition", "_chunk").orderBy("lsn"))
    first = F.row_number().over(Window.partitionBy("partition", "_chunk").orderBy("lsn")) == 1
    placed = lean.withColumn("_inside", inside).withColumn("_first", first).join(ends, ["partition", "_chunk"])
    return placed.withColumn("_previous", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_inside")))


def lsn_gaps(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Places where a sequence number does not follow its predecessor."""
    return _with_previous(records, "lsn", chunk).where(F.col("lsn") != F.col("_previous") + 1).select("partition", "lsn", F.col("_previous").alias("previous_lsn"))


def timestamp_regressions(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Records earlier than their predecessor; equal timestamps are legal."""
    found = _with_previous(records, "timestamp_ms", chunk).where(F.col("_value") < F.col("_previous"))
    return found.select("partition", "lsn", F.col("_value").alias("timestamp_ms"), F.col("_previous").alias("previous_ms"))


def segment_contiguity(segs: DataFrame) -> DataFrame:
    """Per segment: does it start where the one before ended, in sequence and in time?"""
    order = Window.partitionBy("partition").orderBy("base_lsn")
    last, late = F.lag("last_lsn").over(order), F.lag("max_timestamp_ms").over(order)
    return segs.select(
        "partition", "base_lsn", "last_lsn",
        F.coalesce(F.col("base_lsn") == last + 1, F.lit(True)).alias("contiguous"),
        F.coalesce(F.col("min_timestamp_ms") >= late, F.lit(True)).alias("ordered"),
        (F.col("record_count") == F.col("last_lsn") - F.col("base_lsn") + 1).alias("dense"))


def block_offsets(blocks: DataFrame, preamble: int = 64) -> DataFrame:
    """Byte offset of each block: the file preamble plus everything stored before it."""
    before = Window.partitionBy("partition", "segment_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.lit(preamble) + F.coalesce(F.sum(F.col("stored_size") + preamble).over(before), F.lit(0))
    return blocks.withColumn("block_offset", offset.cast("long"))


def reference_mismatches(refs: DataFrame, trailers: DataFrame, key: str = "segment_uuid") -> DataFrame:
    """Catalog rows whose segment trailer says something else in any shared column."""
    shared = [c for c in refs.columns if c in trailers.columns and c != key]
    same = F.lit(True)
    for c in shared:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    return refs.alias("r").join(trailers.alias("t"), key).where(~same).select(key)

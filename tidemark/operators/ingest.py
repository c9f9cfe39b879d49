"""Ingest: dense sequence numbers, record sizes, and segment and block boundaries."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.numbers import saturating_add, saturating_mul


def assign_lsn(rows: DataFrame, order: list[str], *, partition: str = "partition", time_ms: str = "timestamp_ms",
               chunk_ms: int = 86_400_000, heads: DataFrame | None = None) -> DataFrame:
    """Add a dense ``lsn`` per partition, in the order (``time_ms``, ``order``).

    Numbering is two-level: rows are numbered inside (partition, time chunk), and a small
    table of chunk counts gives each chunk its offset. One busy partition is thus sorted by
    as many tasks as it has chunks instead of by one. ``heads`` (partition, next_lsn)
    continues after what is already committed.
    """
    chunked = rows.withColumn("_chunk", F.floor(F.col(time_ms) / F.lit(chunk_ms)).cast("long"))
    before = Window.partitionBy(partition).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunked.groupBy(partition, "_chunk").agg(F.count(F.lit(1)).alias("_n")).select(
        partition, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    if heads is not None:
        offsets = offsets.join(heads.select(partition, "next_lsn"), partition, "left").withColumn(
            "_offset", F.col("_offset") + F.coalesce("next_lsn", F.lit(0))).drop("next_lsn")
    within = Window.partitionBy(partition, "_chunk").orderBy(time_ms, *order)
    return (chunked.withColumn("_rank", F.row_number().over(within))
            .join(offsets, [partition, "_chunk"])
            .withColumn("lsn", (F.col("_offset") + F.col("_rank") - 1).cast("long"))
            .drop("_chunk", "_rank", "_offset"))


def record_size(headers: str = "headers", value: str = "value") -> Column:
    """Encoded bytes of a record: fixed part, headers when there are any, and the value."""
    each = F.aggregate(headers, F.lit(0).cast("long"),
                       lambda acc, h: acc + 4 + F.octet_length(h["key"]) + F.coalesce(F.octet_length(h["value"]), F.lit(0)))
    head = F.when(F.size(headers) > 0, each + 2).otherwise(F.lit(0))
    return (F.lit(16) + head + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def roll_by_records(records: DataFrame, max_records: int = schema.ROLL_RECORDS) -> DataFrame:
    """Segment number when only the record count cuts: a pure function of the sequence number."""
    return records.withColumn("segment_no", F.floor(F.col("lsn") / max_records).cast("long"))


def greedy_cuts(sizes: np.ndarray, max_records: int, max_bytes: int, state: tuple[int, int, int]) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Segment numbers of records in order; ``state`` is (segment, its records, its bytes).

    A record that is larger than the limit gets a segment of its own. The end of each segment is
    found by binary search in the running sum, so the loop is over segments.
    """
    out, (segment, count, used) = np.empty(len(sizes), np.int64), state
    upto, at = np.r_[0, np.cumsum(sizes, dtype=np.int64)], 0
    while at < len(sizes):
        if count and (count >= max_records or used >= max_bytes or sizes[at] > max_bytes - used):
            segment, count, used = segment + 1, 0, 0
        end = int(np.searchsorted(upto, upto[at] + max_bytes - used, side="right")) - 1
        end = min(max(end, at + 1), at + max(max_records - count, 1), len(sizes))
        out[at:end] = segment
        count, used, at = count + end - at, used + int(upto[end] - upto[at]), end
    return out, (segment, count, used)


def roll_by_bytes(sized: DataFrame, max_bytes: int, max_records: int = 2**62, out: str = "segment_no") -> DataFrame:
    """Segment numbers under a byte limit, from columns partition, lsn and record_bytes.

    The cut depends on every cut before it, so it is an ordered fold. A partition streams
    through its task in Arrow batches and only three integers are carried along.
    """
    schema_out = f"partition long, lsn long, record_bytes long, {out} long"

    def fold(batches):
        state, current = (0, 0, 0), None
        for pdf in batches:
            parts = []
            for key, rows in pdf.groupby("partition", sort=False):
                if key != current:
                    state, current = (0, 0, 0), key
                cuts, state = greedy_cuts(rows["record_bytes"].to_numpy(), max_records, max_bytes, state)
                parts.append(rows.assign(**{out: cuts}))
            if parts:
                yield pd.concat(parts)

    lean = sized.select("partition", "lsn", "record_bytes")
    return lean.repartition("partition").sortWithinPartitions("partition", "lsn").mapInPandas(fold, schema_out)


def block_stats(records: DataFrame, per_block: int, per_segment: int) -> DataFrame:
    """Count, bounds and time range of every block."""
    return (records.withColumn("segment_no", F.floor(F.col("lsn") / per_segment).cast("long"))
            .withColumn("block_no", F.floor(F.col("lsn") % per_segment / per_block).cast("long"))
            .groupBy("partition", "segment_no", "block_no")
            .agg(F.count(F.lit(1)).alias("record_count"), F.min("lsn").alias("base_lsn"),
                 F.min("timestamp_ms").alias("min_timestamp_ms"), F.max("timestamp_ms").alias("max_timestamp_ms")))


def inflight_bytes(raw: Column, records: Column, compressed: bool = True) -> Column:
    """Upper bound of what a segment in flight takes: its raw bytes, a quarter more if it is
    compressed, a preamble and an index entry for a block each record, and the fixed parts."""
    stored = saturating_add(raw, F.floor((raw + 3) / 4)) if compressed else raw
    blocks = saturating_mul(F.lit(128), F.greatest(records, F.lit(1)))
    return saturating_add(F.lit(64 + 64 + 192), saturating_add(stored, blocks))

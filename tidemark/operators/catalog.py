"""Catalog: segments, heads and index pages as aggregates, and lookups over them."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..errors import InvalidRequestError


def segments(records: DataFrame) -> DataFrame:
    """One row per (partition, segment_no) with its sequence and time bounds."""
    return records.groupBy("partition", "segment_no").agg(
        F.min("lsn").alias("base_lsn"), F.max("lsn").alias("last_lsn"),
        F.min("timestamp_ms").alias("min_timestamp_ms"), F.max("timestamp_ms").alias("max_timestamp_ms"),
        F.count(F.lit(1)).alias("record_count"))


def heads(segs: DataFrame) -> DataFrame:
    return segs.groupBy("partition").agg(
        (F.max("last_lsn") + 1).alias("next_lsn"), F.min("base_lsn").alias("oldest_lsn"),
        F.count(F.lit(1)).alias("segment_count"), F.max_by("max_timestamp_ms", "base_lsn").alias("last_timestamp_ms"))


def find_segment(segs: DataFrame, partition: int, lsn: int) -> DataFrame:
    return segs.where((F.col("partition") == partition) & (F.col("base_lsn") <= lsn) & (F.col("last_lsn") >= lsn))


def lookup_timestamp(segs: DataFrame, partition: int, timestamp_ms: int) -> DataFrame:
    """The earliest segment that can hold a record at or after the timestamp."""
    return segs.where((F.col("partition") == partition) & (F.col("max_timestamp_ms") >= timestamp_ms)).orderBy("base_lsn").limit(1)


def page_limit(limit: int) -> int:
    if limit < 0:
        raise InvalidRequestError(f"negative page limit {limit}")
    return min(limit or schema.PAGE_LIMIT_DEFAULT, schema.PAGE_LIMIT_MAX)


def list_segments(segs: DataFrame, partition: int, from_lsn: int, limit: int = 0) -> DataFrame:
    """One page, in order; ``has_more`` and the continuation ``next_lsn`` stand on each row."""
    k = page_limit(limit)
    ahead = segs.where((F.col("partition") == partition) & (F.col("last_lsn") >= from_lsn)).orderBy("base_lsn").limit(k + 1)
    order = Window.orderBy("base_lsn")  # at most k + 1 rows
    numbered = ahead.withColumn("_i", F.row_number().over(order)).withColumn("_follow", F.lead("base_lsn").over(order))
    last = F.max(F.when(F.col("_i") == k, F.col("_follow"))).over(Window.partitionBy())
    return (numbered.withColumn("next_lsn", last).withColumn("has_more", F.col("next_lsn").isNotNull())
            .where(F.col("_i") <= k).drop("_i", "_follow"))


def leaf_pages(segs: DataFrame, fanout: int) -> DataFrame:
    """Rollup of ``fanout`` consecutive segments; the last page may still be filling."""
    return (segs.withColumn("leaf_no", F.floor(F.col("segment_no") / fanout).cast("long"))
            .groupBy("partition", "leaf_no")
            .agg(F.min("base_lsn").alias("seq_lo"), F.max("last_lsn").alias("seq_hi"),
                 F.min("min_timestamp_ms").alias("min_timestamp_ms"), F.max("max_timestamp_ms").alias("max_timestamp_ms"),
                 F.count(F.lit(1)).alias("entries")))


def index_pages(leaves: DataFrame, fanout: int) -> DataFrame:
    """The next level up: full groups of ``fanout`` full leaves carry into one index page."""
    return (leaves.withColumn("index_no", F.floor(F.col("leaf_no") / fanout).cast("long"))
            .groupBy("partition", "index_no")
            .agg(F.min("seq_lo").alias("seq_lo"), F.max("seq_hi").alias("seq_hi"),
                 F.min("min_timestamp_ms").alias("min_timestamp_ms"), F.max("max_timestamp_ms").alias("max_timestamp_ms"),
                 F.count(F.lit(1)).alias("entries")))


def locate(records: DataFrame, segs: DataFrame, span: int) -> DataFrame:
    """Join records to the segment that contains them.

    Segments are disjoint, so the point-in-interval join is an equi-join on coarse slots of
    ``span`` sequence numbers plus the interval test; a segment is listed in the few slots it
    touches.
    """
    slots = segs.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("base_lsn") / span), F.floor(F.col("last_lsn") / span))))
    return (records.withColumn("_slot", F.floor(F.col("lsn") / span))
            .join(slots.select("partition", "_slot", "segment_no", "base_lsn", "last_lsn"), ["partition", "_slot"])
            .where((F.col("lsn") >= F.col("base_lsn")) & (F.col("lsn") <= F.col("last_lsn"))).drop("_slot"))


def duplicate_identities(segs: DataFrame, identity: str = "segment_uuid") -> DataFrame:
    """Identities that more than one segment of a partition has; a catalog must not have any."""
    return segs.groupBy("partition", identity).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def roots_and_active(segs: DataFrame, fanout: int) -> DataFrame:
    """What a head refers to with one level of pages: full leaves, then the segments after them."""
    leaves = leaf_pages(segs, fanout)
    full = leaves.where(F.col("entries") == fanout).select("partition", F.lit("page").alias("kind"), "seq_lo", "seq_hi")
    rest = segs.withColumn("leaf_no", F.floor(F.col("segment_no") / fanout)).join(leaves.where(F.col("entries") < fanout).select("partition", "leaf_no"), ["partition", "leaf_no"], "left_semi")
    return full.unionByName(rest.select("partition", F.lit("segment").alias("kind"), F.col("base_lsn").alias("seq_lo"), F.col("last_lsn").alias("seq_hi")))

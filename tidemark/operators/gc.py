"""Garbage collection as plans: functions return what may go and never delete themselves."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reclaimable_segments(objects: DataFrame, floors: DataFrame) -> DataFrame:
    return objects.join(floors.select("partition", "safe_floor"), "partition").where(F.col("base_lsn") < F.col("safe_floor")).drop("safe_floor")


def reclaimable_pages(pages: DataFrame, floors: DataFrame) -> DataFrame:
    return pages.join(floors.select("partition", "safe_floor"), "partition").where(F.col("seq_hi") < F.col("safe_floor")).drop("safe_floor")


def stale_staging(objects: DataFrame, heads: DataFrame, now_ms: int, delay_ms: int) -> DataFrame:
    """Uploads of fenced writers that are old enough."""
    return (objects.join(heads.select("partition", F.col("writer_epoch").alias("head_epoch")), "partition")
            .where((F.col("writer_epoch") < F.col("head_epoch")) & (now_ms - F.col("created_ms") >= delay_ms)).drop("head_epoch"))


def budgeted(candidates: DataFrame, max_deletes: int, max_bytes: int, by: str = "partition", order: str = "base_lsn") -> DataFrame:
    """The prefix that a run may delete; the first candidate always fits, however large it is."""
    w = Window.partitionBy(by).orderBy(order)
    upto = F.sum("size_bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (candidates.withColumn("_rank", F.row_number().over(w)).withColumn("_upto", upto)
            .where((F.col("_rank") <= max_deletes) & ((F.col("_rank") == 1) | (F.col("_upto") <= max_bytes))).drop("_rank", "_upto"))


def orphan_eligible() -> Column:
    """May an unreferenced segment go? Not while the delayed floor still guards it, not if a
    newer writer made it, and not if the current writer may still publish it."""
    guarded = (F.col("base_lsn") < F.col("oldest_lsn")) & (F.col("base_lsn") >= F.col("safe_floor"))
    return (~guarded & (F.col("writer_epoch") <= F.col("head_epoch"))
            & ((F.col("base_lsn") < F.col("next_lsn")) | (F.col("writer_epoch") < F.col("head_epoch"))))


def orphan_segments(objects: DataFrame, referenced: DataFrame, heads: DataFrame, now_ms: int, delay_ms: int) -> DataFrame:
    """Physical segments that no head can reach: an anti-join plus eligibility.

    ``heads`` has partition, next_lsn, oldest_lsn, head_epoch and safe_floor.
    """
    loose = objects.join(referenced.select("key"), "key", "left_anti")
    return loose.join(heads, "partition").where(orphan_eligible() & (now_ms - F.col("created_ms") >= delay_ms)).select(objects.columns)


def orphan_pages(pages: DataFrame, reachable: DataFrame, heads: DataFrame) -> DataFrame:
    """Unreachable pages of an already committed generation: candidates for quarantine."""
    loose = pages.join(reachable.select("key"), "key", "left_anti")
    return (loose.join(heads.select("partition", F.col("generation").alias("head_generation")), "partition")
            .where(F.col("generation") < F.col("head_generation")).select(pages.columns))


def confirm_quarantine(quarantine: DataFrame, still_orphan: DataFrame, now_ms: int, delay_ms: int) -> DataFrame:
    """Second phase: quarantined long enough and still unreachable."""
    return quarantine.join(still_orphan.select("key"), "key", "left_semi").where(now_ms - F.col("since_ms") >= delay_ms)


def run_summary(objects: DataFrame, doomed: DataFrame) -> DataFrame:
    """Counters of a pass, per partition."""
    flagged = objects.join(doomed.select("key", F.lit(1).alias("_doomed")), "key", "left")
    return flagged.groupBy("partition").agg(
        F.count(F.lit(1)).alias("scanned"), F.count("_doomed").alias("candidates"),
        F.coalesce(F.sum(F.when(F.col("_doomed") == 1, F.col("size_bytes"))), F.lit(0)).alias("candidate_bytes"))


def first_keys(objects: DataFrame, after_key: str, limit: int) -> DataFrame:
    """One listing page: the first keys strictly after a key."""
    return objects.where(F.col("key") > after_key).orderBy("key").limit(limit)


def delete_checkpoints(candidates: DataFrame, key: str = "key") -> DataFrame:
    """The key before each candidate: where a listing resumes if its delete fails."""
    return candidates.withColumn("before_key", F.lag(key, 1, "").over(Window.partitionBy("partition").orderBy(key)))


def ready_first(work: DataFrame, ready: str, ties: list[str], limit: int) -> DataFrame:
    """What is ready earliest; ties in the order they were queued."""
    return work.orderBy(ready, *ties).limit(limit)

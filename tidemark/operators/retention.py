"""Retention: resolve requests, move the floor to a segment boundary, trim."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..errors import RetentionRegressionError


def latest_requests(requests: DataFrame) -> DataFrame:
    """The request with the highest policy version wins, per partition."""
    return requests.groupBy("partition").agg(
        F.max("policy_version").alias("policy_version"), F.max_by("before_lsn", "policy_version").alias("before_lsn"))


def admit(current: tuple[int, int] | None, version: int, before_lsn: int) -> bool:
    """Whether a (version, position) request changes the state; raises if it goes backwards."""
    if current is None:
        return True
    if (version, before_lsn) == current:
        return False
    if version <= current[0] or before_lsn < current[1]:
        raise RetentionRegressionError(f"({version}, {before_lsn}) is older than {current}")
    return True


def effective_floor(segs: DataFrame, requests: DataFrame) -> DataFrame:
    """Floor per partition: the base of the segment holding the target, or the head."""
    head = segs.groupBy("partition").agg((F.max("last_lsn") + 1).alias("next_lsn"))
    target = head.join(requests, "partition").withColumn("target", F.least("before_lsn", "next_lsn"))
    kept = (segs.join(target.select("partition", "target"), "partition").where(F.col("last_lsn") >= F.col("target"))
            .groupBy("partition").agg(F.min("base_lsn").alias("base")))
    return (target.join(kept, "partition", "left")
            .select("partition", "target", F.coalesce("base", "next_lsn").alias("oldest_lsn"), "next_lsn"))


def trim(segs: DataFrame, floors: DataFrame) -> DataFrame:
    return segs.join(floors.select("partition", "oldest_lsn"), "partition").where(F.col("base_lsn") >= F.col("oldest_lsn")).drop("oldest_lsn")


def safe_floors(states: DataFrame, floors: DataFrame, now_ms: int, delay_ms: int = schema.DELETE_DELAY_MS) -> DataFrame:
    """Promote a pending floor to the safe floor once it is older than the delete delay.

    ``states`` has partition, safe_floor, pending_floor, pending_since_ms.
    """
    due = F.col("pending_since_ms").isNotNull() & (F.lit(now_ms) - F.col("pending_since_ms") >= delay_ms)
    safe = F.when(due, F.greatest("safe_floor", "pending_floor")).otherwise(F.coalesce("safe_floor", F.lit(0)))
    joined = states.join(floors.select("partition", "oldest_lsn"), "partition", "full").withColumn("new_safe", safe)
    newer = F.col("oldest_lsn") > F.greatest(F.col("new_safe"), F.when(due, F.lit(0)).otherwise(F.coalesce("pending_floor", F.lit(0))))
    waiting = F.col("pending_since_ms").isNotNull() & ~due
    return joined.select(
        "partition", F.col("new_safe").alias("safe_floor"),
        F.when(waiting, F.col("pending_floor")).when(newer, F.col("oldest_lsn")).alias("pending_floor"),
        F.when(waiting, F.col("pending_since_ms")).when(newer, F.lit(now_ms)).alias("pending_since_ms"))

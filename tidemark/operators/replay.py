"""Replay: range, point and timestamp reads bounded by a captured head, and cursors."""

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..errors import (CheckpointAheadError, CheckpointError, CheckpointMismatchError, InvalidRequestError, LsnExhaustedError,
                      LsnExpiredError, PartitionNotFoundError)

CHECKPOINT_VERSION = 1


@dataclass(frozen=True)
class Head:
    """A committed snapshot of one partition; a query uses a single one throughout."""

    partition: int
    next_lsn: int
    oldest_lsn: int = 0


def read_limit(limit: int, most: int = schema.READ_LIMIT) -> int:
    if limit < 0:
        raise InvalidRequestError(f"negative limit {limit}")
    return min(limit or schema.READ_LIMIT, most)


def head_of(heads: DataFrame, partition: int) -> Head:
    row = heads.where(F.col("partition") == partition).select("next_lsn", "oldest_lsn").first()
    if row is None:
        raise PartitionNotFoundError(f"partition {partition}")
    return Head(partition, row["next_lsn"], row["oldest_lsn"])


def visible(records: DataFrame, head: Head) -> DataFrame:
    return records.where((F.col("partition") == head.partition) & (F.col("lsn") >= head.oldest_lsn) & (F.col("lsn") < head.next_lsn))


def consume(records: DataFrame, head: Head, start: int, limit: int = 0, most: int = schema.READ_LIMIT) -> DataFrame:
    """Records from ``start`` in order. Raises below the floor, is empty at or past the head."""
    if start < head.oldest_lsn:
        raise LsnExpiredError(start, head.oldest_lsn, head.next_lsn)
    return visible(records, head).where(F.col("lsn") >= start).orderBy("lsn").limit(read_limit(limit, most))


def consume_after(records: DataFrame, head: Head, after: int, limit: int = 0) -> DataFrame:
    if after >= schema.EXHAUSTED_LSN:
        raise LsnExhaustedError("no position follows the largest sequence number")
    return consume(records, head, after + 1, limit)


def fetch(records: DataFrame, head: Head, lsn: int) -> DataFrame:
    """At most one row; nothing past the head, an error below the floor."""
    if lsn < head.oldest_lsn:
        raise LsnExpiredError(lsn, head.oldest_lsn, head.next_lsn)
    return visible(records, head).where(F.col("lsn") == lsn)


def consume_from_timestamp(records: DataFrame, head: Head, timestamp_ms: int, limit: int = 0) -> DataFrame:
    """Timestamps never decrease with the sequence number, so the seek is a plain predicate
    that reaches the file statistics; no separate lookup of the first position is needed."""
    return visible(records, head).where(F.col("timestamp_ms") >= timestamp_ms).orderBy("lsn").limit(read_limit(limit))


def between_timestamps(records: DataFrame, head: Head, first_ms: int, last_ms: int) -> DataFrame:
    return visible(records, head).where(F.col("timestamp_ms").between(first_ms, last_ms))


def next_position(batch: DataFrame, start: int) -> int:
    """Where the following read starts: after the last returned record, else unchanged."""
    last = batch.agg(F.max("lsn")).first()[0]
    return start if last is None else last + 1


@dataclass
class Cursor:
    """Replays one partition batch by batch; advances only when records were returned. At its
    head it asks ``refresh(position)``, if given, for a newer one."""

    records: DataFrame
    head: Head
    position: int
    limit: int = 0
    closed: bool = False
    refresh: Callable[[int], Head] | None = None

    def next(self) -> list:
        if self.closed:
            raise InvalidRequestError("cursor is closed")
        if self.refresh is not None and self.position >= self.head.next_lsn:
            self.head = self.refresh(self.position)
        rows = consume(self.records, self.head, self.position, self.limit).collect()  # at most the read limit
        if rows:
            self.position = rows[-1]["lsn"] + 1
        return rows

    def seek(self, lsn: int) -> None:
        self.position = lsn

    def fork(self) -> "Cursor":
        return replace(self)

    def close(self) -> None:
        self.closed = True

    def checkpoint(self, stream_id: str) -> str:
        return json.dumps({"version": CHECKPOINT_VERSION, "stream_id": stream_id, "partition": self.head.partition, "next_lsn": self.position})


def resume(records: DataFrame, head: Head, stream_id: str, token: str, limit: int = 0) -> Cursor:
    """Validate a checkpoint against the latest head and continue from it."""
    try:
        got = json.loads(token)
        version, stream, partition, position = got["version"], got["stream_id"], got["partition"], int(got["next_lsn"])
    except (ValueError, KeyError, TypeError) as e:
        raise CheckpointError("malformed checkpoint") from e
    if version != CHECKPOINT_VERSION:
        raise CheckpointError(f"checkpoint version {version}")
    if partition != head.partition or stream != stream_id:
        raise CheckpointMismatchError(f"checkpoint is for {stream}/{partition}")
    if position < head.oldest_lsn:
        raise LsnExpiredError(position, head.oldest_lsn, head.next_lsn)
    if position > head.next_lsn:
        raise CheckpointAheadError(f"checkpoint {position} is past the head {head.next_lsn}")
    return Cursor(records, head, position, limit)


def classify_checkpoints(tokens: DataFrame, heads: DataFrame, stream_id: str) -> DataFrame:
    """The same validation for many checkpoints at once, as a ``status`` column."""
    status = (F.when(F.col("version") != CHECKPOINT_VERSION, "invalid")
              .when((F.col("token_stream") != stream_id) | F.col("next_lsn").isNull(), "mismatch")
              .when(F.col("position") < F.col("oldest_lsn"), "expired")
              .when(F.col("position") > F.col("next_lsn"), "ahead").otherwise("ok"))
    return tokens.join(heads.select("partition", "next_lsn", "oldest_lsn"), "partition", "left").withColumn("status", status)

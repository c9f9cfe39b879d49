"""The public facade: one object per stream, with writers, readers and maintenance."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..errors import TimestampRegressionError
from ..metrics import Metrics
from ..operators import ingest, replay
from ..sources import timeline
from ..sources.store import HeadCache, Store

WRITE_RECORDS = 16_384


class Timelines:
    def __init__(self, spark: SparkSession, root: str, stream_id: str, leaf_limit: int = 128, index_limit: int = 128):
        timeline.register(spark)
        self.spark, self.root, self.store = spark, root, Store(root, stream_id, leaf_limit, index_limit)
        self.stream_id, self.cache, self.metrics = self.store.stream_id, HeadCache(self.store), Metrics()

    def initialize_partition(self, partition: int, next_lsn: int = 0):
        return self.store.initialize(partition, next_lsn)

    def heads(self) -> DataFrame:
        rows = [(h.partition, h.next_lsn, h.oldest_lsn, h.writer_epoch, h.segment_count, h.last_timestamp_ms)
                for h in map(self.store.load, self.store.partitions())]
        return self.spark.createDataFrame(rows, "partition long, next_lsn long, oldest_lsn long, writer_epoch long, segment_count long, last_timestamp_ms long")

    def segments(self) -> DataFrame:
        rows = [(p, s.uri, s.base_lsn, s.last_lsn, s.min_timestamp_ms, s.max_timestamp_ms, s.record_count, s.size_bytes, s.writer_epoch, s.segment_uuid)
                for p in self.store.partitions() for s in self.store.segments(self.store.load(p))]
        return self.spark.createDataFrame(rows, "partition long, uri string, base_lsn long, last_lsn long, min_timestamp_ms long, max_timestamp_ms long, "
                                                "record_count long, size_bytes long, writer_epoch long, segment_uuid string")

    def pages(self) -> DataFrame:
        """The index pages that heads reach, with their level and the generation of the head."""
        rows = [(p, r.key, r.level, r.seq_lo, r.seq_hi, r.min_timestamp_ms, r.max_timestamp_ms, r.entries, h.generation)
                for p in self.store.partitions() for h in [self.store.load(p)] for r in self.store.pages(p).reachable(h.roots)]
        return self.spark.createDataFrame(rows, "partition long, key string, level int, seq_lo long, seq_hi long, min_timestamp_ms long, max_timestamp_ms long, "
                                                "entries long, generation long")

    def append(self, rows: DataFrame, order: list[str], max_records: int = 16_384, writer_id: str | None = None) -> dict[int, int]:
        """Append rows (partition, timestamp_ms, headers, value and the order columns).

        Numbers them behind the heads, refuses timestamp regressions, writes and commits.
        Returns the new next_lsn of each touched partition.
        """
        found = rows.groupBy("partition").agg(F.min("timestamp_ms").alias("first"), F.max(ingest.record_size()).alias("largest"), F.count(F.lit(1)).alias("n")).collect()
        touched, largest = {r["partition"]: r["first"] for r in found}, max((r["largest"] for r in found), default=0)
        for p, first in touched.items():
            head, _ = self.store.initialize(p)
            if head.last_timestamp_ms is not None and first < head.last_timestamp_ms:
                raise TimestampRegressionError(f"partition {p}: {first} after {head.last_timestamp_ms}")
        heads = self.heads().select("partition", "next_lsn")
        numbered = ingest.assign_lsn(rows, order, heads=heads).withColumn("stream_id", F.lit(self.stream_id))
        if largest * max_records <= schema.ROLL_BYTES:
            # bytes can't cut a segment, so its borders are known and a partition is written by many tasks
            run = max_records * max(1, WRITE_RECORDS // max_records)
            runs = numbered.join(F.broadcast(heads), "partition").withColumn("_run", F.floor((F.col("lsn") - F.col("next_lsn")) / run))
            total, most = sum(r["n"] for r in found), sum(-(-r["n"] // run) for r in found)
            spread = runs.repartition(max(1, min(most, max(timeline.TASKS, total // timeline.TASK_RECORDS))), "partition", "_run")
        else:
            spread = numbered.repartition("partition")
        ready = spread.sortWithinPartitions("partition", "lsn").select("stream_id", "partition", "lsn", "timestamp_ms", "headers", "value")
        (ready.write.format("timeline").mode("append")
         .options(path=self.root, stream=self.stream_id, partitions=",".join(map(str, touched)), maxRecords=max_records,
                  writerId=writer_id or uuid.uuid4().hex, leafLimit=self.store.limits[0], indexLimit=self.store.limits[1]).save())
        self.metrics.count("writer.append")
        return {p: self.cache.refresh(p).next_lsn for p in touched}

    def records(self, **options) -> DataFrame:
        return self.spark.read.format("timeline").options(path=self.root, stream=self.stream_id, **options).load()

    def read_stream(self, partitions: list[int] | None = None, max_records: int | None = None) -> DataFrame:
        reader = self.spark.readStream.format("timeline").options(path=self.root, stream=self.stream_id)
        if partitions is not None:
            reader = reader.option("partitions", ",".join(map(str, partitions)))
        return (reader.option("maxRecordsPerBatch", max_records) if max_records else reader).load()

    def partition(self, partition: int) -> "Partition":
        return Partition(self, partition)

    def request_retention(self, partition: int, version: int, before_lsn: int):
        return self.store.request_retention(partition, version, before_lsn)

    def apply_retention(self, partition: int, session=None):
        self.metrics.count("writer.retention")
        head, applied = self.store.apply_retention(partition, session)
        self.cache.heads[partition] = head
        return head, applied


class Partition:
    """Reads of one partition. Each call captures one head; ``freshness`` says how new it has to
    be (see ``HeadCache``). Reads past the cached head ask for a newer one by default."""

    def __init__(self, log: Timelines, partition: int):
        self.log, self.number = log, partition

    def head(self, freshness: str = "latest", start: int | None = None) -> replay.Head:
        h = self.log.cache.head(self.number, freshness, start)
        self.log.metrics.count("reader.head")
        return replay.Head(h.partition, h.next_lsn, h.oldest_lsn)

    def _records(self, limit: int) -> DataFrame:
        return self.log.records(limit=replay.read_limit(limit), partitions=self.number)

    def consume(self, start: int, limit: int = 0, freshness: str = "on_tail") -> DataFrame:
        self.log.metrics.count("reader.read")
        return replay.consume(self._records(limit), self.head(freshness, start), start, limit)

    read = consume

    def consume_after(self, after: int, limit: int = 0) -> DataFrame:
        return replay.consume_after(self._records(limit), self.head("on_tail", min(after, 2**63 - 2) + 1), after, limit)

    def consume_from_timestamp(self, timestamp_ms: int, limit: int = 0) -> DataFrame:
        self.log.metrics.count("reader.timestamp_read")
        return replay.consume_from_timestamp(self._records(limit), self.head(), timestamp_ms, limit)

    def fetch(self, lsn: int) -> DataFrame:
        self.log.metrics.count("reader.fetch")
        return replay.fetch(self.log.records(partitions=self.number), self.head(), lsn)

    def cursor(self, start: int, limit: int = 0) -> replay.Cursor:
        return replay.Cursor(self._records(limit), self.head(), start, limit, refresh=lambda at: self.head("on_tail", at))

    def resume(self, token: str, limit: int = 0) -> replay.Cursor:
        found = replay.resume(self._records(limit), self.head(), self.log.stream_id, token, limit)
        return replay.replace(found, refresh=lambda at: self.head("on_tail", at))

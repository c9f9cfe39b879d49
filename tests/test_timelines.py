"""The facade end to end: append, replay, cursors, fencing, retention, tail."""

import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.functions.keys import canonical_stream_id
from tidemark.operators import ingest, replay, retention
from tidemark.plans.timelines import Timelines
from tidemark.sources.store import PartitionHead, SegmentRef
from tidemark.streaming.lsn import assign_stream_lsn


def rows(spark, first, n, partitions=2):
    return spark.range(first, first + n).select(
        (F.col("id") % partitions).alias("partition"), (F.col("id") * 10).alias("timestamp_ms"), F.col("id").alias("n"),
        F.array(F.struct(F.lit(b"k").alias("key"), F.lit(b"v").alias("value"))).alias("headers"), F.encode(F.concat(F.lit("v"), "id"), "UTF-8").alias("value"))


def test_append_replay_and_maintain(spark, tmp_path):
    log = Timelines(spark, str(tmp_path), "/agents/a/")
    assert log.append(rows(spark, 0, 100), ["n"], max_records=8) == {0: 50, 1: 50}
    assert log.append(rows(spark, 100, 20), ["n"], max_records=8) == {0: 60, 1: 60}
    one = log.partition(1)
    assert [r["lsn"] for r in one.consume(45, 10).collect()] == list(range(45, 55))
    got = one.fetch(51).first()
    assert bytes(got["value"]) == b"v103" and [(bytes(h["key"]), bytes(h["value"])) for h in got["headers"]] == [(b"k", b"v")]
    assert one.fetch(60).collect() == [] and one.consume(60).collect() == []
    assert [r["lsn"] for r in one.consume_from_timestamp(1000, 2).collect()] == [50, 51]
    with pytest.raises(errors.TimestampRegressionError):
        log.append(rows(spark, 0, 2), ["n"])
    cursor = one.cursor(50, 4)
    assert [r["lsn"] for r in cursor.next()] == [50, 51, 52, 53]
    token = cursor.checkpoint(log.stream_id)
    assert [r["lsn"] for r in one.resume(token, 3).next()] == [54, 55, 56]
    with pytest.raises(errors.CheckpointMismatchError):
        log.partition(0).resume(token)
    log.request_retention(1, 1, 20)
    with pytest.raises(errors.RetentionRegressionError):
        log.request_retention(1, 1, 10)
    head, applied = log.apply_retention(1)
    assert applied and (head.oldest_lsn, head.applied_retention_lsn) == (16, 20) and log.apply_retention(1)[1] is False
    with pytest.raises(errors.LsnExpiredError):
        one.consume(15)
    with pytest.raises(errors.LsnExpiredError):
        one.resume(token.replace("54", "3"))


def test_stream_source_tails_what_was_appended(spark, tmp_path):
    log = Timelines(spark, str(tmp_path / "log"), "tail")
    log.append(rows(spark, 0, 40), ["n"], max_records=8)
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def drain():
        q = log.read_stream().writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        return spark.read.parquet(out).count()

    assert drain() == 40
    log.append(rows(spark, 40, 10), ["n"])
    assert drain() == 50


def test_streaming_lsn_is_dense_across_batches(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "partition long, timestamp_ms long, tiebreak long, value binary"
    for first in (0, 30):
        rows(spark, first, 30).select("partition", "timestamp_ms", F.col("n").alias("tiebreak"), "value").coalesce(1).write.mode("append").parquet(source)
        stream = assign_stream_lsn(spark.readStream.schema(schema).parquet(source))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "m")).trigger(availableNow=True).start(str(tmp_path / "o"))
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "o")).groupBy("partition").agg(F.sort_array(F.collect_list("lsn")).alias("l")).collect()
    assert all(r["l"] == list(range(30)) for r in got) and len(got) == 2


def test_only_one_writer_commits(tmp_path):
    from tidemark.sources.store import Store

    store = Store(str(tmp_path), "s")
    old = store.open_writer(1, "a")
    new = store.open_writer(1, "b")
    ref = SegmentRef("u", 0, 9, 5, 6, 10, 100, new.writer_epoch, "x")
    with pytest.raises(errors.FencedError):
        store.publish(old, [ref])
    head = store.publish(new, [ref])
    assert store.publish(new, [ref]) == head and head.next_lsn == 10
    with pytest.raises(errors.ConflictError):
        store.swap(PartitionHead(1, generation=head.generation - 1))
    with pytest.raises(errors.TimestampRegressionError):
        store.publish(new, [SegmentRef("w", 10, 12, 1, 6, 3, 9, new.writer_epoch, "y")])


def test_greedy_cuts_and_limits():
    import numpy as np

    cuts, _ = ingest.greedy_cuts(np.ones(5, int), 2, 10**9, (0, 0, 0))
    assert cuts.tolist() == [0, 0, 1, 1, 2]
    cuts, _ = ingest.greedy_cuts(np.array([50, 500, 10, 90, 1]), 100, 100, (0, 0, 0))
    assert cuts.tolist() == [0, 1, 2, 2, 3]
    assert (replay.read_limit(0), replay.read_limit(9999), replay.read_limit(7)) == (1024, 1024, 7)
    with pytest.raises(errors.InvalidRequestError):
        replay.read_limit(-1)
    assert retention.admit(None, 1, 5) and not retention.admit((1, 5), 1, 5)


@pytest.mark.parametrize("name", ["", "///", "a//b", "a/../b", "a\x01", "x" * 513])
def test_bad_stream_names(name):
    with pytest.raises(errors.InvalidRequestError):
        canonical_stream_id(name)


def test_reads_touch_few_segments_and_pages(spark, tmp_path):
    """Three range reads open a segment and one reads a block; a limited read plans only the segments that hold it."""
    from tidemark.sources import plseg
    from tidemark.sources.timeline import TimelineReader

    data, reads = plseg.encode([plseg.Record(i, b"x" * 40) for i in range(400)], plseg.SegmentOptions(0, 0, b"\2" * 16, block_bytes=600)), []

    def read_at(offset, n):
        reads.append(n)
        return data[offset:offset + n]

    reader = plseg.SegmentReader(read_at, len(data))
    assert len(reads) == 3 and reader.block_count == 40
    assert [r.lsn for r in reader.read(205, 3)] == [205, 206, 207] and len(reads) == 4
    assert reader.find_timestamp(333) == 333 and len(reads) == 5
    log = Timelines(spark, str(tmp_path), "touch", leaf_limit=4, index_limit=4)
    log.append(rows(spark, 0, 400), ["n"], max_records=10)
    options = {"path": str(tmp_path), "stream": "touch", "partitions": "1"}
    whole, limited = TimelineReader(options), TimelineReader(options | {"limit": "25"})
    limited.low = 57
    assert len(whole.partitions()) == 20 and [c.ref.base_lsn for c in limited.partitions()] == [50, 60, 70, 80]
    pages = log.store.pages(1)
    head = log.store.load(1)
    assert next(pages.scan(head.roots, head.active, 111, 112)).base_lsn == 110 and pages.reads <= len(head.roots)
    assert log.pages().where("level = 1").count() == 2 and head.segment_count == 20


def test_stream_restarts_with_limited_batches(spark, tmp_path):
    log = Timelines(spark, str(tmp_path / "log"), "tail")
    log.append(rows(spark, 0, 80), ["n"], max_records=8)
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    for more in (0, 30):
        if more:
            log.append(rows(spark, 80, more), ["n"])
        q = log.read_stream(max_records=7).writeStream.format("parquet").option("checkpointLocation", marks).trigger(processingTime="0 seconds").start(out)
        q.processAllAvailable()
        q.stop()
        got = spark.read.schema("partition long, lsn long").parquet(out)
        assert got.count() == got.distinct().count() == 80 + more

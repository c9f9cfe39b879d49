"""Many small segments: tasks follow the records, and an append is written by many tasks."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.plans import timelines
from tidemark.plans.timelines import Timelines
from tidemark.sources import timeline
from tidemark.sources.timeline import TASKS, TimelineReader, TimelineStreamReader, TimelineWriter


def batch(partition, lsns):
    n = len(lsns)
    return pa.RecordBatch.from_arrays([
        pa.array(["s"] * n), pa.array([partition] * n, pa.int64()), pa.array(lsns, pa.int64()), pa.array([i // 3 for i in lsns], pa.int64()),
        pa.array([None if i % 5 == 0 else [{"key": b"k", "value": None if i % 7 == 0 else b"%d" % i}] * (i % 3) for i in lsns], timeline.SHAPE.field("headers").type),
        pa.array([None if i % 11 == 0 else b"v%d" % i for i in lsns], pa.binary())], schema=timeline.SHAPE)


def written(root, records=1200, per_segment=2):
    """Two partitions; each is written by three tasks, runs of whole segments in mixed order."""
    w, third = TimelineWriter({"path": root, "stream": "s", "partitions": "0,1", "maxRecords": str(per_segment), "leafLimit": "4", "indexLimit": "4"}), records // 3
    tasks = [[batch(p, list(range(a, a + third)))] for a in (0, 2 * third, third) for p in (1, 0)]
    tasks[0] += [b.slice(7) for b in [batch(1, list(range(2 * third - 7, 3 * third)))]]  # a later run of a partition the task has had
    del tasks[2]
    w.commit([w.write(iter(t)) for t in tasks])


def rows(reader):
    return [r for c in reader.partitions() for b in reader.read(c) for r in b.to_pylist()]


def test_tasks_follow_records_not_segments(tmp_path):
    written(str(tmp_path))
    options = {"path": str(tmp_path), "stream": "s"}
    reader = TimelineReader(options)
    assert reader.store.load(0).segment_count == reader.store.load(1).segment_count == 600
    assert len(reader.partitions()) <= TASKS + 2  # 1,200 segments
    got = rows(reader)
    assert [(r["partition"], r["lsn"]) for r in got] == [(p, i) for p in (0, 1) for i in range(1200)]
    for r in got:
        i = r["lsn"]
        assert r["value"] == (b"" if i % 11 == 0 else b"v%d" % i) and r["timestamp_ms"] == i // 3
        assert r["headers"] == ([] if i % 5 == 0 else [{"key": b"k", "value": b"" if i % 7 == 0 else b"%d" % i}] * (i % 3))
    for low, high, ts_low, ts_high in ((0, 1200, 100, 250), (3, 1100, None, 20), (555, 556, None, None), (7, 900, 299, None), (0, 1200, 500, 600)):
        r = TimelineReader(options)
        r.low, r.high, r.ts_low, r.ts_high = low, high, ts_low, ts_high
        want = [i for i in range(low, high) if (ts_low is None or i // 3 >= ts_low) and (ts_high is None or i // 3 <= ts_high)]
        assert [(x["partition"], x["lsn"]) for x in rows(r)] == [(p, i) for p in (0, 1) for i in want]
    stream = TimelineStreamReader(options)
    parts = stream.partitions({"0": 5, "1": 1198}, {"0": 1003, "1": 1200})
    assert len(parts) <= TASKS + 2
    assert [(x["partition"], x["lsn"]) for c in parts for b in stream.read(c) for x in b.to_pylist()] == [(0, i) for i in range(5, 1003)] + [(1, 1198), (1, 1199)]


def test_planning_leaves_pages_to_tasks(tmp_path, monkeypatch):
    from tidemark.sources.pages import Pages

    written(str(tmp_path))
    reads, read = [], Pages.read
    monkeypatch.setattr(Pages, "read", lambda self, ref: reads.append(ref) or read(self, ref))
    found = TimelineReader({"path": str(tmp_path), "stream": "s"}).partitions()
    assert len(found) > 8 and len(reads) < 120  # of 400 pages


def test_batches_are_full_and_bounded_by_bytes(tmp_path, monkeypatch):
    written(str(tmp_path), 1200, 8)
    monkeypatch.setattr(timeline, "TASKS", 1)
    reader = TimelineReader({"path": str(tmp_path), "stream": "s", "partitions": "1"})
    (one,) = reader.partitions()
    assert [b.num_rows for b in reader.read(one)] == [1200]
    monkeypatch.setattr(timeline, "BATCH_BYTES", 400)
    assert max(b.num_rows for b in reader.read(one)) < 30


def test_an_append_cuts_the_same_segments_from_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(timelines, "WRITE_RECORDS", 16)
    log = Timelines(spark, str(tmp_path), "s", leaf_limit=4, index_limit=4)
    made = lambda first, n: spark.range(first, first + n).select(
        (F.col("id") % 2).alias("partition"), F.col("id").alias("timestamp_ms"), F.col("id").alias("n"),
        F.array(F.struct(F.lit(b"k").alias("key"), F.lit(b"v").alias("value"))).alias("headers"), F.encode(F.col("id").cast("string"), "UTF-8").alias("value"))
    assert log.append(made(0, 210), ["n"], max_records=8) == {0: 105, 1: 105}
    assert log.append(made(210, 90), ["n"], max_records=8) == {0: 150, 1: 150}
    got = sorted((s.base_lsn, s.last_lsn) for s in log.store.segments(log.store.load(1)))
    assert got == [(a, min(a + 7, 104)) for a in range(0, 105, 8)] + [(a, min(a + 7, 149)) for a in range(105, 150, 8)]
    wide = made(300, 20).withColumn("value", F.expr("CASE WHEN n = 310 THEN CAST(repeat('x', 5000) AS BINARY) ELSE value END"))
    assert log.append(wide, ["n"]) == {0: 160, 1: 160}  # bytes could cut it: one task a partition
    one = {r["lsn"]: bytes(r["value"]) for r in log.records().where("partition = 0").collect()}
    assert sorted(one) == list(range(160)) and all(v == (b"x" * 5000 if i == 155 else b"%d" % (2 * i)) for i, v in one.items())


def test_verified_reads_check_every_segment_of_a_task(tmp_path):
    written(str(tmp_path))
    options = {"path": str(tmp_path), "stream": "s", "partitions": "1", "verify": "true"}
    reader = TimelineReader(options)
    assert len(reader.partitions()) <= TASKS + 2 and [r["lsn"] for r in rows(reader)] == list(range(1200))
    hurt = list(reader.store.segments(reader.store.load(1)))[301].uri
    data = bytearray(open(hurt, "rb").read())
    data[64 + 60] ^= 1  # a reserved byte of the first block's preamble: only the segment's hash covers it
    os.chmod(hurt, 0o644)
    open(hurt, "wb").write(data)
    timeline.opened.cache_clear()
    assert len(rows(TimelineReader(options | {"verify": "false"}))) == 1200
    with pytest.raises(errors.CorruptDataError):
        rows(TimelineReader(options))

"""Spark data source ``timeline``: batch read with pushdown, batch write, stream read.

Options: ``path`` (a folder shared by driver and executors), ``stream``; reading:
``partitions`` (comma-separated), ``verify`` (check whole segments), ``limit`` (no more segments
of a partition than hold its first so many records; the rows still need a limit),
``maxRecordsPerBatch``; writing: ``writerId``, ``maxRecords``, ``maxBytes`` and ``maxAgeMs`` per
segment, ``codec``. Rows come as Arrow batches.
"""

import functools
import itertools
import json
import time
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa

from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceWriter,
                                    EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
                                    WriterCommitMessage)

from .. import schema as layout
from ..errors import CorruptDataError
from .plseg import Record, SegmentOptions, SegmentReader, encode, record_bytes
from .pages import INDEX_LIMIT, LEAF_LIMIT, PageRef, SegmentRef, bounds
from .store import Store

UNBOUNDED = 2**63 - 1


BATCH, BATCH_BYTES = 4096, 16 * 1024 * 1024
TASKS, TASK_RECORDS = 64, 65_536  # so many parts are read by a task each; beyond, neighbours share tasks
SHAPE = pa.schema([("stream_id", pa.string()), ("partition", pa.int64()), ("lsn", pa.int64()), ("timestamp_ms", pa.int64()),
                   ("headers", pa.list_(pa.struct([("key", pa.binary()), ("value", pa.binary())]))), ("value", pa.binary())])


class _Part(NamedTuple):
    """A segment, or a page of segments, of which [low, high) is read."""

    partition: int
    ref: SegmentRef | PageRef
    low: int
    high: int

    @property
    def records(self) -> int:
        first, last = bounds(self.ref)
        return max(0, min(last + 1, self.high) - max(first, self.low))


class _Chunk(InputPartition):
    """What one task reads, part after part."""

    def __init__(self, root, stream, parts: list[_Part], ts_low=None, ts_high=None, verify=False):
        self.root, self.stream, self.parts = root, stream, parts
        self.ts_low, self.ts_high, self.verify = ts_low, ts_high, verify

    @property
    def ref(self) -> SegmentRef | PageRef:
        return self.parts[0].ref


def task_records(total: int) -> int:
    """About how many records a task reads, of ``total``: the tasks follow the records, not the segments."""
    return max(1, min(TASK_RECORDS, total // TASKS))


def chunks(store: Store, parts: list[_Part], each: int, *options) -> list[_Chunk]:
    """Tasks of at least ``each`` records but the last; few parts get a task each."""
    groups, held = [], each
    for p in parts:
        if held >= each or len(parts) <= TASKS:
            groups.append([])
            held = 0
        groups[-1].append(p)
        held += p.records
    return [_Chunk(store.root, store.stream_id, g, *options) for g in groups]


class _Message(WriterCommitMessage):
    def __init__(self, refs: dict[int, list[SegmentRef]]):
        self.refs = refs


@functools.lru_cache(maxsize=64)
def opened(path: str, ref: SegmentRef) -> SegmentReader:
    """A segment opened and compared with its reference; a worker keeps the last few."""
    def read_at(offset, n):
        with open(path, "rb") as f:
            f.seek(offset)
            return f.read(n)

    reader = SegmentReader(read_at, ref.size_bytes)
    said = (reader.base_lsn, reader.last_lsn, reader.min_ts, reader.max_ts, reader.record_count, reader.uuid.hex())
    if said != (ref.base_lsn, ref.last_lsn, ref.min_timestamp_ms, ref.max_timestamp_ms, ref.record_count, ref.segment_uuid):
        raise CorruptDataError(f"{path} is not the segment its reference names")
    return reader


def _records(chunk: _Chunk) -> Iterator[tuple[int, Record]]:
    store = Store(chunk.root, chunk.stream)
    for p in chunk.parts:
        for ref in store.pages(p.partition).scan(((p.ref,),), (), p.low, p.high, chunk.ts_low):
            if chunk.ts_high is not None and ref.min_timestamp_ms > chunk.ts_high:
                break
            reader = opened(ref.uri, ref)
            if chunk.verify:
                reader.verify()
            for r in reader.scan(p.low, p.high, chunk.ts_low, chunk.ts_high):
                yield p.partition, r


def _batches(chunk: _Chunk) -> Iterator[pa.RecordBatch]:
    """Full batches over the borders of segments, bounded by rows and by bytes."""
    partitions, rows, held = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([chunk.stream] * len(rows), pa.string()), pa.array(partitions, pa.int64()),
            pa.array([r.lsn for r in rows], pa.int64()), pa.array([r.timestamp_ms for r in rows], pa.int64()),
            pa.array([[{"key": k, "value": v} for k, v in r.headers] for r in rows], SHAPE.field("headers").type),
            pa.array([r.value for r in rows], pa.binary())], schema=SHAPE)

    for partition, r in _records(chunk):
        partitions.append(partition)
        rows.append(r)
        held += record_bytes(r)
        if len(rows) == BATCH or held >= BATCH_BYTES:
            yield batch()
            partitions, rows, held = [], [], 0
    if rows:
        yield batch()


def contiguous(refs: list[SegmentRef | PageRef], low: int, next_lsn: int) -> list[SegmentRef | PageRef]:
    """The refs, if they cover [low, next_lsn) without a gap; CorruptDataError otherwise."""
    at = low
    for first, last in map(bounds, refs):
        if first > at or last < at:
            raise CorruptDataError(f"no segment holds {at}")
        at = last + 1
    if at < next_lsn:
        raise CorruptDataError(f"no segment holds {at}, the head is at {next_lsn}")
    return refs


def once_more(load, use):
    """``use(load())``; on contradicting data the head is loaded anew and the read tried once more."""
    try:
        return use(load())
    except CorruptDataError:
        return use(load())


class TimelineReader(DataSourceReader):
    """The heads are captured once, at planning. Planning reads the index down to pages of a task's
    size, which tasks read on; segments and pages outside the bounds are pruned."""

    def __init__(self, options: dict):
        self.store = Store(options["path"], options["stream"])
        named = options.get("partitions")
        self.wanted = {int(p) for p in named.split(",")} if named else None
        self.low, self.high, self.ts_low, self.ts_high = 0, UNBOUNDED, None, None
        self.verify = options.get("verify", "false") == "true"
        self.limit = int(options["limit"]) if "limit" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self._push(f):
                yield f

    def _push(self, f: Filter) -> bool:
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        value = getattr(f, "value", None)
        if name == "partition" and isinstance(f, (EqualTo, In)):
            some = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted = some if self.wanted is None else self.wanted & some
            return True
        if name == "lsn" and isinstance(value, int):
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, value + (not isinstance(f, LessThan)))
            return isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
        if name == "timestamp_ms" and isinstance(value, int):
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                low = value + isinstance(f, GreaterThan)
                self.ts_low = low if self.ts_low is None else max(self.ts_low, low)
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                high = value - isinstance(f, LessThan)
                self.ts_high = high if self.ts_high is None else min(self.ts_high, high)
            return isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
        return False

    def partitions(self) -> list[InputPartition]:
        named = self.wanted if self.wanted is not None else self.store.partitions()
        heads = [once_more(lambda p=p: self.store.load(p), lambda h: h) for p in sorted(set(named) & set(self.store.partitions()))]
        each = task_records(sum(max(0, high - low) for low, high in map(self._range, heads)))
        parts = []
        for h in heads:
            first = iter([h])
            parts += once_more(lambda: next(first, None) or self.store.load(h.partition), lambda h: self._parts(h, each))
        return chunks(self.store, parts, each, self.ts_low, self.ts_high, self.verify)

    def _range(self, head) -> tuple[int, int]:
        return max(self.low, head.oldest_lsn), min(self.high, head.next_lsn)

    def _parts(self, head, each: int) -> list[_Part]:
        low, high = self._range(head)
        if low >= high:
            return []
        out, held, refs = [], 0, []
        for s in self.store.segments(head, low, high, self.ts_low, each if self.limit is None else 0):
            refs.append(s)
            if self.ts_high is not None and s.min_timestamp_ms > self.ts_high:
                break
            out.append(_Part(head.partition, s, low, high))
            if self.ts_low is None or s.min_timestamp_ms >= self.ts_low:
                held += out[-1].records
            if self.limit is not None and held >= self.limit:
                break
        if refs:
            contiguous(refs, max(low, bounds(refs[0])[0]) if self.ts_low is not None else low, min(high, bounds(refs[-1])[1] + 1))
        return out

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return _batches(partition) if isinstance(partition, _Chunk) else iter(())


class TimelineStreamReader(DataSourceStreamReader):
    """Offsets are ``{partition: next_lsn}``; a batch takes what the heads have gained."""

    def __init__(self, options: dict):
        self.store = Store(options["path"], options["stream"])
        named = options.get("partitions")
        self.wanted = [int(p) for p in named.split(",")] if named else None
        self.most = int(options.get("maxRecordsPerBatch", UNBOUNDED))
        self.planned: dict[str, int] = {}

    def _heads(self):
        return [self.store.load(p) for p in (self.wanted if self.wanted is not None else self.store.partitions())]

    def initialOffset(self) -> dict:
        return {str(h.partition): h.oldest_lsn for h in self._heads()}

    def latestOffset(self) -> dict:
        out = {}
        for h in self._heads():
            at = self.planned.get(str(h.partition), h.oldest_lsn)
            out[str(h.partition)] = min(h.next_lsn, at + self.most)
        self.planned.update(out)
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ranges, parts = [], []
        for name, high in end.items():
            self.planned[name] = max(self.planned.get(name, 0), high)
            head = self.store.load(int(name))
            ranges.append((head, start.get(name, head.oldest_lsn), high))
        each = task_records(sum(max(0, high - low) for _, low, high in ranges))
        for head, low, high in ranges:
            parts += [_Part(head.partition, s, low, high) for s in self.store.segments(head, low, high, whole=each)]
        return chunks(self.store, parts, each)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        return _batches(partition)

    def commit(self, end: dict) -> None:
        pass


def header_tuples(column: pa.ListArray) -> list[tuple[tuple[bytes, bytes], ...]]:
    """The headers of each record; keys and values are converted a batch at a time."""
    keys, values = (column.values.field(n).to_pylist() for n in ("key", "value"))
    pairs, at = [(k, v or b"") for k, v in zip(keys, values)], column.offsets.to_pylist()
    return [tuple(pairs[a:b]) if there else () for a, b, there in zip(at, at[1:], column.is_valid().to_pylist())]


class RollPolicy:
    """When a segment ends: by records, by raw bytes or by the age of its first record; the first
    limit that is reached cuts."""

    def __init__(self, max_records: int = layout.ROLL_RECORDS, max_bytes: int = layout.ROLL_BYTES, max_age_ms: float | None = None):
        self.max_records, self.max_bytes, self.max_age_ms = max_records, max_bytes, max_age_ms

    def cuts(self, records: int, used: int, next_size: int, age_ms: float = 0.0) -> bool:
        """Whether a segment with so much in it has to end before a record of ``next_size``."""
        if not records:
            return False
        return records >= self.max_records or used + next_size > self.max_bytes or self.max_age_ms is not None and age_ms >= self.max_age_ms


class TimelineWriter(DataSourceArrowWriter):
    """Tasks write segment files; the commit on the driver is one head swap per partition.

    Input rows must already have a dense ``lsn`` that continues the head, and a task must get runs
    of a partition in order, each of whole segments: ``Timelines.append`` does both. A failed or
    repeated task leaves files that no head reaches, which is what scrubbing finds.
    """

    def __init__(self, options: dict):
        self.options = {"path": options["path"], "stream": options["stream"]}
        self.limits = int(options.get("leafLimit", LEAF_LIMIT)), int(options.get("indexLimit", INDEX_LIMIT))
        self.roll = RollPolicy(int(options.get("maxRecords", layout.ROLL_RECORDS)), int(options.get("maxBytes", layout.ROLL_BYTES)),
                               int(options["maxAgeMs"]) if "maxAgeMs" in options else None)
        self.codec = int(options.get("codec", layout.CODEC_ZSTD))
        store = Store(options["path"], options["stream"])
        writer_id = options.get("writerId") or uuid.uuid4().hex
        targets = [int(p) for p in options["partitions"].split(",")]
        self.sessions = {p: store.open_writer(p, writer_id) for p in targets}

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, refs, pending, current, used, began = Store(self.options["path"], self.options["stream"]), {}, [], None, 0, 0.0

        def flush():
            nonlocal used
            if pending:
                refs.setdefault(current, []).append(self._segment(store, current, pending, self.codec))
                pending.clear()
            used = 0

        def plain(b: pa.RecordBatch) -> Iterator[tuple]:
            return zip(*(b.column(c).to_pylist() for c in ("partition", "lsn", "timestamp_ms", "value")), header_tuples(b.column("headers")))

        for partition, lsn, ts, value, headers in itertools.chain.from_iterable(map(plain, batches)):
            record = Record(ts, value or b"", headers, lsn)
            size = record_bytes(record)
            follows = partition == current and (not pending or lsn == pending[-1].lsn + 1)
            if not follows or self.roll.cuts(len(pending), used, size, (time.monotonic() - began) * 1000):
                flush()
                current = partition
            if not pending:
                began = time.monotonic()
            pending.append(record)
            used += size
        flush()
        return _Message(refs)

    def _segment(self, store: Store, partition: int, records: list[Record], codec: int) -> SegmentRef:
        import os

        uid, epoch, base = uuid.uuid4().hex, self.sessions[partition].writer_epoch, records[0].lsn
        data = encode(records, SegmentOptions(partition, base, bytes.fromhex(uid), codec=codec, algo=layout.HASH_XXH64))
        path = store.segment_path(partition, base, epoch, uid)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "xb") as f:
            f.write(data)
        return SegmentRef(path, base, records[-1].lsn, records[0].timestamp_ms, records[-1].timestamp_ms, len(records), len(data), epoch, uid)

    def commit(self, messages) -> None:
        store, gathered = Store(self.options["path"], self.options["stream"], *self.limits), {}
        for m in messages:
            for p, refs in (m.refs if m else {}).items():
                gathered.setdefault(p, []).extend(refs)
        for p, refs in gathered.items():
            store.publish(self.sessions[p], refs)

    def abort(self, messages) -> None:
        """What the finished tasks wrote goes; files of failed tasks are left to scrubbing."""
        import contextlib
        import os

        for m in messages:
            for refs in (m.refs if m else {}).values():
                for r in refs:
                    with contextlib.suppress(FileNotFoundError):
                        os.unlink(r.uri)


class TimelineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "timeline"

    def schema(self):
        return layout.RECORDS

    def reader(self, schema) -> DataSourceReader:
        return TimelineReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TimelineStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TimelineWriter(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TimelineSource)


def checkpoint_token(stream_id: str, partition: int, next_lsn: int) -> str:
    return json.dumps({"version": 1, "stream_id": stream_id, "partition": partition, "next_lsn": next_lsn})

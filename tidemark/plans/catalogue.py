"""The query catalogue: every operator over the driver's tables, with equivalent SQL.

The timeline under test comes from ``events``: partition = user_id % 8, order (ts, event_id),
one header with the event type, the JSON properties as payload, segments of 128 records.
"""

import atexit
import hashlib
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hashing, keys, numbers
from ..operators import audit, catalog, gc, ingest, projection, replay, retention

PER_SEGMENT, PER_BLOCK, FANOUT = 128, 16, 4
HOUR_MS = 3_600_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BASE = """WITH r AS (SELECT user_id % 8 AS p, epoch_us(ts) // 1000 AS t, event_id, event_type, props, user_id, value AS amount,
  row_number() OVER (PARTITION BY user_id % 8 ORDER BY epoch_us(ts) // 1000, event_id) - 1 AS lsn FROM events),
s AS (SELECT p, lsn // 128 AS seg, min(lsn) AS base, max(lsn) AS last, min(t) AS mn, max(t) AS mx, count(*) AS n FROM r GROUP BY 1, 2),
h AS (SELECT p, max(last) + 1 AS next_lsn, min(base) AS oldest_lsn, count(*) AS segs, max(mx) AS last_ms FROM s GROUP BY 1)
"""


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as timeline records with sequence numbers."""
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        (F.col("user_id") % 8).alias("partition"), ts.alias("timestamp_ms"), "event_id", "event_type", "user_id",
        F.col("value").alias("amount"), "props",
        F.array(F.struct(F.encode(F.lit("event_type"), "UTF-8").alias("key"), F.encode("event_type", "UTF-8").alias("value"))).alias("headers"),
        F.encode("props", "UTF-8").alias("value"))
    return ingest.assign_lsn(rows, ["event_id"])


def segments(spark, d) -> DataFrame:
    return catalog.segments(ingest.roll_by_records(records(spark, d), PER_SEGMENT))


def head(spark, d, partition: int) -> replay.Head:
    return replay.head_of(catalog.heads(segments(spark, d)), partition)


def shown(df: DataFrame) -> DataFrame:
    return df.select("partition", "lsn", "timestamp_ms", "event_id")


SHOWN = "SELECT p AS partition, lsn, t AS timestamp_ms, event_id FROM r"


@query("append_assign_lsn", BASE + "SELECT p AS partition, event_id, lsn FROM r")
def _(spark, d):
    return records(spark, d).select("partition", "event_id", "lsn")


@query("record_size", BASE + "SELECT p AS partition, lsn, CAST(16 + 2 + 4 + 10 + strlen(event_type) + strlen(props) AS BIGINT) AS record_bytes FROM r")
def _(spark, d):
    return records(spark, d).select("partition", "lsn", ingest.record_size().alias("record_bytes"))


@query("roll_by_records", BASE + "SELECT p AS partition, seg AS segment_no, base AS base_lsn, last AS last_lsn, mn AS min_timestamp_ms, mx AS max_timestamp_ms, n AS record_count FROM s")
def _(spark, d):
    return segments(spark, d)


@query("roll_by_bytes", BASE.replace("WITH r", "WITH RECURSIVE r") + """, z AS (SELECT p, lsn, CAST(32 + strlen(event_type) + strlen(props) AS BIGINT) AS b FROM r),
f AS (SELECT p, lsn, 0::BIGINT AS seg, b AS used, 1::BIGINT AS c FROM z WHERE lsn = 0
 UNION ALL SELECT z.p, z.lsn, CASE WHEN f.used >= 4096 OR z.b > 4096 - f.used OR f.c >= 100 THEN f.seg + 1 ELSE f.seg END,
 CASE WHEN f.used >= 4096 OR z.b > 4096 - f.used OR f.c >= 100 THEN z.b ELSE f.used + z.b END,
 CASE WHEN f.used >= 4096 OR z.b > 4096 - f.used OR f.c >= 100 THEN 1 ELSE f.c + 1 END FROM f JOIN z ON z.p = f.p AND z.lsn = f.lsn + 1)
SELECT p AS partition, seg AS segment_no, min(lsn) AS base_lsn, max(lsn) AS last_lsn, CAST(sum(b) AS BIGINT) AS raw_bytes FROM f JOIN z USING (p, lsn) GROUP BY 1, 2""")
def _(spark, d):
    sized = records(spark, d).select("partition", "lsn", ingest.record_size().alias("record_bytes"))
    return ingest.roll_by_bytes(sized, 4096, 100).groupBy("partition", "segment_no").agg(
        F.min("lsn").alias("base_lsn"), F.max("lsn").alias("last_lsn"), F.sum("record_bytes").alias("raw_bytes"))


@query("block_stats", BASE + """SELECT p AS partition, lsn // 128 AS segment_no, (lsn % 128) // 16 AS block_no, count(*) AS record_count, min(lsn) AS base_lsn,
 min(t) AS min_timestamp_ms, max(t) AS max_timestamp_ms FROM r GROUP BY 1, 2, 3""")
def _(spark, d):
    return ingest.block_stats(records(spark, d), PER_BLOCK, PER_SEGMENT)


@query("partition_heads", BASE + "SELECT p AS partition, next_lsn, oldest_lsn, segs AS segment_count, last_ms AS last_timestamp_ms FROM h")
def _(spark, d):
    return catalog.heads(segments(spark, d))


@query("replay_range", BASE + SHOWN + " WHERE p = 7 AND lsn >= 100 ORDER BY lsn LIMIT 50")
def _(spark, d):
    return shown(replay.consume(records(spark, d), head(spark, d, 7), 100, 50))


@query("replay_after", BASE + SHOWN + " WHERE p = 3 AND lsn > 10 ORDER BY lsn LIMIT 20")
def _(spark, d):
    return shown(replay.consume_after(records(spark, d), head(spark, d, 3), 10, 20))


@query("replay_default_limit", BASE + SHOWN + " WHERE p = 2 ORDER BY lsn LIMIT 1024")
def _(spark, d):
    return shown(replay.consume(records(spark, d), head(spark, d, 2), 0))


@query("replay_clamped_limit", BASE + SHOWN + " WHERE p = 2 AND lsn >= 5 ORDER BY lsn LIMIT least(5000, 1024)")
def _(spark, d):
    return shown(replay.consume(records(spark, d), head(spark, d, 2), 5, 5000))


@query("replay_at_tail", BASE + SHOWN + " WHERE p = 1 AND lsn >= (SELECT next_lsn FROM h WHERE p = 1)")
def _(spark, d):
    tail = head(spark, d, 1)
    return shown(replay.consume(records(spark, d), tail, tail.next_lsn, 10))


@query("fetch_point", BASE + SHOWN + " WHERE p = 5 AND lsn = 42")
def _(spark, d):
    return shown(replay.fetch(records(spark, d), head(spark, d, 5), 42))


MIDDLE = "(SELECT CAST((min(t) + max(t)) // 2 AS BIGINT) FROM r)"


def middle(spark, d) -> int:
    ts = F.unix_millis(F.col("ts").cast("timestamp"))
    low, high = spark.read.parquet(f"{d}/events.parquet").agg(F.min(ts), F.max(ts)).first()
    return (low + high) // 2


@query("seek_timestamp", BASE + SHOWN + f" WHERE p = 4 AND t >= {MIDDLE} ORDER BY lsn LIMIT 30")
def _(spark, d):
    return shown(replay.consume_from_timestamp(records(spark, d), head(spark, d, 4), middle(spark, d), 30))


@query("seek_past_tail", BASE + """SELECT h.p AS partition, h.next_lsn, count(r.lsn) AS found FROM h LEFT JOIN r ON r.p = h.p AND r.t > h.last_ms GROUP BY 1, 2""")
def _(spark, d):
    heads = catalog.heads(segments(spark, d)).select("partition", "next_lsn", "last_timestamp_ms")
    late = records(spark, d).select("partition", "lsn", "timestamp_ms")
    return (heads.join(late, "partition", "left").groupBy("partition", "next_lsn")
            .agg(F.count(F.when(F.col("timestamp_ms") > F.col("last_timestamp_ms"), 1)).alias("found")))


@query("between_timestamps", BASE + SHOWN + f" WHERE p = 6 AND t BETWEEN {MIDDLE} AND {MIDDLE} + 86400000")
def _(spark, d):
    at = middle(spark, d)
    return shown(replay.between_timestamps(records(spark, d), head(spark, d, 6), at, at + 86_400_000))


SEG = "SELECT p AS partition, seg AS segment_no, base AS base_lsn, last AS last_lsn, mn AS min_timestamp_ms, mx AS max_timestamp_ms, n AS record_count"


@query("find_segment", BASE + SEG + " FROM s WHERE p = 0 AND base <= 77 AND last >= 77")
def _(spark, d):
    return catalog.find_segment(segments(spark, d), 0, 77)


@query("lookup_timestamp", BASE + SEG + f" FROM s WHERE p = 0 AND mx >= {MIDDLE} ORDER BY base LIMIT 1")
def _(spark, d):
    return catalog.lookup_timestamp(segments(spark, d), 0, middle(spark, d))


@query("list_segments_page", BASE + f""", a AS (SELECT *, row_number() OVER (ORDER BY base) AS i, lead(base) OVER (ORDER BY base) AS follow FROM s WHERE p = 1 AND last >= 50)
{SEG}, (SELECT follow FROM a WHERE i = 3) AS next_lsn, (SELECT follow FROM a WHERE i = 3) IS NOT NULL AS has_more FROM a WHERE i <= 3""")
def _(spark, d):
    return catalog.list_segments(segments(spark, d), 1, 50, 3)


PAGE = "min(base) AS seq_lo, max(last) AS seq_hi, min(mn) AS min_timestamp_ms, max(mx) AS max_timestamp_ms"


@query("leaf_pages", BASE + f"SELECT p AS partition, seg // 4 AS leaf_no, {PAGE}, count(*) AS entries FROM s GROUP BY 1, 2")
def _(spark, d):
    return catalog.leaf_pages(segments(spark, d), FANOUT)


@query("index_pages", BASE + f"SELECT p AS partition, seg // 16 AS index_no, {PAGE}, count(DISTINCT seg // 4) AS entries FROM s GROUP BY 1, 2")
def _(spark, d):
    return catalog.index_pages(catalog.leaf_pages(segments(spark, d), FANOUT), FANOUT)


@query("locate_records", BASE + "SELECT r.p AS partition, r.lsn, s.seg AS segment_no FROM r JOIN s ON r.p = s.p AND r.lsn BETWEEN s.base AND s.last")
def _(spark, d):
    return catalog.locate(records(spark, d).select("partition", "lsn"), segments(spark, d), 1024).select("partition", "lsn", "segment_no")


@query("audit_lsn_gaps", BASE + "SELECT * FROM (SELECT p AS partition, lsn, lag(lsn) OVER (PARTITION BY p ORDER BY lsn) AS previous_lsn FROM r WHERE lsn % 97 <> 13) WHERE lsn <> previous_lsn + 1")
def _(spark, d):
    return audit.lsn_gaps(records(spark, d).where(F.col("lsn") % 97 != 13))


@query("audit_ts_regression", BASE + """, b AS (SELECT p, lsn, CASE WHEN lsn % 50 = 49 THEN t - 864000000 ELSE t END AS t FROM r)
SELECT * FROM (SELECT p AS partition, lsn, t AS timestamp_ms, lag(t) OVER (PARTITION BY p ORDER BY lsn) AS previous_ms FROM b) WHERE timestamp_ms < previous_ms""")
def _(spark, d):
    bad = F.when(F.col("lsn") % 50 == 49, F.col("timestamp_ms") - 864_000_000).otherwise(F.col("timestamp_ms"))
    return audit.timestamp_regressions(records(spark, d).withColumn("timestamp_ms", bad))


@query("audit_segment_contiguity", BASE + """SELECT p AS partition, base AS base_lsn, last AS last_lsn, coalesce(base = lag(last) OVER w + 1, true) AS contiguous,
 coalesce(mn >= lag(mx) OVER w, true) AS ordered, n = last - base + 1 AS dense FROM s WHERE seg <> 1 WINDOW w AS (PARTITION BY p ORDER BY base)""")
def _(spark, d):
    return audit.segment_contiguity(segments(spark, d).where("segment_no <> 1"))


BLOCKS = ", b AS (SELECT p, lsn // 128 AS seg, (lsn % 128) // 16 AS blk, CAST(sum(32 + strlen(event_type) + strlen(props)) AS BIGINT) AS stored FROM r GROUP BY 1, 2, 3)"


@query("block_offsets", BASE + BLOCKS + """ SELECT p AS partition, seg AS segment_no, blk AS block_no, stored AS stored_size,
 CAST(64 + coalesce(sum(stored + 64) OVER (PARTITION BY p, seg ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_offset FROM b""")
def _(spark, d):
    blocks = (records(spark, d).withColumn("segment_no", F.floor(F.col("lsn") / PER_SEGMENT)).withColumn("block_no", F.floor(F.col("lsn") % PER_SEGMENT / PER_BLOCK))
              .groupBy("partition", "segment_no", "block_no").agg(F.sum(ingest.record_size()).alias("stored_size")))
    return audit.block_offsets(blocks)


@query("audit_reference_mismatches", BASE + "SELECT p * 1000000 + seg AS segment_id FROM s WHERE seg % 5 = 2")
def _(spark, d):
    refs = segments(spark, d).withColumn("segment_id", F.col("partition") * 1_000_000 + F.col("segment_no"))
    trailers = refs.withColumn("last_lsn", F.when(F.col("segment_no") % 5 == 2, F.col("last_lsn") + 1).otherwise(F.col("last_lsn")))
    return audit.reference_mismatches(refs, trailers, "segment_id")


def requests(spark, d) -> DataFrame:
    return catalog.heads(segments(spark, d)).select("partition", (F.col("next_lsn") * F.col("partition") / 7).cast("long").alias("before_lsn"))


FLOORS = """, q AS (SELECT p, next_lsn, CAST(trunc(next_lsn * p / 7) AS BIGINT) AS before_lsn FROM h), g AS (SELECT q.p, least(before_lsn, next_lsn) AS target,
 coalesce((SELECT min(base) FROM s WHERE s.p = q.p AND s.last >= least(q.before_lsn, q.next_lsn)), next_lsn) AS oldest_lsn, next_lsn FROM q)"""


@query("retention_effective_floor", BASE + FLOORS + " SELECT p AS partition, target, oldest_lsn, next_lsn FROM g")
def _(spark, d):
    return retention.effective_floor(segments(spark, d), requests(spark, d))


@query("retention_trim", BASE + FLOORS + " " + SEG + " FROM s JOIN g USING (p) WHERE base >= oldest_lsn")
def _(spark, d):
    segs = segments(spark, d)
    return retention.trim(segs, retention.effective_floor(segs, requests(spark, d)))


@query("retention_latest_request", BASE + "SELECT p AS partition, max(n % 60 + seg) AS policy_version, arg_max(base, n % 60 + seg) AS before_lsn FROM s GROUP BY 1")
def _(spark, d):
    log = segments(spark, d).select("partition", (F.col("record_count") % 60 + F.col("segment_no")).alias("policy_version"), F.col("base_lsn").alias("before_lsn"))
    return retention.latest_requests(log)


@query("retention_safe_floor", BASE + FLOORS + """ SELECT p AS partition, CASE WHEN p % 2 = 0 THEN oldest_lsn // 2 ELSE 0 END AS safe_floor,
 CASE WHEN p % 2 = 1 THEN oldest_lsn // 2 WHEN oldest_lsn > oldest_lsn // 2 THEN oldest_lsn END AS pending_floor,
 CASE WHEN p % 2 = 1 THEN 95000000 WHEN oldest_lsn > oldest_lsn // 2 THEN 100000000 END AS pending_since_ms FROM g""")
def _(spark, d):
    floors = retention.effective_floor(segments(spark, d), requests(spark, d))
    half = F.floor(F.col("oldest_lsn") / 2).cast("long")
    since = F.when(F.col("partition") % 2 == 0, 5_000_000).otherwise(95_000_000).cast("long")
    states = floors.select("partition", F.lit(0).cast("long").alias("safe_floor"), half.alias("pending_floor"), since.alias("pending_since_ms"))
    out = retention.safe_floors(states, floors, 100_000_000, 86_400_000)
    return out.withColumn("pending_since_ms", F.col("pending_since_ms").cast("int"))


@query("expired_reads", BASE + FLOORS + """, x AS (SELECT p, oldest_lsn, next_lsn, unnest([oldest_lsn - 1, oldest_lsn, next_lsn - 1, next_lsn, next_lsn + 9]) AS lsn FROM g)
SELECT p AS partition, lsn, CASE WHEN lsn < oldest_lsn THEN 'expired' WHEN lsn >= next_lsn THEN 'past_tail' ELSE 'found' END AS outcome FROM x""")
def _(spark, d):
    floors = retention.effective_floor(segments(spark, d), requests(spark, d))
    probes = floors.withColumn("lsn", F.explode(F.array(*[F.expr(e) for e in ("oldest_lsn - 1", "oldest_lsn", "next_lsn - 1", "next_lsn", "next_lsn + 9")])))
    outcome = F.when(F.col("lsn") < F.col("oldest_lsn"), "expired").when(F.col("lsn") >= F.col("next_lsn"), "past_tail").otherwise("found")
    return probes.select("partition", "lsn", outcome.alias("outcome"))


def objects(spark, d) -> DataFrame:
    """Physical segments: every 11th by an older writer, every 7th unknown to the catalog."""
    s = segments(spark, d)
    uuid = F.md5(F.concat_ws(":", "partition", "segment_no"))
    epoch = F.when(F.col("segment_no") % 11 == 3, F.lit(1)).otherwise(F.lit(2)).cast("long")
    return s.select(
        "partition", "segment_no", "base_lsn", epoch.alias("writer_epoch"), (F.col("record_count") * 100).alias("size_bytes"),
        F.col("max_timestamp_ms").alias("created_ms"), keys.segment_name(F.col("base_lsn"), epoch, uuid).alias("name"),
        F.concat_ws("/", F.col("partition"), keys.segment_name(F.col("base_lsn"), epoch, uuid)).alias("key"))


OBJECTS = """, o AS (SELECT p, seg, base, CASE WHEN seg % 11 = 3 THEN 1 ELSE 2 END::BIGINT AS epoch, n * 100 AS size, mx AS created,
 'seg-' || lpad(base::VARCHAR, 20, '0') || '-e' || lpad((CASE WHEN seg % 11 = 3 THEN 1 ELSE 2 END)::VARCHAR, 20, '0') || '-' || md5(p::VARCHAR || ':' || seg::VARCHAR) || '.plseg' AS name FROM s)"""


def guarded_heads(spark, d) -> DataFrame:
    segs = segments(spark, d)
    floors = retention.effective_floor(segs, requests(spark, d))
    return floors.select("partition", "next_lsn", "oldest_lsn", F.lit(2).cast("long").alias("head_epoch"), F.floor(F.col("oldest_lsn") / 2).cast("long").alias("safe_floor"))


@query("gc_reclaimable", BASE + FLOORS + OBJECTS + " SELECT o.p AS partition, base AS base_lsn, name FROM o JOIN g USING (p) WHERE base < oldest_lsn // 2")
def _(spark, d):
    return gc.reclaimable_segments(objects(spark, d), guarded_heads(spark, d)).select("partition", "base_lsn", "name")


@query("gc_budgeted", BASE + FLOORS + OBJECTS + """, c AS (SELECT o.p, base, size, sum(size) OVER w AS upto, row_number() OVER w AS i FROM o JOIN g USING (p) WHERE base < oldest_lsn
 WINDOW w AS (PARTITION BY o.p ORDER BY base)) SELECT p AS partition, base AS base_lsn, size AS size_bytes FROM c WHERE i <= 4 AND (i = 1 OR upto <= 40000)""")
def _(spark, d):
    floors = guarded_heads(spark, d).withColumn("safe_floor", F.col("oldest_lsn"))
    return gc.budgeted(gc.reclaimable_segments(objects(spark, d), floors), 4, 40_000).select("partition", "base_lsn", "size_bytes")


ORPHAN = "NOT (base < oldest_lsn AND base >= oldest_lsn // 2) AND epoch <= 2 AND (base < next_lsn OR epoch < 2)"


@query("scrub_orphan_segments", BASE + FLOORS + OBJECTS + f""" SELECT o.p AS partition, base AS base_lsn, epoch AS writer_epoch, name FROM o JOIN g USING (p)
 WHERE NOT EXISTS (SELECT 1 FROM o c WHERE c.p = o.p AND c.name = o.name AND c.seg % 7 <> 5) AND {ORPHAN} AND {MIDDLE} + 864000000 - created >= 3600000""")
def _(spark, d):
    found = objects(spark, d)
    loose = gc.orphan_segments(found, found.where("segment_no % 7 <> 5"), guarded_heads(spark, d), middle(spark, d) + 864_000_000, HOUR_MS)
    return loose.select("partition", "base_lsn", "writer_epoch", "name")


@query("scrub_referenced_segments", BASE + OBJECTS + " SELECT p AS partition, base AS base_lsn FROM o WHERE EXISTS (SELECT 1 FROM o c WHERE c.p = o.p AND c.name = o.name AND c.seg % 7 <> 5)")
def _(spark, d):
    found = objects(spark, d)
    return found.join(found.where("segment_no % 7 <> 5").select("key"), "key", "left_semi").select("partition", "base_lsn")


@query("scrub_orphan_pages", BASE + """, l AS (SELECT p, seg // 4 AS leaf, min(base) AS lo, max(last) AS hi FROM s GROUP BY 1, 2)
SELECT p AS partition, lo AS seq_lo, hi AS seq_hi FROM l WHERE leaf % 3 = 1 AND leaf < 7""")
def _(spark, d):
    pages = catalog.leaf_pages(segments(spark, d), FANOUT).select(
        "partition", "seq_lo", "seq_hi", F.col("leaf_no").alias("generation"), F.concat_ws("/", "partition", keys.padded(F.col("seq_hi"))).alias("key"), "leaf_no")
    heads = pages.select("partition").distinct().withColumn("generation", F.lit(7).cast("long"))
    return gc.orphan_pages(pages, pages.where("leaf_no % 3 <> 1"), heads).select("partition", "seq_lo", "seq_hi")


@query("gc_reclaimable_pages", BASE + FLOORS + ", l AS (SELECT p, seg // 4 AS leaf, min(base) AS lo, max(last) AS hi FROM s GROUP BY 1, 2) SELECT l.p AS partition, lo AS seq_lo, hi AS seq_hi FROM l JOIN g USING (p) WHERE hi < oldest_lsn // 2")
def _(spark, d):
    return gc.reclaimable_pages(catalog.leaf_pages(segments(spark, d), FANOUT), guarded_heads(spark, d)).select("partition", "seq_lo", "seq_hi")


@query("staging_stale", BASE + OBJECTS + f" SELECT p AS partition, base AS base_lsn FROM o WHERE epoch < 2 AND {MIDDLE} - created >= 3600000")
def _(spark, d):
    found = objects(spark, d)
    heads = found.select("partition").distinct().withColumn("writer_epoch", F.lit(2).cast("long"))
    return gc.stale_staging(found, heads, middle(spark, d), HOUR_MS).select("partition", "base_lsn")


@query("gc_run_summary", BASE + OBJECTS + """ SELECT p AS partition, count(*) AS scanned, count(*) FILTER (WHERE epoch < 2) AS candidates,
 CAST(coalesce(sum(size) FILTER (WHERE epoch < 2), 0) AS BIGINT) AS candidate_bytes FROM o GROUP BY 1""")
def _(spark, d):
    found = objects(spark, d)
    return gc.run_summary(found, found.where("writer_epoch < 2"))


@query("cursor_resume_validate", BASE + FLOORS + """, x AS (SELECT p, oldest_lsn, next_lsn, unnest([1, 2, 3, 4, 5]) AS k FROM g),
y AS (SELECT *, CASE WHEN k = 1 THEN oldest_lsn - 1 WHEN k = 2 THEN next_lsn + 1 ELSE next_lsn END AS position, CASE WHEN k = 3 THEN 2 ELSE 1 END AS version,
 CASE WHEN k = 4 THEN 'other' ELSE 'events' END AS stream FROM x)
SELECT p AS partition, k AS probe, position, CASE WHEN version <> 1 THEN 'invalid' WHEN stream <> 'events' THEN 'mismatch' WHEN position < oldest_lsn THEN 'expired' WHEN position > next_lsn THEN 'ahead' ELSE 'ok' END AS status FROM y""")
def _(spark, d):
    floors = retention.effective_floor(segments(spark, d), requests(spark, d))
    k = F.col("probe")
    tokens = floors.withColumn("probe", F.explode(F.array(*map(F.lit, range(1, 6))))).select(
        "partition", "probe", F.when(k == 1, F.col("oldest_lsn") - 1).when(k == 2, F.col("next_lsn") + 1).otherwise(F.col("next_lsn")).alias("position"),
        F.when(k == 3, 2).otherwise(1).alias("version"), F.when(k == 4, "other").otherwise("events").alias("token_stream"))
    return replay.classify_checkpoints(tokens, floors, "events").select("partition", "probe", "position", "status")


@query("conversation_replay", "SELECT conv_id, turn AS lsn, role, text FROM conversations WHERE turn >= 2")
def _(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").where("turn >= 2").select("conv_id", F.col("turn").alias("lsn"), "role", "text")


@query("conversation_heads", "SELECT conv_id, max(turn) + 1 AS next_lsn, min(turn) AS oldest_lsn, count(*) AS record_count FROM conversations GROUP BY 1")
def _(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(
        (F.max("turn") + 1).alias("next_lsn"), F.min("turn").alias("oldest_lsn"), F.count(F.lit(1)).alias("record_count"))


@query("stream_key", "SELECT DISTINCT conv_id, sha256('agents/' || conv_id::VARCHAR) AS stream_key FROM conversations")
def _(spark, d):
    conv = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id").distinct()
    return conv.select("conv_id", keys.stream_key(F.concat(F.lit("/agents/"), F.col("conv_id"), F.lit("/"))).alias("stream_key"))


@query("key_layout_parse", BASE + OBJECTS + " SELECT p AS partition, CAST(base AS DECIMAL(20,0)) AS base_lsn, CAST(epoch AS DECIMAL(20,0)) AS writer_epoch, md5(p::VARCHAR || ':' || seg::VARCHAR) AS uuid FROM o")
def _(spark, d):
    found = objects(spark, d)
    return found.select("partition", *[c.alias(n) for n, c in keys.parsed_segment(F.col("key")).items()])


@query("projection_event_counts", "SELECT event_type, user_id % 8 AS partition, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    typed = records(spark, d).select("partition", projection.header("event_type").alias("event_type"))
    return typed.groupBy("event_type", "partition").agg(F.count(F.lit(1)).alias("n"))


@query("projection_latest_state", BASE + "SELECT user_id, arg_max(event_type, struct_pack(t := t, p := p, l := lsn)) AS event_type, max(lsn) AS lsn FROM r GROUP BY 1")
def _(spark, d):
    return projection.latest_state(records(spark, d), "user_id", ["event_type", "lsn"])


@query("order_timelines", """SELECT o_custkey % 8 AS partition, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 8 ORDER BY epoch_ms(o_orderdate), o_orderkey) - 1 AS lsn FROM orders""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(
        (F.col("o_custkey") % 8).alias("partition"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("timestamp_ms"), "o_orderkey")
    return ingest.assign_lsn(rows, ["o_orderkey"], chunk_ms=30 * 86_400_000).select("partition", "o_orderkey", "lsn")


@query("lineitem_segment_rollup", """WITH r AS (SELECT l_suppkey % 16 AS p, epoch_ms(l_shipdate) AS t, row_number() OVER (PARTITION BY l_suppkey % 16 ORDER BY epoch_ms(l_shipdate), l_orderkey, l_linenumber) - 1 AS lsn FROM lineitem)
SELECT p AS partition, lsn // 1024 AS segment_no, min(lsn) AS base_lsn, max(lsn) AS last_lsn, min(t) AS min_timestamp_ms, max(t) AS max_timestamp_ms, count(*) AS record_count FROM r GROUP BY 1, 2""")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(
        (F.col("l_suppkey") % 16).alias("partition"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("timestamp_ms"), "l_orderkey", "l_linenumber")
    numbered = ingest.assign_lsn(rows, ["l_orderkey", "l_linenumber"], chunk_ms=90 * 86_400_000)
    return catalog.segments(ingest.roll_by_records(numbered, 1024))


# Queries through the ``timeline`` source: the records are written as segments and pages once, and read back.

def timelines(spark: SparkSession, d: str) -> "Timelines":
    """The timeline of ``events`` as a store in the shared folder; written when first asked for."""
    from .timelines import Timelines

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        base = _FOLDERS.setdefault("own", tempfile.mkdtemp(prefix="tidemark-"))
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    key = f"{spark.sparkContext.applicationId}-{hashlib.md5(d.encode()).hexdigest()[:8]}"
    root = os.path.join(base.removeprefix("file://").removeprefix("file:"), f"timeline-{key}")
    log = Timelines(spark, root, "events", leaf_limit=FANOUT, index_limit=FANOUT)
    if root not in _FOLDERS:
        shutil.rmtree(root, ignore_errors=True)
        rows = records(spark, d).select("partition", "timestamp_ms", "event_id", "headers", "value")
        log.append(rows, ["event_id"], max_records=PER_SEGMENT)
        _FOLDERS[root] = root
    return log


_FOLDERS: dict[str, str] = {}
READ = "SELECT p AS partition, lsn, t AS timestamp_ms, event_type, props FROM r"


def read_back(df: DataFrame) -> DataFrame:
    return df.select("partition", "lsn", "timestamp_ms", projection.header("event_type").alias("event_type"), F.decode("value", "UTF-8").alias("props"))


@query("source_records", BASE + READ)
def _(spark, d):
    return read_back(timelines(spark, d).records())


@query("source_verified", BASE + READ + " WHERE p IN (2, 5)")
def _(spark, d):
    return read_back(timelines(spark, d).records(verify="true").where("partition IN (2, 5)"))


@query("source_replay_range", BASE + READ + " WHERE p = 7 AND lsn >= 100 ORDER BY lsn LIMIT 50")
def _(spark, d):
    return read_back(timelines(spark, d).partition(7).consume(100, 50))


@query("source_after", BASE + READ + " WHERE p = 3 AND lsn > 10 ORDER BY lsn LIMIT 20")
def _(spark, d):
    return read_back(timelines(spark, d).partition(3).consume_after(10, 20))


@query("source_fetch", BASE + READ + " WHERE p = 5 AND lsn = 42")
def _(spark, d):
    return read_back(timelines(spark, d).partition(5).fetch(42))


@query("source_seek", BASE + READ + f" WHERE p = 4 AND t >= {MIDDLE} ORDER BY lsn LIMIT 30")
def _(spark, d):
    return read_back(timelines(spark, d).partition(4).consume_from_timestamp(middle(spark, d), 30))


@query("source_at_tail", BASE + READ + " WHERE false")
def _(spark, d):
    one = timelines(spark, d).partition(1)
    return read_back(one.consume(one.head().next_lsn))


@query("source_between", BASE + READ + f" WHERE t BETWEEN {MIDDLE} AND {MIDDLE} + 86400000")
def _(spark, d):
    at = middle(spark, d)
    return read_back(timelines(spark, d).records().where(f"timestamp_ms >= {at} AND timestamp_ms <= {at + 86_400_000}"))


@query("source_segments", BASE + "SELECT p AS partition, base AS base_lsn, last AS last_lsn, mn AS min_timestamp_ms, mx AS max_timestamp_ms, n AS record_count FROM s")
def _(spark, d):
    return timelines(spark, d).segments().select("partition", "base_lsn", "last_lsn", "min_timestamp_ms", "max_timestamp_ms", "record_count")


@query("source_heads", BASE + "SELECT p AS partition, next_lsn, oldest_lsn, segs AS segment_count, last_ms AS last_timestamp_ms FROM h")
def _(spark, d):
    return timelines(spark, d).heads().drop("writer_epoch")


@query("source_pages", BASE + """, l AS (SELECT p, seg, base, last, mn, mx, max(seg) OVER (PARTITION BY p) + 1 AS n FROM s),
q AS (SELECT p, k AS level, seg // CAST(4 ** (k + 1) AS BIGINT) AS no, min(base) AS lo, max(last) AS hi, min(mn) AS mn, max(mx) AS mx, count(*) AS c FROM l, range(0, 12) t(k) GROUP BY 1, 2, 3)
SELECT p AS partition, CAST(level AS INTEGER) AS level, lo AS seq_lo, hi AS seq_hi, mn AS min_timestamp_ms, mx AS max_timestamp_ms, 4::BIGINT AS entries FROM q WHERE c = CAST(4 ** (level + 1) AS BIGINT)""")
def _(spark, d):
    return timelines(spark, d).pages().drop("key", "generation")


@query("source_find_segment", BASE + "SELECT p AS partition, base AS base_lsn, last AS last_lsn FROM s WHERE base <= 77 AND last >= 77")
def _(spark, d):
    log = timelines(spark, d)
    found = [(p, log.store.find_segment(log.store.load(p), 77)) for p in log.store.partitions()]
    return spark.createDataFrame([(p, r.base_lsn, r.last_lsn) for p, r in found if r], "partition long, base_lsn long, last_lsn long")


@query("source_lookup_timestamp", BASE + f"SELECT p AS partition, min(base) AS base_lsn FROM s WHERE mx >= {MIDDLE} GROUP BY 1")
def _(spark, d):
    log, at = timelines(spark, d), middle(spark, d)
    found = [(p, log.store.lookup_timestamp(log.store.load(p), at)) for p in log.store.partitions()]
    return spark.createDataFrame([(p, r.base_lsn) for p, r in found if r], "partition long, base_lsn long")


@query("checksum_crc32c", BASE.replace("WITH r", """WITH RECURSIVE g AS (SELECT i, i AS c, 0 AS k FROM range(0, 256) t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 2197175160) ELSE c // 2 END, k + 1 FROM g WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS v FROM g WHERE k = 8), r""") + """SELECT p AS partition, lsn, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(event_type, ''), lambda x: ord(x)::BIGINT)),
 lambda a, b: xor(a // 256, v[xor(a % 256, b) + 1])), 4294967295) AS crc32c FROM r, tab""")
def _(spark, d):
    typed = records(spark, d).select("partition", "lsn", F.encode(projection.header("event_type"), "UTF-8").alias("data"))
    return typed.select("partition", "lsn", hashing.crc32c_col("data").alias("crc32c"))


@query("duplicate_identity", BASE + "SELECT p AS partition, seg % 3 AS identity, count(*) AS copies FROM s GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return catalog.duplicate_identities(segments(spark, d).withColumn("identity", F.col("segment_no") % 3), "identity")


@query("roots_and_active", BASE + """, l AS (SELECT p, seg // 4 AS leaf, min(base) AS lo, max(last) AS hi, count(*) AS c FROM s GROUP BY 1, 2)
SELECT p AS partition, 'page' AS kind, lo AS seq_lo, hi AS seq_hi FROM l WHERE c = 4 UNION ALL SELECT s.p, 'segment', base, last FROM s JOIN l ON l.p = s.p AND l.leaf = s.seg // 4 WHERE c < 4""")
def _(spark, d):
    return catalog.roots_and_active(segments(spark, d), FANOUT)


@query("list_first_keys", BASE + OBJECTS + " SELECT p::VARCHAR || '/' || name AS key FROM o WHERE p::VARCHAR || '/' || name > '3/' ORDER BY 1 LIMIT 25")
def _(spark, d):
    return gc.first_keys(objects(spark, d), "3/", 25).select("key")


@query("gc_checkpoint_keys", BASE + OBJECTS + " SELECT p AS partition, name, lag(name, 1, '') OVER (PARTITION BY p ORDER BY name) AS before_key FROM o WHERE epoch = 2")
def _(spark, d):
    return gc.delete_checkpoints(objects(spark, d).where("writer_epoch = 2"), "name").select("partition", "name", "before_key")


@query("gc_quarantine_confirmed", BASE + """, l AS (SELECT p, seg // 4 AS leaf, min(base) AS lo, max(last) AS hi FROM s GROUP BY 1, 2)
SELECT p AS partition, lo AS seq_lo FROM l WHERE leaf % 3 = 1 AND leaf % 2 = 0 AND 100 - leaf >= 40""")
def _(spark, d):
    pages = catalog.leaf_pages(segments(spark, d), FANOUT).withColumn("key", F.concat_ws("/", "partition", "leaf_no"))
    held = pages.where("leaf_no % 3 = 1").withColumn("since_ms", F.col("leaf_no"))
    return gc.confirm_quarantine(held, pages.where("leaf_no % 2 = 0"), 100, 40).select("partition", "seq_lo")


@query("ready_queue", BASE + "SELECT p AS partition, seg AS segment_no FROM s ORDER BY mx, p, seg LIMIT 10")
def _(spark, d):
    return gc.ready_first(segments(spark, d), "max_timestamp_ms", ["partition", "segment_no"], 10).select("partition", "segment_no")


@query("inflight_estimate", BASE + """SELECT p AS partition, seg AS segment_no, CAST(64 + 64 + 192 + sum(32 + strlen(event_type) + strlen(props)) + (sum(32 + strlen(event_type) + strlen(props)) + 3) // 4 + 128 * count(*) AS DECIMAL(20,0)) AS bytes
 FROM (SELECT *, lsn // 128 AS seg FROM r) GROUP BY 1, 2""")
def _(spark, d):
    sized = records(spark, d).select("partition", F.floor(F.col("lsn") / PER_SEGMENT).alias("segment_no"), ingest.record_size().alias("b"))
    return (sized.groupBy("partition", "segment_no").agg(F.sum("b").alias("raw"), F.count(F.lit(1)).alias("n"))
            .select("partition", "segment_no", ingest.inflight_bytes(F.col("raw"), F.col("n")).alias("bytes")))


@query("saturating_arithmetic", BASE + """SELECT p AS partition, least(CAST(18446744073709551610 + next_lsn AS HUGEINT), 18446744073709551615)::DECIMAL(20,0) AS added,
 least(CAST(next_lsn AS HUGEINT) * 1000000000000000000, 18446744073709551615)::DECIMAL(20,0) AS multiplied FROM h""")
def _(spark, d):
    n = F.col("next_lsn")
    return catalog.heads(segments(spark, d)).select(
        "partition", numbers.saturating_add(F.lit("18446744073709551610"), n).alias("added"), numbers.saturating_mul(n, F.lit("1000000000000000000")).alias("multiplied"))


@query("encoded_payloads", BASE + "SELECT p AS partition, lsn, base64(encode(props)) AS base64, hex(encode(props)) AS hex FROM r WHERE lsn < 50")
def _(spark, d):
    return records(spark, d).where("lsn < 50").select("partition", "lsn", F.base64("value").alias("base64"), F.hex("value").alias("hex"))


@query("big_endian_fields", BASE + "SELECT p AS partition, lsn, CAST(16777216::BIGINT * ord(props[1]) + 65536 * ord(props[2]) + 256 * ord(props[3]) + ord(props[4]) AS DECIMAL(20,0)) AS field FROM r WHERE strlen(props) >= 4")
def _(spark, d):
    return records(spark, d).where(F.octet_length("value") >= 4).select("partition", "lsn", numbers.big_endian(F.col("value"), 0, 4).alias("field"))


@query("blocks_by_bytes", ORACLES["roll_by_bytes"].replace("4096", "1024").replace("f.c >= 100", "f.c >= 1000000").replace("AS segment_no", "AS block_no"))
def _(spark, d):
    sized = records(spark, d).select("partition", "lsn", ingest.record_size().alias("record_bytes"))
    return ingest.roll_by_bytes(sized, 1024, out="block_no").groupBy("partition", "block_no").agg(
        F.min("lsn").alias("base_lsn"), F.max("lsn").alias("last_lsn"), F.sum("record_bytes").alias("raw_bytes"))

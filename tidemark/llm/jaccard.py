"""Exact n-gram Jaccard self-join by universe partitioning and the pigeonhole principle.

A document is the set of its distinct 5-word shingles, as 64-bit hashes. Two sets of Jaccard
similarity 0.8 or more have sizes within a factor 1.25 and differ in at most
H = floor((|r| + |s|) / 9) elements. Sizes fall into bands whose bounds grow by 1.25, so links
join equal or adjacent bands, and scheme b serves bands b and b + 1.

* Universe partition: in scheme b the hash range is cut into m(b) equal segments; a set's
  segment subset is hashed into a key. A segment that tolerates e differences is worth e + 1
  units. Large bands use segments with e = 0; small ones use fewer and larger segments with
  e = 1, for which the subset's one-deletion neighbourhood is indexed as well.
* Pigeonhole: if segments worth H + 1 units are looked at, a linked set shares a key in one of
  them. Empty segments are worth nothing, so the shared key is never that of nothing.
* Cost-based allocation: a document may leave out its most expensive segments as long as H + 1
  units remain. Keys that nobody else has cost nothing, so a document with H + 1 such units
  provably has no link and goes no further. Keys of the rest are looked up cheapest first, and a
  key all of whose owners are known to be connected is as good as unshared.
* A document with too few units for its H (many empty segments) also owns one key that all such
  documents of the scheme share; a pair can only be missed if both are of this kind.

Keys travel in packed blobs of 48 bits each; a collision costs a comparison, never a result.
Candidates are verified on the full sets. Equal sets collapse first, then stars on the smallest
owner of a key connect large groups with one comparison a member; what stays unresolved is
compared with every other owner of its keys, by parity bitmaps first: their Hamming distance is
at most the number of elements in which two sets differ, so they rule out pairs but no link.

Defined cases: null texts and texts without words have an empty set and link with nothing; a
text of fewer words than a shingle has one element; rows of one doc_id are one document whose
links pool; rows with a null doc_id link with nothing; an empty table gives an empty result.
"""

import bisect
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, gram_hashes, materialise, mix, partitions_for, slices, word_hashes

WORDS = 5
SMALL = 128
PARTS = 64
STAR_ROUNDS = 1
MAP_BITS = 2048
BLOCK = 2048
SLICE = 4 << 20


def _bounds() -> list[int]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 5 // 4)))
    return out


BOUNDS = _bounds()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = word_hashes(found)
    if not len(h):
        return h
    if len(h) < words:
        return gram_hashes(h, len(h)) ^ np.uint64(len(h))
    return np.unique(gram_hashes(h, words))


def scheme(b: int) -> tuple[int, bool]:
    """Number of segments of scheme b and whether they tolerate one difference."""
    most = (BOUNDS[b + 1] - 1) // 4
    if BOUNDS[b + 1] <= SMALL:
        return -(-(most + 1) // 2) + 2, True
    return int((1.3 if BOUNDS[b + 1] <= 512 else 1.2) * (most + 1)) + 1, False


def roles(n: int) -> list[tuple[int, int]]:
    """The schemes a set of n elements is in, with its largest possible difference H in each."""
    b = bisect.bisect_right(BOUNDS, n) - 1
    out = []
    low = (n + min(n * 5 // 4, BOUNDS[b + 2] - 1)) // 9
    if low:
        out.append((b, low))
    if b and (BOUNDS[b] - 1) * 5 >= n * 4:
        high = (n + BOUNDS[b] - 1) // 9
        if high:
            out.append((b - 1, high))
    return out


def keys(tokens: np.ndarray, b: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of a set in scheme b, the segment of each (-1: worth one unit by itself), and how
    many units may be left out; negative if there are too few."""
    m, tolerant = scheme(b)
    segment = ((tokens >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    values, own = mix(tokens), segment[first]
    sums = np.add.reduceat(values, first)
    salt = mix((np.uint64(b) << np.uint64(40)) + own.astype(np.uint64) + np.uint64(1))
    out, where = mix(sums ^ salt), np.full(len(own), -1)
    if tolerant:
        size = np.diff(np.r_[first, len(tokens)])
        which = np.repeat(np.arange(len(own)), size)
        many = size[which] > 1
        out = np.r_[out, mix((sums[which] - values)[many] ^ salt[which][many])]
        where = np.r_[own, own[which][many]]
        spare = int(np.minimum(size, 2).sum()) - most - 1
    else:
        spare = len(own) - most - 1
    if spare < 0:
        out = np.r_[out, mix(np.array([(b << 40) + 0xFFFFFFFF], np.uint64))]
        where = np.r_[where, -1]
    return out, where, spare


DIRTY = "kind int, doc_id long, n long, h1 long, h2 long, spare0 int, spare1 int, role int, seg int, units int"


def _pack(keys48: np.ndarray) -> bytes:
    return keys48.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _squeeze(values: np.ndarray) -> bytes:
    """32-bit numbers, compressed by byte planes."""
    return zlib.compress(np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unsqueeze(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


BLOBS = "part int, docs binary, known binary, keys binary, ids binary, tags binary"
NONE = -(2**63)


def _summaries(docs: DataFrame, parts: int) -> DataFrame:
    """One pass over the texts: a summary of every document (kind 0), and the number of units
    that it shares with any other document (kind 1), by scheme and segment.

    A worker takes ``SLICE`` bytes of texts at a time. Keys go to the part of their value,
    summaries to the parts in turn.
    """

    def emit(batches):
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(slices(batches, SLICE)):
            ids, ks, rs, ss, meta = [], [], [], [], []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = shingles(text)
                spares = [NONE, NONE]
                if len(tokens) and doc_id is not None:
                    for role, (b, most) in enumerate(roles(len(tokens))):
                        k, s, spares[role] = keys(tokens, b, most)
                        ids.append(np.full(len(k), doc_id, np.int64))
                        ks.append(k)
                        rs.append(np.full(len(k), role, np.uint8))
                        ss.append(s.astype(np.int32))
                values = mix(tokens)
                sums = [int(v.sum(dtype=np.uint64).astype(np.int64)) if len(v) else 0 for v in (values, mix(values ^ np.uint64(0xABCDEF)))]
                meta.append((doc_id is not None, doc_id or 0, len(tokens), *sums, *spares))
            out = [{"part": (task * 31 + number) % parts, "docs": np.array(meta, "<i8").tobytes()}]
            if ks:
                ids, k, r, s = (np.concatenate(x) for x in (ids, ks, rs, ss))
                # of a key that several documents of this slice have, one goes on and all are known to share it
                order = np.argsort(k, kind="stable")
                same = np.r_[False, k[order][1:] == k[order][:-1]]
                shared = np.zeros(len(k), bool)
                shared[order[same]] = True
                shared[order[np.r_[same[1:], False]]] = True
                later = np.zeros(len(k), bool)
                later[order[same]] = True
                if shared.any():
                    known = pd.DataFrame({"doc_id": ids[shared], "role": r[shared], "seg": s[shared]}).value_counts(sort=False).reset_index(name="units")
                    out[0]["known"] = known.to_numpy("<i8").tobytes()
                ids, k, r, s = ids[~later], k[~later], r[~later], s[~later]
                part = (k % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[order], np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(bounds)).tolist():
                    rows = order[bounds[p] : bounds[p + 1]]
                    own, start = ids[rows], np.flatnonzero(np.r_[True, ids[rows][1:] != ids[rows][:-1]])
                    owners = np.stack([own[start], np.diff(np.r_[start, len(rows)])]).astype("<i8").tobytes()
                    tags = r[rows].astype(np.int32) << 24 | (s[rows] + 1)
                    out.append({"part": p, "keys": _pack(k[rows] >> np.uint64(16)), "ids": owners, "tags": _squeeze(tags)})
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    shape = pa.schema([("part", pa.int32())] + [(c, pa.binary()) for c in ("docs", "known", "keys", "ids", "tags")])
    names = [c.split()[0] for c in DIRTY.split(", ")]

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        out, ks, ids, tags = [], [], [], []
        for _, about, known, blob, owners, small in pdf.itertuples(index=False):
            if about is not None:
                meta = np.frombuffer(about, "<i8").reshape(-1, 7)
                frame = pd.DataFrame(meta[:, 1:], columns=["doc_id", "n", "h1", "h2", "spare0", "spare1"]).astype("Int64")
                frame.loc[meta[:, 0] == 0, "doc_id"] = pd.NA
                for i, c in ((5, "spare0"), (6, "spare1")):
                    frame.loc[meta[:, i] == NONE, c] = pd.NA
                out.append(frame.assign(kind=0))
            if known is not None:
                out.append(pd.DataFrame(np.frombuffer(known, "<i8").reshape(-1, 4), columns=["doc_id", "role", "seg", "units"]).assign(kind=1))
            if blob is not None:
                own, runs = np.frombuffer(owners, "<i8").reshape(2, -1)
                ks.append(_unpack(blob))
                ids.append(np.repeat(own, runs))
                tags.append(_unsqueeze(small))
        if ks:
            k, ids, tags = (np.concatenate(x) for x in (ks, ids, tags))
            order = np.argsort(k, kind="stable")
            same = np.r_[False, k[order][1:] == k[order][:-1]]
            hit = order[same | np.r_[same[1:], False]]
            if len(hit):
                found = pd.DataFrame({"doc_id": ids[hit], "tag": tags[hit]}).value_counts(sort=False).reset_index(name="units")
                tag = found["tag"].to_numpy()
                out.append(pd.DataFrame({"kind": 1, "doc_id": found["doc_id"], "role": tag >> 24, "seg": (tag & 0xFFFFFF) - 1, "units": found["units"]}))
        frame = pd.concat([o.reindex(columns=names) for o in out]) if out else pd.DataFrame(columns=names)
        return frame.astype({c: "Int64" for c in names}).astype({c: "Int32" for c in ("kind", "spare0", "spare1", "role", "seg", "units")})

    blobs = docs.select("doc_id", "text").mapInArrow(emit, BLOBS)
    return materialise(blobs.groupBy("part").applyInPandas(gather, DIRTY), "summaries")


def _units(dirty: DataFrame) -> DataFrame:
    """Units that a document shares, by role: a segment that tolerates a difference counts two."""
    by_segment = dirty.groupBy("doc_id", "role", "seg").agg(F.sum("units").alias("units"))
    return by_segment.groupBy("doc_id", "role").agg(F.sum(F.when(F.col("seg") >= 0, 2).otherwise(F.col("units"))).alias("units"))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose sets are similar enough."""

    def run(batches):
        for batch in slices(batches, SLICE):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep))

    left, right = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def bitmap(tokens: np.ndarray, b: int) -> bytes:
    """Parity of the number of elements in each of a power of two of buckets, for scheme b."""
    bits = min(max(1 << (4 * BOUNDS[b + 1] - 1).bit_length(), 64), MAP_BITS)
    odd = np.bincount((mix(tokens) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _near(pdf: pd.DataFrame) -> np.ndarray:
    """Pairs (prober, other) of one group of owners that their bitmaps do not rule out."""
    ids, part, n, mine = (pdf[c].to_numpy() for c in ("doc_id", "part", "n", "mine"))
    maps = np.frombuffer(b"".join(pdf["map"]), np.uint64).reshape(len(pdf), -1)
    within = pdf["b1"].iat[0] == pdf["b2"].iat[0]
    probers, out = np.flatnonzero(pdf["probe"].to_numpy()), []
    step = max(1, (1 << 20) // maps.size)
    for at in range(0, len(probers), step):
        i = probers[at : at + step, None]
        fits = part[i] > part
        if not within:
            fits &= mine[i] != mine
        if not fits.any():
            continue
        least = np.bitwise_count(maps[i[:, 0], None] ^ maps).sum(axis=2, dtype=np.int64)
        x, y = np.nonzero(fits & (9 * least <= n[i] + n))
        out.append(np.stack([ids[i[x, 0]], ids[y]], 1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _candidates(open_keys: DataFrame, probes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different parts that share a probed key and that bitmaps do not rule out.

    One side's probes are enough for a pair, so the side with the larger part probes. Owners of
    a key are compared inside their group, which is split into blocks of ``BLOCK`` rows, every
    two of which are one group; only what passes leaves it.
    """

    def sketch(batches):
        for pdf in batches:
            rows = []
            for doc_id, blob in zip(pdf["doc_id"], pdf["tokens"]):
                tokens = np.frombuffer(blob, "<u8")
                rows += [(doc_id, role, len(tokens), bitmap(tokens, b)) for role, (b, _) in enumerate(roles(len(tokens)))]
            yield pd.DataFrame(rows, columns=["doc_id", "role", "n", "map"]).astype({"role": "int32"})

    group = ["key", "width", "b1", "b2"]

    def compare(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            at = pdf[group].to_numpy()
            cuts = np.r_[0, np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1]
            held = pdf.iloc[cuts[-1] :]
            found = [_near(pdf.iloc[x:y]) for x, y in zip(cuts, cuts[1:])]
            if found:
                yield pd.DataFrame(np.unique(np.concatenate(found), axis=0), columns=["a", "b"])
        if held is not None and len(held):
            yield pd.DataFrame(_near(held), columns=["a", "b"])

    maps = sets.select("doc_id", "tokens").mapInPandas(sketch, "doc_id long, role int, n long, map binary")
    asked = probes.select("key", F.col("a").alias("doc_id"), F.lit(True).alias("probe")).distinct()
    owners = open_keys.join(asked.select("key").distinct(), "key", "left_semi").select("key", "doc_id", "role", "part").distinct()
    owners = owners.join(asked, ["key", "doc_id"], "left").withColumn("probe", F.coalesce("probe", F.lit(False)))
    sizes = owners.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    spread = owners.join(sizes, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("mine", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    spread = spread.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("b1", F.least("mine", "with")).withColumn("b2", F.greatest("mine", "with"))
    mapped = spread.join(maps, ["doc_id", "role"]).withColumn("width", F.length("map")).select(*group, "mine", "doc_id", "part", "probe", "n", "map")
    dealt = mapped.repartition(*group).sortWithinPartitions(*group)
    return dealt.mapInPandas(compare, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _entries(sets: DataFrame) -> DataFrame:
    """The keys of every set, with their role, segment and spare units."""

    def emit(batches):
        for batch in slices(batches, SLICE // 2):
            out = []
            for doc_id, blob in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = np.frombuffer(blob, "<u8")
                for role, (b, most) in enumerate(roles(len(tokens))):
                    k, s, spare = keys(tokens, b, most)
                    s = np.where(s < 0, -1 - np.arange(len(s)), s)
                    out.append([k.view(np.int64), np.full(len(k), doc_id), np.full(len(k), role, np.int32), s.astype(np.int32), np.full(len(k), spare, np.int32)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["key", "doc_id", "role", "seg", "spare"])

    return sets.select("doc_id", "tokens").mapInArrow(emit, "key long, doc_id long, role int, seg int, spare int")


def _probes(open_keys: DataFrame) -> DataFrame:
    """The keys that each document has to look up: a segment is open if any of its keys is, and
    the most expensive ones are what the spare units may leave out."""
    segs = open_keys.groupBy("doc_id", "role", "seg", "spare").agg(F.max("cost").alias("cost"), F.min("key").alias("_k"))
    units = F.when(F.col("seg") >= 0, 2).otherwise(1)
    by = Window.partitionBy("doc_id", "role")
    upto = F.sum(units).over(by.orderBy(F.desc("cost"), "seg").rowsBetween(Window.unboundedPreceding, 0))
    probes = segs.withColumn("_upto", upto).where(F.col("_upto") > F.greatest("spare", F.lit(0))).select("doc_id", "role", "seg")
    return materialise(open_keys.join(probes, ["doc_id", "role", "seg"], "left_semi").select("key", F.col("doc_id").alias("a"), F.col("part").alias("pa")), "probes")


def _links(sets: DataFrame) -> DataFrame:
    """Links that connect what is similar among distinct sets: not every link, but every component."""
    entries = materialise(_entries(sets), "entries")
    common = entries.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    entries = materialise(entries.join(common.select("key", "low"), "key"), "shared")
    first = entries.where("low < doc_id").groupBy("doc_id").agg(F.min("low").alias("b")).select(F.col("doc_id").alias("a"), "b")
    links = materialise(_verify(first, sets), "found")
    for step in range(STAR_ROUNDS + 1):
        parts = connected_components(links)
        owned = entries.drop("low").join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component")
        mixed = owned.groupBy("key").agg(F.min("part").alias("p0"), F.max("part").alias("p1"), F.count(F.lit(1)).alias("cost")).where("p0 < p1").select("key", "cost")
        open_keys = materialise(owned.join(mixed, "key"), "open")
        probes = _probes(open_keys)
        if not probes.limit(1).count():
            break
        if step == STAR_ROUNDS:
            return links.union(materialise(_verify(_candidates(open_keys, probes, sets), sets), "found"))
        low = Window.partitionBy("key")
        others = open_keys.groupBy("key", "part").agg(F.min("doc_id").alias("doc_id")).withColumn("_low", F.min("part").over(low)).where("part = _low")
        pairs = (probes.join(others, "key").where("pa <> part").select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b")).distinct())
        links = links.union(materialise(_verify(pairs, sets), "found"))
    return links


def _prepared(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A summary of each row, the same with what may have links marked, the classes of equal sets
    and the sets of the marked ones."""
    parts = max(PARTS, partitions_for(docs.sparkSession, docs.select("doc_id", "text")) // 4)
    seen = _summaries(docs, parts)
    rows = seen.where("kind = 0").select("doc_id", "n", "h1", "h2", "spare0", "spare1")
    units = _units(seen.where("kind = 1"))
    wide = units.groupBy("doc_id").agg(*[F.coalesce(F.sum(F.when(F.col("role") == r, F.col("units"))), F.lit(0)).alias(f"units{r}") for r in (0, 1)])
    alive = F.coalesce(F.col("units0") > F.col("spare0"), F.lit(False)) | F.coalesce(F.col("units1") > F.col("spare1"), F.lit(False))
    marked = rows.join(wide, "doc_id", "left").withColumn("alive", alive | F.coalesce(F.least("spare0", "spare1") < 0, F.lit(False)))
    sets_of = ["h1", "h2", "n"]
    classes = materialise(marked.where("n > 0 AND doc_id IS NOT NULL").groupBy(sets_of).agg(F.min("doc_id").alias("rep"), F.max("alive").alias("alive")), "classes")

    def tokens(batches):
        for batch in slices(batches, SLICE):
            found = [shingles(t).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "tokens"])

    alive_ids = classes.where("alive").select(F.col("rep").alias("doc_id")).distinct()
    sets = docs.select("doc_id", "text").join(alive_ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(tokens, "doc_id long, tokens binary")
    return rows, marked, classes, materialise(sets.dropDuplicates(["doc_id", "tokens"]), "sets")


def similar_sets(docs: DataFrame) -> DataFrame:
    """The join itself: every link (a, b), a < b, between distinct sets, each named by the
    smallest doc_id that has it. Its size grows with the number of links."""
    sets = _prepared(docs)[3]
    entries = materialise(_entries(sets), "entries")
    shared = entries.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("cost")).where("low < high").select("key", "cost")
    open_keys = materialise(entries.join(shared, "key").withColumn("part", F.col("doc_id")), "open")
    return _verify(_candidates(open_keys, _probes(open_keys), sets), sets).distinct()


def components(docs: DataFrame) -> DataFrame:
    """``docs``: doc_id, text. Returns doc_id, n_shingles, component_id per row."""
    rows, marked, classes, sets = _prepared(docs)
    sets_of = ["h1", "h2", "n"]
    found = _links(sets)
    # rows of one id pool their links: their classes are tied through the id
    ties = marked.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", *sets_of).join(classes.select(*sets_of, "rep"), sets_of).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    twice = ties.groupBy("a").agg(F.min("b").alias("b0"), F.max("b").alias("b1")).where("b0 < b1").select(F.col("b0").alias("a"), F.col("b1").alias("b"))
    label = connected_components(found.union(twice))
    classes = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select(*sets_of, F.coalesce("component", "rep").alias("component_id"))
    joined = rows.select("doc_id", *sets_of).join(classes, sets_of, "left")
    own = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))

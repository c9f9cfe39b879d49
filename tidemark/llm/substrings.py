"""Substring dedup: remove word spans that a reference, or an earlier document, already has.

``remove_reference`` takes a reference of bounded size: its shards become suffix automata that
are broadcast, documents stream past them, and wherever the matching statistic reaches the
threshold the matched span goes.

``remove_repeats`` dedups a corpus against itself. There the reference is the whole corpus, and
streaming every document past an automaton of every shard grows with its square (README has the
figures), so the matching statistic is cut at the threshold: a window of ``words`` words is
matched iff its fingerprint has an earlier owner. Fingerprints (two rolling hashes over 64-bit
word hashes: one whole, 16 bits of the other, and further bits of that as the shard's number, 86
bits at least; fewer than one run of 30 GB in a million has a false match) are packed per batch of documents and dealt by their own value; a shard
sorts its share, keeps the first (doc_id, start) of each and sends the other windows back to the
batch they came from, where they merge into spans. A batch first compares its windows with each
other and sends only the first of equals, so a passage in a third of all documents reaches its
shard once a batch; a block names the documents it has windows of, and what else a batch needs to
merge goes along once. One shuffle of 11 to 13 bytes a word that is the batch's first.

Defined cases: null texts have no words; texts shorter than a window lose nothing; windows that
overlap themselves count; rows that repeat a doc_id and its text keep what the other keeps; null
ids come after all others; an empty table gives an empty result; extra columns are ignored.
"""

import hashlib
import json
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, gram_hashes, materialise, mix, partitions_for, word_hashes

WORDS = 20
PARTS = 64
LAST = 2**63 - 1
BLOCK = ["part", "origin", "names", "lengths", "keys", "more", "line", "ids", "begins", "counts"]
SHARD_WORDS = 200_000
MAX_REFERENCE_WORDS = 2_000_000


class SuffixAutomaton:
    """Of a sequence of words; documents in it are separated by resetting."""

    def __init__(self, documents):
        self.next, self.link, self.length = [{}], [-1], [0]
        for words in documents:
            last = 0
            for w in words:
                last = self._extend(last, w)

    def _extend(self, last: int, w) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(w)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        link[q] = c
        return c

    def statistics(self, words) -> list[int]:
        """For each position, the longest match that ends there."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            out.append(n)
        return out


def covered(statistics: list[int], least: int) -> np.ndarray:
    """Positions inside a match of at least ``least`` words."""
    keep, reach = np.zeros(len(statistics), bool), len(statistics)
    for end in range(len(statistics) - 1, -1, -1):
        if statistics[end] >= least:
            reach = min(reach, end + 1 - statistics[end])
        keep[end] = reach <= end
        if reach > end:
            reach = len(statistics)
    return keep


def remove_reference(docs: DataFrame, reference: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows of ``docs`` with the spans that ``reference`` (text) has cut out of ``text``.

    The reference has to be at most ``MAX_REFERENCE_WORDS`` words; it is broadcast in shards.
    """
    size = reference.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    if size > MAX_REFERENCE_WORDS:
        raise ValueError(f"a reference of {size} words is too large to broadcast; use remove_repeats on the union")
    shards, current, held = [], [], 0
    for r in reference.where("text IS NOT NULL").select("text").toLocalIterator():
        found = r["text"].encode("utf-8", "surrogatepass").split()
        current.append(found)
        held += len(found)
        if held >= SHARD_WORDS:
            shards, current, held = [*shards, SuffixAutomaton(current)], [], 0
    shared = [docs.sparkSession.sparkContext.broadcast(a) for a in [*shards, SuffixAutomaton(current)]]
    at = docs.columns.index("text")

    def run(batches):
        for pdf in batches:
            out = []
            for text in pdf.iloc[:, at]:
                found = (text or "").encode("utf-8", "surrogatepass").split()
                gone = np.zeros(len(found), bool)
                for shard in shared:
                    gone |= covered(shard.value.statistics(found), words)
                out.append(text if text is None or not gone.any() else b" ".join(w for w, g in zip(found, gone) if not g).decode("utf-8", "surrogatepass"))
            yield pdf.assign(text=out)

    return docs.mapInPandas(run, docs.schema)


def _prints(words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of n words that don't follow from each other."""
    hashes = word_hashes(words)
    return gram_hashes(hashes, n), gram_hashes(mix(hashes + np.uint64(0x9E3779B97F4A7C15)), n)


def _later(key: np.ndarray, more: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marks windows whose print (key, more) another one with a smaller (doc, start) has."""
    order = np.argsort(key)
    line = key[order]
    same = np.r_[False, line[1:] == line[:-1]]
    del line
    rows = order[same | np.r_[same[1:], False]]
    rows = rows[np.lexsort((start[rows], doc[rows], more[rows], key[rows]))]
    later = np.zeros(len(key), bool)
    if len(rows):
        head = np.flatnonzero(np.r_[True, (key[rows][1:] != key[rows][:-1]) | (more[rows][1:] != more[rows][:-1])])
        owner = np.repeat(rows[head], np.diff(np.r_[head, len(rows)]))
        later[rows] = (doc[rows] != doc[owner]) | (start[rows] != start[owner])
    return later


def _pack(values: np.ndarray, kind: str = "<u4") -> bytes:
    """Differences of integers, bytes of equal weight together, compressed."""
    steps = np.diff(values, prepend=0).astype(kind)
    return zlib.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(len(steps), steps.itemsize).T).tobytes(), 1)


def _unpack(blob: bytes, kind: str = "<u4") -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(flat.T).view(kind).ravel().astype(np.int64).cumsum()


def _later_windows(docs: DataFrame, words: int, parts: int) -> DataFrame:
    """(doc_id, print, spans): the spans to remove of each document that has any."""

    def emit(batches):
        task = TaskContext.get().partitionId()
        for number, pdf in enumerate(batches):
            ids, prints, ks, others, docs_in = [], [], [], [], []
            for i, (doc_id, p, text) in enumerate(zip(pdf["doc_id"], pdf["print"], pdf["text"])):
                ids.append(LAST if pd.isna(doc_id) else int(doc_id))
                prints.append(0 if pd.isna(p) else int(p))
                if text is not None and not pd.isna(text):
                    grams, second = _prints(text.encode("utf-8", "surrogatepass").split(), words)
                    if len(grams):
                        ks.append(grams)
                        others.append(second)
                        docs_in.append(i)
            if not ks:
                continue
            k, other = np.concatenate(ks), np.concatenate(others)
            more, part = other.astype("<u2"), ((other >> np.uint64(16)) % np.uint64(parts)).astype(np.uint32)
            n_windows = [len(x) for x in ks]
            del other, ks, others
            origin = f"{task}-{number}"
            size, who = np.array(n_windows), np.array(docs_in, np.int32)
            doc = np.repeat(who, size)
            begin = np.r_[0, size.cumsum()]
            number_of = np.array(ids, np.int64)
            # windows that the batch itself has earlier
            gone = _later(k, more, number_of[doc], np.arange(len(k)) - np.repeat(begin[:-1], size))
            yield {"part": zlib.crc32(origin.encode()) % parts, "origin": origin, "names": zlib.compress(json.dumps([ids, prints]).encode(), 1),
                   "lengths": _pack(np.concatenate([size, who]), "<i8"), "line": _pack(np.flatnonzero(gone))}
            part[gone] = parts
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                rows = order[bounds[p] : bounds[p + 1]]
                if len(rows):
                    # positions along the batch grow, so their differences are small
                    head = np.flatnonzero(np.r_[True, doc[rows][1:] != doc[rows][:-1]])
                    of = np.searchsorted(who, doc[rows[head]])
                    yield {"part": p, "origin": origin, "keys": k[rows].astype("<u8").tobytes(), "more": more[rows].tobytes(), "line": _pack(rows),
                           "ids": _pack(number_of[who[of]], "<i8"), "begins": _pack(begin[of]), "counts": _pack(np.diff(np.r_[head, len(rows)]), "<i8")}

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["keys"].isna()
        out = pdf.loc[own, ["origin", "names", "lengths", "line"]].values.tolist()
        pdf = pdf[~own]
        if len(pdf):
            ids, starts, lines = [], [], []
            for line, who, begins, counts in zip(pdf["line"], pdf["ids"], pdf["begins"], pdf["counts"]):
                rows, n = _unpack(line), _unpack(counts, "<i8")
                ids.append(np.repeat(_unpack(who, "<i8"), n))
                starts.append(rows - np.repeat(_unpack(begins), n))
                lines.append(rows)
            later = _later(np.frombuffer(b"".join(pdf["keys"]), "<u8"), np.frombuffer(b"".join(pdf["more"]), "<u2"), np.concatenate(ids), np.concatenate(starts))
            ends = np.cumsum([len(x) for x in lines])
            for origin, line, marks in zip(pdf["origin"], lines, np.split(later, ends[:-1])):
                if marks.any():
                    out.append([origin, None, None, _pack(line[marks])])
        return pd.DataFrame(out, columns=["origin", "names", "lengths", "line"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["names"].notna()].iloc[0]
        ids, prints = json.loads(zlib.decompress(own["names"]))
        size, who = np.split(_unpack(own["lengths"], "<i8"), 2)
        gone = np.sort(np.concatenate([_unpack(x) for x in pdf["line"]]))
        first, out = np.r_[0, size.cumsum()], []
        cuts = np.searchsorted(gone, first)
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                start = gone[a:b] - first[i]
                new = np.r_[True, start[1:] > start[:-1] + words]
                begin, end = start[new], np.r_[start[:-1][new[1:]], start[-1]] + words
                out.append((None if ids[who[i]] == LAST else ids[who[i]], prints[who[i]], np.stack([begin, end]).astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["doc_id", "print", "spans"]).astype({"doc_id": "Int64"})

    def blocks(batches):
        return gathered((pd.DataFrame({c: [block.get(c)] for c in BLOCK}) for block in emit(batches)), 8)

    shape = "part int, origin string, names binary, lengths binary, keys binary, more binary, line binary, ids binary, begins binary, counts binary"
    blobs = docs.mapInPandas(blocks, shape)
    later = blobs.groupBy("part").applyInPandas(shard, "origin string, names binary, lengths binary, line binary")
    return later.groupBy("origin").applyInPandas(merge, "doc_id long, print long, spans binary")


def remove_repeats(docs: DataFrame, words: int = WORDS, keep_text: bool = False) -> DataFrame:
    """``docs``: doc_id, text. Returns doc_id, n_words, n_removed, kept_sha256, and the kept text
    where it is wanted."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("print"), "text")
    parts = max(PARTS, partitions_for(docs.sparkSession, docs.select("doc_id", "text")) // 2)
    spans = materialise(_later_windows(rows, words, parts), "spans").dropDuplicates(["doc_id", "print"])
    spans = spans.select(F.col("doc_id").alias("_d"), F.col("print").alias("_p"), "spans")
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("print") == F.col("_p")), "left").select("doc_id", "text", "spans")

    def cut(batches):
        for pdf in batches:
            out = []
            for text, blob in zip(pdf["text"], pdf["spans"]):
                found = (text or "").encode("utf-8", "surrogatepass").split()
                kept = found
                if blob is not None and not (isinstance(blob, float)):
                    kept, at = [], 0
                    for a, b in np.frombuffer(blob, "<i8").reshape(2, -1).T.tolist():
                        kept += found[at:a]
                        at = b
                    kept += found[at:]
                whole = b" ".join(kept)
                out.append((len(found), len(found) - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode("utf-8", "surrogatepass") if keep_text else None))
            frame = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept"])
            frame.insert(0, "doc_id", pdf["doc_id"].to_numpy())
            yield frame.astype({"doc_id": "Int64"})

    done = joined.mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
    return done if keep_text else done.drop("kept")

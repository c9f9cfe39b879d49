"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Bulk-synchronous best-fit, longest first. Documents and gaps are kept in sorted order as runs of
equal length, so each list has at most ``capacity`` distinct values however large the table is.
A round takes the documents of one length: a successor sweep finds the smallest gap that holds
them, the documents go there by their rank, the gaps are updated, and the next run is matched.
The rounds run on the run-length lists; ranks within a length, and every document's place from
its rank, are computed by distributed salted window counts, so a length that a third of all
documents share is ranked by many tasks.

Defined cases: a null or empty text is the end-of-text id alone; repeated rows are packed each;
pieces of one document may land in different sequences; an empty table gives an empty result.
"""

import array
import bisect
import itertools
import json
import os
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices

CAPACITY = 2048
RANK_ROWS = 50_000
CACHE_BYTES = 24 << 20
ENTRY_BYTES = 150
#: Of text at a time: smaller than elsewhere, because Arrow and numpy hold several times as much.
SLICE_BYTES = 1 << 20
MARK = "\x01"
#: Beyond these characters, Unicode versions and context could make a difference.
ODD = r"[^\n\x20-\x7e\x{a1}-\x{12f}]"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level BPE: itself if it is
    printable in Latin-1, else the next one from 256 on."""
    same = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (chr(c) for c in itertools.count(256))
    return {b: chr(b) if b in same else next(others) for b in range(256)}


BYTE_NAMES = _byte_names()


class Tokens:
    """Ids of whole texts, from a cache of the ids of words.

    The tokenizer's rules never join across a space or newline, so the chunks between them are
    independent; a text that holds one of its special tokens is encoded in one go. Texts come as
    Arrow arrays, whose chunks and words are split and told apart there, so that Python meets
    each word once a call. The cache has a new and an old half. When the new one has reached
    ``CACHE_BYTES`` it becomes the old one, from which words that are met again move on; the
    rest is forgotten at the next change.

    Of a tokenizer that lower-cases, splits by ``SPLIT`` and then applies byte-level BPE, chunks
    of plain Latin characters are split here and only their words go to the BPE model; any other
    chunk counts as one word and goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.old, self.size = Tokenizer.from_file(path), {}, {}, 0
        self.model = self.tokenizer.model
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids  # a lone control character is one id
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join(map(re.escape, [MARK, *special])) if len(self.mark) == 1 else ""  # matches texts to encode in one go
        self.odd = ODD if self._splits(json.loads(self.tokenizer.to_str())) else ""  # matches what is not split here

    @staticmethod
    def _splits(made: dict) -> bool:
        """Whether lower case, ``SPLIT`` and byte-level BPE is all that the tokenizer does."""
        steps = [n.get("type") for n in (made["normalizer"] or {}).get("normalizers", [])]
        split = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        plain = steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in split] == ["Split", "ByteLevel"] and made["model"]["type"] == "BPE"
        return plain and split[0]["pattern"] == {"Regex": SPLIT} and split[0]["behavior"] == "Removed" and split[0]["invert"] and not (
            split[1]["use_regex"] or split[1]["add_prefix_space"])

    def _word(self, word: str) -> bytes:
        found = self.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_NAMES))
        return array.array("I", [t.id for t in found]).tobytes()

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of new chunks, encoded in one go with a mark between each two."""
        found = self.tokenizer.encode_batch_fast([f" {MARK} ".join(chunks)], add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        cuts, data = [-1, *np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)], ids.tobytes()
        return [data[4 * a + 4 : 4 * b] for a, b in zip(cuts, cuts[1:])]

    def _known(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words."""
        names, odd = (a.to_numpy(zero_copy_only=False).tolist() for a in (words, pc.match_substring_regex(words, self.odd)))
        found, chunks = list(map(self.cache.get, names)), []
        for i, (name, ids) in enumerate(zip(names, found)):
            if ids is None:
                ids = self.old.get(name)
                if ids is None and odd[i]:
                    chunks.append(i)
                    continue
                self.cache[name] = found[i] = self._word(name) if ids is None else ids
                self.size += ENTRY_BYTES + 2 * len(name)
        for i, ids in zip(chunks, self._learn([names[i] for i in chunks]) if chunks else []):
            self.cache[names[i]] = found[i] = ids
            self.size += ENTRY_BYTES + 2 * len(names[i])
        return found

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """The little-endian 32-bit ids of each text; null is an empty one."""
        if self.size > CACHE_BYTES:
            self.old, self.cache, self.size = self.cache, {}, 0
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.whole)
        rest = pc.replace_substring(pc.if_else(whole, "", texts), "\n", " ")
        chunks = _parts(pc.if_else(pc.match_substring_regex(rest, self.odd), rest, pc.ascii_lower(rest)))
        names = chunks.values.dictionary
        words = _parts(pc.if_else(pc.match_substring_regex(names, self.odd), names, _spaced(pc.utf8_lower(names))))
        known = self._known(words.values.dictionary)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, cuts = _spread(np.frombuffer(b"".join(known), "<u4"), np.append(0, np.cumsum(lengths)), words)
        ids, cuts = _spread(ids, cuts, chunks)
        data, cuts = ids.tobytes(), (4 * cuts).tolist()
        found = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            found[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        return found

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_all(pa.array([text], pa.string()))[0], "<u4")


def _parts(texts: pa.Array) -> pa.Array:
    """The space-separated parts of each text, as lists of a dictionary's entries."""
    lists = pc.split_pattern(texts, " ")
    return pa.ListArray.from_arrays(lists.offsets, lists.values.dictionary_encode())


def _spaced(chunks: pa.Array) -> pa.Array:
    """Chunks with a space between the words that SPLIT finds. Letters alone, and letters before
    one point, need no pattern matching, which is slow."""
    stem, last = pc.utf8_slice_codeunits(chunks, 0, -1), pc.utf8_slice_codeunits(chunks, -1)
    ended = pc.and_(pc.utf8_is_alpha(stem), pc.is_in(last, pa.array([*".,;:!?"], chunks.type)))
    easy = pc.or_(ended, pc.utf8_is_alpha(chunks))
    hard = pc.ascii_rtrim(pc.replace_substring_regex(chunks.filter(pc.invert(easy)), f"({SPLIT})", r"\1 "), " ")
    made = pc.if_else(ended, pc.binary_join_element_wise(stem, last, pa.scalar(" ", chunks.type)), chunks)
    return pc.replace_with_mask(made, pc.invert(easy), hard)


def _spread(ids: np.ndarray, cuts: np.ndarray, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of ids whose dictionary entries end at cuts: the ids of each list, and where these end."""
    which, at = lists.values.indices.to_numpy(), lists.offsets.to_numpy()
    n = np.diff(cuts)[which]
    ends = np.append(0, np.cumsum(n))
    return ids[np.repeat(cuts[which] - ends[:-1], n) + np.arange(ends[-1])], ends[at]


@cache
def _tokens(path: str) -> Tokens:
    """One a worker process: its cache outlives a task, of 2 * CACHE_BYTES and one slice's chunks or so."""
    return Tokens(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece; only documents over the capacity are cut."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tokens = _tokens(tokenizer_path)
        for batch in slices(batches, SLICE_BYTES):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encode_all(batch.column(1))):
                data = ids + end
                for i, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])
            pa.default_memory_pool().release_unused()  # a reused worker lives through other stages

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Places for ``counts[length]`` pieces, longest first, as runs (length, first rank, pieces
    per sequence, first sequence, offset). Within a run, rank r of it goes to sequence
    first + r // per at offset + (r % per) * length: best fit returns to the same sequence while
    it is the tightest."""
    runs, sizes, gaps, opened = [], [], {}, 0  # gaps: size -> [(first sequence, how many)]

    def free(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in gaps:
                bisect.insort(sizes, size)
                gaps[size] = []
            gaps[size].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)  # the successor among the gaps
            gap = sizes[at] if at < len(sizes) else capacity
            per = gap // length
            needed = -(-left // per)
            if at < len(sizes):
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
                if n > needed:
                    free(gap, first + needed, n - needed)
                    n = needed
            else:
                first, n = opened, needed
                opened += needed
            took = min(left, n * per)
            runs.append((length, rank, per, first, capacity - gap))
            full, rest = divmod(took, per)
            free(gap - per * length, first, full)
            if rest:
                free(gap - rest * length, first + full, 1)
            rank, left = rank + took, left - took
    return runs


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to materialised pieces."""
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    runs = sorted(plan(counts, capacity))
    shared = parts.sparkSession.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))
    salts = max(1, -(-sum(counts.values()) // RANK_ROWS))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")).select(
        "length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_r", F.row_number().over(within)).join(offsets, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_r") - 1)

    def place(batches):
        table = shared.value
        keys = table[:, 0] << 44 | table[:, 1]
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(), pdf["_rank"].to_numpy()
            run = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            within = rank - run[:, 1]
            yield pdf.drop(columns="_rank").assign(sequence_id=run[:, 3] + within // run[:, 2], offset=run[:, 4] + within % run[:, 2] * length)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInPandas(place, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialise(pieces(docs, tokenizer_path, capacity), "pieces"), capacity)

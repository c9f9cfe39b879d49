"""Language ID: interpolated Kneser-Ney character models, one per language.

Training takes a bounded sample: ``SAMPLE_DOCS`` rows a language (fewer if there are more than
``SAMPLE_ROWS / SAMPLE_DOCS`` languages), smallest id hashes first, as long as they come to no
more than ``SAMPLE_CHARS`` characters. Letters are lower-cased and numbered (those beyond the
``MAX_LETTERS`` most frequent ones share a number, so that four fit 64 bits); everything else is
a space. N-grams up to order 4 are base-``K`` numbers, and each order of each language is a
sorted array of them with its discounted probabilities and back-off weights, found by binary
search. A text goes to the language with the lowest cross-entropy per character. Scoring takes
``CHUNK`` characters at a time, each distinct n-gram once, and a worker keeps the values it has
computed (at most ``KEEP`` of them).

``score`` is the share of the best language when each counts as exp(-cross-entropy * min(n,
``LENGTH``)). A prediction is rejected (``accepted`` false) if there is no letter, or if the
cross-entropy is above what its language reaches on every fourth sampled text; the models learn
from the other three.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a very long text
is scored whole, ``CHUNK`` characters at a time; rows that repeat are predicted each; extra
columns pass through ``classify``, but for those of the names that it adds, which it replaces;
without a labelled row every prediction is ``und``; a language of which only texts without
letters or only texts over ``SAMPLE_CHARS`` exist is not learnt; of languages that score alike
the first by name wins.
"""

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import label_bucket, slices

ORDER = 4
SAMPLE_DOCS = 400
SAMPLE_ROWS = 40_000
SAMPLE_CHARS = 4_000_000
MAX_LETTERS = 65_000
LENGTH = 50
KEEP = 500_000
CHUNK = 1 << 18
MARGIN = 0.5


@cache
def letter_table() -> np.ndarray:
    """1 for each code point that is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Model:
    """Trained on the driver from the sample; pickled to the workers, where a cache grows."""

    def __init__(self, samples: dict[str, list[str]]):
        arrays = {lang: [code_points(t) for t in docs if t] for lang, docs in samples.items()}
        every = [a for docs in arrays.values() for a in docs]
        points, counts = np.unique(np.concatenate(every) if every else np.empty(0, np.uint32), return_counts=True)
        points, counts = points[letter_table()[points] > 0], counts[letter_table()[points] > 0]
        self.known = points[np.argsort(-counts, kind="stable")[:MAX_LETTERS]]
        self.k = len(self.known) + 2  # a space, the known letters, any other letter
        arrays = {lang: [x for x in (self._classes(a) for a in docs) if x.any()] for lang, docs in arrays.items()}
        self.langs = sorted(lang for lang, docs in arrays.items() if docs)
        learnt = {lang: [a for i, a in enumerate(docs) if i % 4] or docs for lang, docs in arrays.items()}
        self.tables = {lang: self._count(learnt[lang]) for lang in self.langs}
        self.seen, self.values = np.empty(0, np.uint64), np.empty((0, len(self.langs)), np.float32)
        self.limit = {}
        for i, lang in enumerate(self.langs):
            entropies = np.sort([self._entropies([a])[0][i] for a in arrays[lang][::4]])
            self.limit[lang] = float(entropies[int(0.999 * (len(entropies) - 1))] * (1 + MARGIN))

    def _classes(self, points: np.ndarray) -> np.ndarray:
        if getattr(self, "_map", None) is None:
            self._map = letter_table().astype(np.uint16) * (self.k - 1)
            self._map[self.known] = np.arange(1, len(self.known) + 1, dtype=np.uint16)
        return self._map[points]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_map"} | {"seen": self.seen[:0], "values": self.values[:0]}

    def grams(self, classes: np.ndarray, n: int = ORDER) -> np.ndarray:
        """One n-gram ending at each character; the text is preceded by spaces."""
        padded = np.concatenate([np.zeros(n - 1, np.uint64), classes.astype(np.uint64)])
        out = padded[: len(classes)].copy()
        for j in range(1, n):
            out = out * np.uint64(self.k) + padded[j : j + len(classes)]
        return out

    def _count(self, docs: list[np.ndarray]) -> list[tuple]:
        """For each order: sorted n-grams, their discounted shares, contexts, back-off weights.

        The highest order uses occurrence counts; lower ones count distinct left extensions.
        """
        out, k = [], np.uint64(self.k)
        grams, counts = np.unique(np.concatenate([self.grams(a) for a in docs]), return_counts=True)
        for n in range(ORDER, 0, -1):
            once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
            discount = once / (once + 2 * twice) if once else 0.5
            contexts, start = np.unique(grams // k, return_index=True)
            totals = np.add.reduceat(counts, start)
            kinds = np.diff(np.append(start, len(grams)))
            shares = np.maximum(counts - discount, 0) / np.repeat(totals, kinds)
            out.append((grams, shares, contexts, discount * kinds / totals))
            # a context's rows share its prefix; dropping the first character gives the lower order
            lower, counts = np.unique(grams % np.uint64(self.k ** (n - 1)), return_counts=True)
            grams = lower
        return out

    def _probabilities(self, grams: np.ndarray, lang: str) -> np.ndarray:
        k, p, result = np.uint64(self.k), np.full(len(grams), 1.0 / self.k), None
        for n in range(1, ORDER + 1):
            keys, shares, contexts, weights = self.tables[lang][ORDER - n]
            mine = grams % np.uint64(self.k**n)
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            share = np.where(keys[at] == mine, shares[at], 0.0)
            before = mine // k
            at = np.minimum(np.searchsorted(contexts, before), len(contexts) - 1)
            known = contexts[at] == before
            result = p = np.where(known, share + weights[at] * p, p)
        return result

    def _lookup(self, grams: np.ndarray) -> np.ndarray:
        """Natural-log probability per language of sorted distinct n-grams."""
        at = np.searchsorted(self.seen, grams)
        fresh = np.ones(len(grams), bool)
        inside = at < len(self.seen)
        fresh[inside] = self.seen[at[inside]] != grams[inside]
        new = grams[fresh]
        computed = np.stack([np.log(self._probabilities(new, lang)) for lang in self.langs], 1).astype(np.float32) if len(new) else None
        if 16 * len(new) > len(self.seen) and len(self.seen) + len(new) <= KEEP:  # few new ones aren't worth a merge
            merged = np.concatenate([self.seen, new])
            order = np.argsort(merged, kind="stable")
            self.seen, self.values = merged[order], np.concatenate([self.values, computed])[order]
            return self.values[np.searchsorted(self.seen, grams)]
        out = np.empty((len(grams), len(self.langs)), np.float32)
        out[~fresh] = self.values[at[~fresh]]
        if computed is not None:
            out[fresh] = computed
        return out

    def _entropies(self, docs: list[np.ndarray]) -> np.ndarray:
        """Cross-entropy per character of each document under each language, in nats."""
        sums, sizes = np.zeros((len(docs), len(self.langs))), np.array([len(d) for d in docs])
        if sizes.sum() <= 2 * CHUNK:
            self._add(sums, np.arange(len(docs)), [self.grams(d) for d in docs])
        else:
            for i, d in enumerate(docs):
                for at in range(0, len(d), CHUNK):
                    before = max(at - ORDER + 1, 0)
                    self._add(sums, np.array([i]), [self.grams(d[before : at + CHUNK])[at - before :]])
        return -sums / sizes[:, None]

    def _add(self, sums: np.ndarray, who: np.ndarray, grams: list[np.ndarray]) -> None:
        distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        first = np.r_[0, np.cumsum([len(g) for g in grams])[:-1]]
        sums[who] += np.add.reduceat(self._lookup(distinct)[inverse], first, axis=0, dtype=np.float64)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        lang, score, accepted = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
        group, chars = [], 0

        def flush():
            nonlocal group, chars
            if group:
                entropy = self._entropies([d for _, d in group])
                for (i, d), h in zip(group, entropy):
                    best = int(h.argmin())
                    share = np.exp(-(h - h[best]) * min(len(d), LENGTH))
                    lang[i], score[i] = self.langs[best], float(1 / share.sum())
                    accepted[i] = bool(h[best] <= self.limit[self.langs[best]])
            group, chars = [], 0

        for i, t in enumerate(texts):
            if t and self.langs:
                d = self._classes(code_points(t))
                if d.any():
                    group.append((i, d))
                    chars += len(d)
                    if chars >= CHUNK:
                        flush()
        flush()
        return lang, score, accepted


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """``labelled``: doc_id, text, lang. Learns from ``sample_docs`` rows of each language, those
    with the smallest id hashes; ids are chosen first, so few texts move."""
    order = Window.partitionBy("lang").orderBy("_h", "doc_id", "_t")
    rows = labelled.where("lang IS NOT NULL AND doc_id IS NOT NULL").select(
        "doc_id", "lang", F.xxhash64("doc_id").alias("_h"), F.xxhash64("text").alias("_t"), F.length("text").alias("_n"))
    langs = rows.select("lang").distinct().count()
    most = max(1, min(sample_docs, SAMPLE_ROWS // max(langs, 1)))
    upto = F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ids = (rows.where(F.col("_n").between(1, SAMPLE_CHARS)).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
           .withColumn("_upto", upto).where(F.col("_upto") <= SAMPLE_CHARS).select("doc_id", "lang", "_t").distinct())
    found = labelled.withColumn("_t", F.xxhash64("text")).join(F.broadcast(ids), ["doc_id", "lang", "_t"], "left_semi")
    found = found.dropDuplicates(["doc_id", "lang", "_t"]).select("lang", "text", "doc_id").toPandas()  # a row for each of ``ids``
    return Model({lang: [t for _, t in sorted(zip(part["doc_id"], part["text"]))] for lang, part in found.groupby("lang")})


def classify(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` with lang_pred, score and accepted, their names behind ``prefix``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    names = [f"{prefix}{n}" for n in ("lang_pred", "score", "accepted")]
    docs = docs.drop(*names)
    schema = T.StructType(docs.schema.fields + [T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.BooleanType())])
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches, 1 << 20):
            got = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got[0], pa.string()), pa.array(got[1], pa.float64()), pa.array(got[2], pa.bool_())],
                                             names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted: the text is read and not passed on."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, 1 << 20):
            lang, score, accepted = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                                             names=["doc_id", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def held_out(doc_id="doc_id"):
    return F.coalesce(label_bucket(F.col(doc_id), 4) == 2, F.lit(False))

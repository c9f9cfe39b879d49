"""Secret scans: fixed patterns, plus character Markov models of random strings and of
ordinary identifiers compared by log-likelihood ratio. DataFrame functions only.

The models are first-order chains over ASCII; a pair scores its first character's share times
the transition, so that the few unlabelled secrets among the ordinary tokens, which own most
of the rare contexts there, do not hide others. They learn from a labelled sample (``labelled``):
random strings are ``MADE`` digests written in each of four alphabets, and the values that the
fixed patterns find; ordinary identifiers are all other long tokens, these two in a bounded
sample of documents (``SAMPLE_DOCS``, the smallest id hashes). Pair counts back off to single
characters with a weight of ``BACKOFF`` observations.
A token of ``MIN_TOKEN`` or more characters is a finding when its mean ratio per pair is at
least ``MIN_MEAN`` nats, or ``MIN_MEAN_PLAIN`` if it has no digit, and it does not overlap a
pattern's span.

Defined cases: a null text counts as empty; an empty table gives an empty result; repeated
rows are scanned each; spans that begin together stand in the order of their kinds; time grows
with the number of matches in a text, not with its square; extra columns pass through, ``scan``
replacing those named like its results; positions are code points, ends exclusive.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let
from .common import scan as scan_array

# The base patterns, their kinds in order, the group that is measured, its least length.
PATTERNS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # runs are maximal, so shorter ones need no match
]
TOKEN = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}"
ANY_BASE = "|".join(f"(?:{p})" for _, p, _, _ in PATTERNS)
KIND_ORDER = {"assign": 0, "access": 1, "hex": 2, "random": 3}
SAMPLE_DOCS = 4000
MADE = 2000
MIN_TOKEN = 20
MIN_MEAN = 0.5
MIN_MEAN_PLAIN = 1.0
BACKOFF = 5.0
SPAN = "struct<kind:int,start:int,end:int>"
WIDE = "UTF-32"  # four bytes a code point, so positions need no search


def _wide_hex(text: str) -> str:
    return text.encode("utf-32-be").hex().upper()


def _found(text: Column, pattern: str, hit, group: int = 0) -> Column:
    """(start, end) of the leftmost non-overlapping matches; ``hit(match, group)`` says which count.

    The gaps between matches are what ``split`` leaves, so a running sum over gaps and
    matches gives positions.
    """
    def parts(gaps, found):
        sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        hits = F.zip_with(found, sizes, hit)
        return F.zip_with(F.arrays_zip(F.transform(found, F.length).alias("m"), hits.alias("hit")), F.slice(gaps, F.lit(1), F.size(found)), lambda x, gap: x.withField("g", F.length(gap)))

    zipped = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: parts(F.split(text, pattern, -1), found))

    def step(at, x):
        begin = at + x["g"]
        end = begin + x["m"]
        return F.struct(end.alias("state"), F.struct(x["hit"].alias("hit"), begin.alias("start"), end.alias("end")).alias("out"))

    spans = F.filter(scan_array(zipped, F.lit(0), step), lambda s: s["hit"])
    return F.when(F.regexp_like(text, F.lit(pattern)), spans)


def _kind(spans: Column, kind: str) -> Column:
    named = F.transform(spans, lambda s: F.struct(F.lit(KIND_ORDER[kind]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return F.coalesce(named, F.array().cast(f"array<{SPAN}>"))


def _by_start(a: Column, b: Column) -> Column:
    return F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])


def _loose(base: Column, more: Column) -> Column:
    """Of the spans ``more``, which don't overlap each other, those that no base span overlaps:
    one pass forward knows how far base spans reach, one backward where the next one begins."""
    def reach(upto, s):
        free = s["kind"].eqNullSafe(KIND_ORDER["random"])
        out = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (free & (upto <= s["start"])).alias("free"))
        return F.struct(F.when(free, upto).otherwise(F.greatest(upto, s["end"])).alias("state"), out.alias("out"))

    def begin(following, s):
        base_span = s["kind"] != KIND_ORDER["random"]
        out = F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (s["free"] & (following >= s["end"])).alias("free"))
        return F.struct(F.when(base_span, s["start"]).otherwise(following).alias("state"), out.alias("out"))

    ahead = F.reverse(scan_array(F.array_sort(F.concat(base, more), _by_start), F.lit(0), reach))
    kept = F.filter(F.reverse(scan_array(ahead, F.lit(2**31 - 1), begin)), lambda s: s["free"])
    return F.transform(kept, lambda s: s.dropFields("free"))


def _pairs(token: Column) -> Column:
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.ascii(c))
    n = F.size(codes)
    return F.zip_with(F.slice(codes, F.lit(1), n - 1), F.slice(codes, F.lit(2), n - 1), lambda a, b: a * 128 + b)


def made(spark: SparkSession, n: int = MADE, seed: int = 0) -> DataFrame:
    """Random strings, ``n`` in each alphabet: lower-case hex, upper case with digits, Base64, and
    the same without its two signs."""
    digest = F.sha2(F.concat_ws("-", F.lit("sample"), F.lit(seed), "id").cast("binary"), 256)
    upper = F.concat(*[F.lpad(F.conv(F.substring(digest, at, 12), 16, 36), 9, "0") for at in (1, 13, 25, 37)])
    base64 = F.substring(F.base64(F.unhex(digest)), 1, 42)
    return spark.range(n).select(F.explode(F.array(F.substring(digest, 1, 40), F.substring(upper, 1, 36), base64, F.translate(base64, "+/", ""))).alias("t"), F.lit(1).alias("random"))


def labelled(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The labelled sample: tokens ``t``, ``random`` 1 or 0."""
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")
    enough = lambda least: lambda v: F.length(v) >= least
    values = F.concat(*[F.filter(F.regexp_extract_all("text", F.lit(p), F.lit(g)), enough(least)) for _, p, g, least in PATTERNS])
    plain = F.regexp_extract_all(F.regexp_replace("text", ANY_BASE, " "), F.lit(r"[A-Za-z0-9_+/=-]{8,}"), F.lit(0))
    tokens = sample.select(F.explode(F.array(F.struct(F.lit(1).alias("random"), values.alias("t")), F.struct(F.lit(0).alias("random"), plain.alias("t")))).alias("x"))
    return tokens.select(F.explode("x.t").alias("t"), "x.random").unionByName(made(docs.sparkSession))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log ratio of each ASCII pair under the two models; 128 * 128 numbers."""
    return fit(labelled(docs, sample_docs))


def fit(sample: DataFrame) -> list[float]:
    """The same from a labelled sample (t, random)."""
    counts = (sample.select("random", F.explode(_pairs(F.col("t"))).alias("pair"))
              .groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n")).collect())  # at most 2 * 128 * 128 rows
    seen = {(r["random"], r["pair"]): r["n"] for r in counts}
    alphabet = [c for c in range(128) if chr(c).isalnum() or chr(c) in "_+/=-"]
    single = [{b: 1 + sum(seen.get((k, a * 128 + b), 0) for a in alphabet) for b in alphabet} for k in (0, 1)]
    every = [sum(single[k].values()) for k in (0, 1)]
    model = [0.0] * (128 * 128)
    for a in alphabet:
        total = [sum(seen.get((k, a * 128 + b), 0) for b in alphabet) for k in (0, 1)]
        for b in alphabet:
            p = [(seen.get((k, a * 128 + b), 0) + BACKOFF * single[k][b] / every[k]) / (total[k] + BACKOFF) for k in (0, 1)]
            first = [single[k][a] / every[k] for k in (0, 1)]
            model[a * 128 + b] = math.log(first[1] * p[1]) - math.log(first[0] * p[0])
    return model


def scan(docs: DataFrame, model: list[float]) -> DataFrame:
    """Adds ``base`` and ``spans``, arrays of (kind, start, end) by start, then kind, in place of
    any columns of these names."""
    ratios = F.split(F.lit(",".join(f"{x:.6g}" for x in model)), ",").cast("array<double>")  # folded to one literal
    rest = [c for c in docs.columns if c not in ("base", "spans")]
    out = docs.select(F.struct(*[docs[c] for c in rest]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast(f"array<{SPAN}>")
    enough = lambda least: lambda m, v: F.length(v) >= least
    kinds = [_kind(_found(F.col("text"), pattern, enough(least), group), kind) for kind, pattern, group, least in PATTERNS]
    out = out.withColumn("base", F.array_sort(F.concat(*kinds), _by_start))

    def random(token, _):
        score = F.aggregate(_pairs(token), F.lit(0.0), lambda s, p: s + F.element_at(ratios, p + 1)) / (F.length(token) - 1)
        return score >= F.when(F.regexp_like(token, F.lit("[0-9]")), MIN_MEAN).otherwise(MIN_MEAN_PLAIN)

    out = out.withColumn("more", _kind(_found(F.col("text"), TOKEN, random), "random"))
    loose = F.when(F.size("more") == 0, none).when(F.size("base") == 0, F.col("more")).otherwise(_loose(F.col("base"), F.col("more")))
    return out.select("row.*", "base", F.array_sort(F.concat("base", loose), _by_start).alias("spans"))


def listed(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KIND_ORDER])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == KIND_ORDER[kind])).cast("long")


def redact(docs: DataFrame, model: list[float], mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every finding replaced; overlapping spans are replaced once.
    ``n_chars``, where it is a column, follows the text."""
    columns = docs.columns
    found = scan(docs.select(F.struct(*[docs[c] for c in columns]).alias("all"), "text"), model)

    def step(at, s):
        piece = F.struct((s["start"] >= at).alias("cut"), at.alias("from"), s["start"].alias("to"))
        return F.struct(F.greatest(at, s["end"]).alias("state"), piece.alias("out"))

    def whole(wide):
        pieces = F.filter(scan_array(F.col("spans"), F.lit(0), step), lambda g: g["cut"])
        hexed = F.transform(pieces, lambda g: F.concat(F.hex(F.substring(wide, 4 * g["from"] + 1, 4 * (g["to"] - g["from"]))), F.lit(_wide_hex(mark))))
        rest = F.hex(F.substring(wide, 4 * F.array_max(F.transform("spans", lambda s: s["end"])) + 1, F.length(wide)))
        data = F.unhex(F.concat(F.lit(_wide_hex(".")), F.array_join(hexed, ""), rest))
        return F.substring(F.decode(data, WIDE), F.lit(2), F.lit(2**31 - 1))

    text = F.when(F.size("spans") > 0, let(F.encode("text", WIDE), whole)).otherwise(F.col("text"))
    values = {c: F.col("all").getField(c) for c in columns} | {"text": F.col("clean")}
    if "n_chars" in columns:
        values["n_chars"] = F.when(F.col("clean").isNotNull(), F.length("clean")).otherwise(values["n_chars"]).cast("long")
    return found.withColumn("clean", text).select([values[c].alias(c) for c in columns])

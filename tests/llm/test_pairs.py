"""Near-duplicates, joins, substrings and search against brute force, with the edge cases."""

import hashlib
import random

import numpy as np

from tidemark.llm import ann, jaccard, neardup, substrings

NAN, INF = float("nan"), float("inf")


def components(n, links):
    part = list(range(n))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        part[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def vectors():
    rng = np.random.default_rng(3)
    base = rng.standard_normal((120, 32))
    near = np.concatenate([base, base[:40] + 0.1 * rng.standard_normal((40, 32)), np.repeat(base[:2], 60, axis=0)]).astype(np.float32)
    return [(i, v.tolist(), 0) for i, v in enumerate(near)]


ODD = [(900, None, 0), (901, [0.0] * 32, 0), (902, [NAN] + [1.0] * 31, 0), (903, [INF] + [1.0] * 31, 0), (904, [], 0), (905, [None] + [1.0] * 31, 0), (906, [1.0, 2.0], 0), (None, [1.0] * 32, 0)]
SHAPE = "vec_id long, embedding array<float>, n long"


def test_embedding_links(spark):
    rows = vectors()
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    same = np.argwhere(np.triu(x @ x.T >= 0.9, 1))
    parts, links = components(len(rows), same.tolist()), (x @ x.T >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows + ODD, SHAPE)).collect()}
    assert len(got) == len(rows) + len(ODD)
    for i in range(len(rows)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i], parts[i], parts[i] == i)
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i, *_ in ODD if i)
    assert neardup.near_duplicates(spark.createDataFrame([], SHAPE)).count() == 0


def test_nearest_neighbours(spark):
    rows = vectors()
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame(rows + ODD, SHAPE)
    got = ann.search(frame, frame.where("vec_id % 10 = 0")).collect()
    hits = total = 0
    for q in range(0, len(rows), 10):
        s = x @ x[q]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and q not in {r["vec_id"] for r in mine}
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in mine)
        s[q] = -9
        hits, total = hits + len({r["vec_id"] for r in mine} & set(np.lexsort((np.arange(len(s)), -s))[:5].tolist())), total + 5
    assert hits / total >= 0.9
    few = spark.createDataFrame(rows[:3], SHAPE)
    assert ann.search(few, few.where("vec_id = 0")).count() == 2
    assert ann.search(few.limit(0), few.limit(0)).count() == 0


def documents():
    rng = random.Random(8)
    word = lambda: rng.choice(["Alpha", "beta", "gamma,", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randint(0, 60))
    out, passage = [], [word() for _ in range(60)]
    for n in (1, 3, 4, 5, 6, 8, 12, 30, 80, 200, 700, 1500):
        base = [word() for _ in range(n)]
        for edits in (0, 0, 1, 2, max(3, n // 60), max(4, n // 30), max(5, n // 10)):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(n)] = word()
            out.append(copy + (passage if n in (80, 200) else []))
    texts = [" ".join(w) for w in out] + ["x y " * 200, "", None, "Été   été", "a" * 100_000, " \t\n"]
    return [(i, t, "n") for i, t in enumerate(texts)]


def test_jaccard_components(spark):
    rows = documents()
    sets = []
    for _, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    parts = components(len(rows), links)
    frame = spark.createDataFrame(rows + [(0, rows[0][1], "again"), (None, rows[0][1], "no id")], "doc_id long, text string, n string").repartition(5)
    got = jaccard.components(frame).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), parts[r["doc_id"]])
    assert jaccard.components(frame.limit(0)).count() == 0


def test_repeated_windows(spark):
    rows, seen, want = documents(), set(), {}
    for i, t, _ in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            key = tuple(w[a : a + 20])
            if key in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(key)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        want[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    frame = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(frame).collect()}
    assert got == want
    twice = spark.createDataFrame([(1, "w " * 30, 0), (1, "w " * 30, 0), (None, "w " * 30, 0)], "doc_id long, text string, spans long")
    alone = substrings.remove_repeats(twice.limit(1)).first()["n_removed"]  # its own later windows
    assert sorted((r["doc_id"] or 9, r["n_removed"]) for r in substrings.remove_repeats(twice).collect()) == [(1, alone), (1, alone), (9, 30)]
    assert substrings.remove_repeats(frame.limit(0)).count() == 0


def test_reference_automata(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    reference = [text(300) for _ in range(3)] + [None]
    grams = {tuple(r.split()[j : j + 6]) for r in reference if r for j in range(len(r.split()) - 5)}
    docs = [text(200) for _ in range(10)] + [reference[0][20:90], "", None]
    want = []
    for t in docs:
        w = (t or "").split()
        gone = [False] * len(w)
        for a in range(len(w) - 5):
            if tuple(w[a : a + 6]) in grams:
                gone[a : a + 6] = [True] * 6
        want.append(t if not any(gone) else " ".join(x for x, g in zip(w, gone) if not g))
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = substrings.remove_reference(frame, spark.createDataFrame([(r,) for r in reference], "text string"), 6)
    assert [r["text"] for r in got.orderBy("doc_id").collect()] == want


def test_windows_are_equal_only_with_both_hashes():
    key, more = np.array([7, 7, 7, 9, 7], np.uint64), np.array([1, 2, 1, 1, 1], np.uint16)
    later = substrings._later(key, more, np.array([4, 1, 3, 2, 3]), np.array([0, 0, 5, 0, 5]))
    assert later.tolist() == [True, False, False, False, False]


def test_a_passage_in_many_batches(spark):
    """Documents that share a passage, in batches of a few rows, with repeated rows across them."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(30)]
    docs = [(500 - i if i % 3 else i, [f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(0, 40))], [f"v{i}"] * (i % 25)) for i in range(120)]
    rows = [(i, " ".join(a + passage + b)) for i, a, b in docs] + [(1000, " ".join(passage[:19])), (1001, None)]
    rows += [rows[7], rows[60]]
    seen, want = set(), {}
    for i, t in sorted(set(rows), key=lambda r: r[0]):
        w = (t or "").split()
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            gram = tuple(w[a : a + 20])
            if gram in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(gram)
        want[i] = sum(gone)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = [(r["doc_id"], r["n_removed"]) for r in substrings.remove_repeats(frame).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(rows) and dict(got) == want

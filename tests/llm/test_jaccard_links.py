"""The similarity join: every link between distinct sets, against brute force."""

from test_pairs import documents

from tidemark.llm import jaccard


def test_every_link_between_distinct_sets(spark):
    rows, sets = documents() + [(9000, "p q r s t u v", "n"), (9001, "p q r s t u v", "n")], {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        grams = frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
        if grams:
            sets[grams] = min(i, sets.get(grams, i))
    ids = list(sets.items())
    want = {(min(i, j), max(i, j)) for k, (x, i) in enumerate(ids) for y, j in ids[:k] if 100 * len(x & y) >= 80 * len(x | y)}
    frame = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(5)
    assert len(want) > 10
    got = [tuple(r) for r in jaccard.similar_sets(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want, (len(got), len(want))
    assert jaccard.similar_sets(frame.limit(0)).count() == 0

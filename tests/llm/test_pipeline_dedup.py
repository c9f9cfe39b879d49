"""The pipeline's near-duplicate stage: one row of each group stays, with repeated rows and null ids too."""

import corpus_pipeline


def test_one_row_of_each_group_stays(spark):
    text = lambda tag, edit="": " ".join(f"{tag}{i}" for i in range(100)) + edit
    rows = [(5, text("a")), (5, text("a")), (3, text("a", " more")), (None, text("a")), (None, text("b")), (None, text("b")), (None, text("c", " x")), (7, text("c")),
            (8, text("d")), (8, text("e")), (8, text("e", " y")), (9, ""), (9, ""), (10, None), (None, ""), (None, None), (11, text("f"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert got.columns == corpus_pipeline.COLUMNS
    key = lambda r: (r[0] is None, r[0] or 0, (r[1] or "")[:1], r[1] is None)
    kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=key)
    short = [(i, (t or "")[:1]) for i, t in kept]
    assert short == [(3, "a"), (7, "c"), (8, "d"), (8, "e"), (9, ""), (10, ""), (11, "f"), (None, ""), (None, ""), (None, "b")]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0

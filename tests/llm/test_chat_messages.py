"""Chat formatting: events reach the message of their number, also late or interleaved."""

from tidemark.llm import chat


def folded(spark, log):
    rows = chat.fold_and_render(spark.createDataFrame(log, chat.EVENTS).repartition(3)).collect()
    return {c: [chat.parse(r["formatted"])[0] for r in sorted(rows, key=lambda r: r["turn"]) if r["conv_id"] == c] for c in {e[0] for e in log}}


def test_late_events_and_interleaved_deltas(spark):
    log = [
        (1, 0, 10, "start", "user", ""), (1, 1, 10, "delta", "", "typo"), (1, 2, 20, "start", "assistant", ""), (1, 3, 20, "delta", "", "answer"),
        (1, 4, 10, "edit", "", "fixed"), (1, 5, 20, "delta", "", "ed"), (1, 6, 30, "start", "user", ""), (1, 7, 20, "regenerate", "", ""),
        (1, 8, 30, "delta", "", "thanks"), (1, 9, 20, "delta", "", "better"), (1, 10, 40, "start", "user", ""), (1, 11, 40, "delta", "", "gone"), (1, 12, 5, "start", "user", ""),
        (1, 13, 40, "delete", "", ""), (1, 14, 5, "delta", "", "last"),
        (2, 0, 1, "start", "assistant", ""), (2, 1, 2, "start", "assistant", ""), (2, 2, 1, "delta", "", "a"), (2, 3, 2, "delta", "", "x"), (2, 4, 1, "delta", "", "b"), (2, 5, 2, "delta", "", "y"),
        (None, 0, None, "start", "user", ""), (None, 1, None, "delta", "", "n"), (None, 2, 7, "start", "user", ""), (None, 3, None, "delta", "", "m"),
    ]
    assert folded(spark, log) == {
        1: [("user", "fixed"), ("assistant", "better"), ("user", "thanks"), ("user", "last")],
        2: [("assistant", "ab"), ("assistant", "xy")],
        None: [("user", "n"), ("user", "m")]}

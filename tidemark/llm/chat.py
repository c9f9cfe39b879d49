"""Chat formatting: rebuild final messages from an event log, render them with a loss mask.

A log row is (conv_id, seq, message, kind, role, text). ``start`` opens a message, ``delta``
appends to it, ``edit`` replaces its text, ``regenerate`` empties it for new deltas, ``delete``
drops it. Events act on the message of their number, wherever it stands in the log: the last one
started under it before them. Where there is none, or the number is null, they act on the message
started last. The log is partitioned by conversation, window functions find each event's start,
and sorted by start and sequence one pass folds it and holds only one message. Final messages
stand in the order of their starts.

Rendering: ``<|im_start|>role\\ntext<|im_end|>\\n``, where every ``<|`` inside a role or text is
written ``<|\\``, which ``unescape`` reverses exactly, and a newline inside a role ``<|n``. The
loss mask covers the escaped text of assistant messages, without markers.

A conversation is rendered as a row per turn, so no row grows with it; digests stream over the
turns in order. Defined cases: null texts and roles are empty; a null conv_id is a conversation
of its own; equal turns are ordered by role, then text; an empty table gives an empty result.
"""

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"
RENDERED = "conv_id long, turn long, formatted string, mask_from int, mask_to int"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """No ``<|`` followed by anything but a back-slash remains: ``<|`` becomes ``<|\\``."""
    return text.replace("<|", "<|\\")


def unescape(text: str) -> str:
    return text.replace("<|\\", "<|")


def render(role: str, text: str) -> tuple[str, int, int]:
    """One turn and the range of its text. The role's newlines are written ``<|n``."""
    head = OPEN + escape(role).replace("\n", "<|n") + "\n"
    body = escape(text)
    return head + body + CLOSE + "\n", len(head), len(head) + len(body)


TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of rendered text."""
    return [(unescape(role.replace("<|n", "\n")), unescape(body)) for role, body in TURN.findall(formatted)]


def as_events(conversations: DataFrame) -> DataFrame:
    """A conversation table as a log: each row is a started message with one delta.

    The turn is the sequence number; equal turns are told apart by a number for each row, so
    that rows which repeat stay two messages.
    """
    both = F.explode(F.array(F.lit("start"), F.lit("delta"))).alias("kind")
    rows = conversations.select("conv_id", F.col("turn").alias("seq"), F.monotonically_increasing_id().alias("message"),
                                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("*", both)


class Folder:
    """Folds the events of one message after another into final messages."""

    def __init__(self):
        self.key, self.turn, self.role, self.parts, self.open = object(), 0, "", [], False

    def take(self, conv, kind, role, text):
        """Yields the finished message, if the event ends one."""
        if conv != self.key:
            yield from self.finish()
            self.key, self.turn = conv, 0
        if kind == "start":
            yield from self.finish()
            self.role, self.parts, self.open = role or "", [], True
        elif kind == "delta":
            self.parts.append(text or "")
        elif kind == "edit":
            self.parts = [text or ""]
        elif kind == "regenerate":
            self.parts = []
        elif kind == "delete":
            self.parts, self.open = [], False
        else:
            raise ValueError(f"unknown event kind {kind!r}")

    def finish(self):
        if self.open:
            yield self.key, self.turn, self.role, "".join(self.parts)
            self.turn += 1
        self.open, self.parts = False, []


def fold_and_render(events: DataFrame, order: tuple[str, ...] = ("seq", "role", "text", "message")) -> DataFrame:
    """Rendered turns, sorted by conversation and turn within their partitions.

    ``events`` with a start and a delta per message at the same position sort as given by
    ``order`` with the kind last, ``start`` before all others.
    """
    rank = F.when(F.col("kind") == "start", 0).otherwise(1)
    running = lambda *by: Window.partitionBy(*by).orderBy(*order, "_k").rowsBetween(Window.unboundedPreceding, 0)
    placed = events.withColumn("_k", rank).repartition(F.col("conv_id"))
    placed = placed.withColumn("_last", F.sum(F.when(F.col("_k") == 0, 1).otherwise(0)).over(running("conv_id")))
    own = F.last(F.when((F.col("_k") == 0) & F.col("message").isNotNull(), F.col("_last")), ignorenulls=True).over(running("conv_id", "message"))
    placed = placed.withColumn("_start", F.coalesce(own, "_last")).sortWithinPartitions("conv_id", "_start", *order, "_k")

    def run(batches):
        folder = Folder()

        def out(messages):
            rows = [(conv, turn, *render(role, text)) for conv, turn, role, text in messages]
            return pd.DataFrame(rows, columns=["conv_id", "turn", "formatted", "mask_from", "mask_to"]).astype({"conv_id": "Int64"})

        for pdf in batches:
            done = []
            for conv, kind, role, text in zip(pdf["conv_id"], pdf["kind"], pdf["role"], pdf["text"]):
                done.extend(folder.take(None if pd.isna(conv) else int(conv), kind, role, text))
            if done:
                yield out(done)
        if last := list(folder.finish()):
            yield out(last)

    return placed.select("conv_id", "kind", "role", "text").mapInPandas(run, RENDERED)


def digest(rendered: DataFrame) -> DataFrame:
    """Reads rendered turns back, in the order of their partition, and sums each conversation up."""

    def run(batches):
        key, state = object(), None

        def row():
            n, turns, loss_chars, loss, chars = state
            return (key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

        def frame(rows):
            return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

        for pdf in batches:
            done = []
            for conv, text, low, high in zip(pdf["conv_id"], pdf["formatted"], pdf["mask_from"], pdf["mask_to"]):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or conv != key:
                    if state is not None:
                        done.append(row())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    if role == "assistant":
                        masked = unescape(text[low:high])
                        state[2] += len(masked)
                        state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if done:
                yield frame(done)
        if state is not None:
            yield frame([row()])

    return rendered.mapInPandas(run, DIGEST)

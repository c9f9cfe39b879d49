"""Counters and durations under fixed names, for writers, readers and maintenance."""

import time
from collections import Counter
from contextlib import contextmanager

# The names that writers and readers report under.
NAMES = (
    "writer.append", "writer.cut", "writer.flush", "writer.close", "writer.abort", "writer.retention", "writer.segment_finalize", "writer.segment_publish",
    "reader.head", "reader.read", "reader.fetch", "reader.timestamp_read", "reader.tail_next", "reader.catalog_refresh", "reader.segment_read",
)


class Metrics:
    """What happened on this driver; tasks report through Spark's own task metrics."""

    def __init__(self):
        self.counts, self.seconds = Counter(), Counter()

    def count(self, name: str, n: int = 1) -> None:
        if name not in NAMES:
            raise KeyError(name)
        self.counts[name] += n

    @contextmanager
    def timed(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.count(name)
            self.seconds[name] += time.perf_counter() - began

"""Streaming ingest: a stateful counter per partition assigns sequence numbers."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..errors import TimestampRegressionError

OUTPUT = "partition long, lsn long, timestamp_ms long, value binary"


class LsnAssigner(StatefulProcessor):
    """State per partition: the next number and the last timestamp. A regression is terminal."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("head", "next_lsn long, last_ms long")

    def handleInputRows(self, key, rows, timer_values):
        batch = pd.concat(list(rows)).sort_values(["timestamp_ms", "tiebreak"], kind="stable")
        following, last = self.state.get() if self.state.exists() else (0, None)
        if last is not None and batch["timestamp_ms"].iloc[0] < last:
            raise TimestampRegressionError(f"partition {key[0]}: {batch['timestamp_ms'].iloc[0]} after {last}")
        self.state.update((following + len(batch), int(batch["timestamp_ms"].iloc[-1])))
        yield pd.DataFrame({"partition": key[0], "lsn": range(following, following + len(batch)),
                            "timestamp_ms": batch["timestamp_ms"].to_numpy(), "value": batch["value"].to_numpy()})

    def close(self) -> None:
        pass


def assign_stream_lsn(rows: DataFrame) -> DataFrame:
    """``rows``: streaming partition, timestamp_ms, tiebreak, value. Needs the RocksDB state store."""
    return rows.groupBy("partition").transformWithStateInPandas(LsnAssigner(), OUTPUT, "append", "None")

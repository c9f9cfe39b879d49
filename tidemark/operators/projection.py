"""Typed projections of timelines: the documented route from opaque records to SQL tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def header(name: str, headers: str = "headers"):
    """The value of the first header called ``name``, as text."""
    hits = F.filter(headers, lambda h: h["key"] == F.encode(F.lit(name), "UTF-8"))
    return F.decode(F.try_element_at(hits, F.lit(1))["value"], "UTF-8")


def typed(records: DataFrame, payload_schema: str) -> DataFrame:
    """Parse the payload by an explicit schema; nothing is inferred."""
    return records.withColumn("payload", F.from_json(F.decode("value", "UTF-8"), payload_schema))


def latest_state(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The last record of each key, in (timestamp, partition, lsn) order."""
    at = F.struct("timestamp_ms", "partition", "lsn")
    return records.groupBy(key).agg(*[F.max_by(c, at).alias(c) for c in columns])


def write_columnar(records: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet by partition and sorted by lsn, so position and time predicates skip row groups."""
    (records.repartition("partition").sortWithinPartitions("partition", "lsn").write.partitionBy("partition").mode(mode).parquet(path))

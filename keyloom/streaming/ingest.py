"""Indexes and streams: keys that arrive as a stream are staged until they are complete; streams of probes look up a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from keyloom.operators.build import build
from keyloom.operators.index import Index


def stage(stream: DataFrame, staging: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Append a stream of keys to a staging table, exactly once; by default all that is there, then stop."""
    return stream.writeStream.format("parquet").option("path", staging).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def finish(spark: SparkSession, staging: str, total_keys: int | None = None, **options: object) -> Index:
    """Build the index of all staged keys; with total_keys, only if that many came."""
    return build(spark.read.parquet(staging), total_keys=total_keys, **options)


def probe(stream: DataFrame, index: Index, key: str = "key", payload: bool = False) -> DataFrame:
    """The stream with rank (and payload) and status: a stream-static join, stateless."""
    return index.lookup(stream, key, payload)

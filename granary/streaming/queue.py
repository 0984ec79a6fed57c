"""The queue's live views over an event stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, ``files`` a batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def live_progress(events: DataFrame, key: str) -> DataFrame:
    """Events of each key so far."""
    return events.groupBy(key).agg(F.count("*").alias("events"), F.max("event_id").alias("last_id"))


def first_only(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key; keys are forgotten once they are ``late``."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def live_heartbeats(beats: DataFrame) -> DataFrame:
    """(executor_id, updated_at): each worker's latest beat so far, one row a worker in the state."""
    return beats.groupBy("executor_id").agg(F.max("updated_at").alias("updated_at"))


def live_latest(events: DataFrame, keys: list[str], order: str, late: str | None = None, time: str | None = None) -> DataFrame:
    """The latest row of each key so far, by ``order``, in whatever order and however often rows come; one row a key in the state.

    With ``time`` (a timestamp among ``keys``' windows or the keys themselves) and ``late`` state older
    than the watermark is forgotten.
    """
    if time is not None and late is not None:
        events = events.withWatermark(time, late)
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_last")).select(*keys, "_last.*")


def each_batch(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Work off all there is, ``step`` (a batch's rows, its number) for each batch.

    A batch may come again after a failure, with the same number: steps write by number or by key.
    """
    q = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()

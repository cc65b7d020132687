"""Change batches as a stream: each micro-batch becomes one published generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..plans.engine import Engine
from ..schema import CHANGES


def change_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Change batches dropped as JSON files into a folder."""
    return spark.readStream.schema(CHANGES).json(folder)


def run_sync(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply each micro-batch; its id makes a replay harmless if ``apply`` keeps the last one it has published, as ``publish_stream`` does."""
    writer = changes.writeStream.foreachBatch(lambda df, batch: apply(df, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def publish_stream(changes: DataFrame, engine: Engine, repository_id: int, fresh: Callable[[DataFrame], DataFrame], name: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch of changes becomes one segment of the engine, exactly once: its number is committed with it under the stream's name, and a batch that has been committed publishes nothing when it is replayed.

    ``fresh`` gives the documents of a batch's changed paths as they are now.
    """
    return run_sync(changes, lambda df, batch: engine.sync(repository_id, df, fresh(df), batch=(name, batch)), checkpoint, once)


def windowed_outcomes(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests by outcome and tumbling window; events later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))

"""Resumed ingestion as a stream: the checkpoint of the stream is the completed set. Our addition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def ingest(spark: SparkSession, source: str, schema: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], sink: str, files_per_batch: int = 1000) -> StreamingQuery:
    """Processes the files of a folder not seen by this checkpoint yet, then stops; each batch is written once."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return transform(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start()

"""Incremental runs: a file stream that hands new files to a batch operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def on_new_files(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame, int], None], checkpoint: str, kind: str = "json") -> StreamingQuery:
    """Process files that came since the last run, once each, and stop; the checkpoint folder remembers what is done."""
    stream = spark.readStream.schema(schema).format(kind).load(folder)
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows per window of time and key; rows later than ``late`` are out."""
    from pyspark.sql import functions as F

    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count(F.lit(1)).alias("n"))

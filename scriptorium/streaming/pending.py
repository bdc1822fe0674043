"""An extension: keys that arrive as files, each handled once, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def handle_new(spark: SparkSession, folder: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], key: str = "url") -> None:
    """Hand the rows of new Parquet files, once per key, to `handle`, and return when none are left.

    Which files have been read stays in the checkpoint, as do the keys that have been seen.
    """
    rows = spark.readStream.schema(schema).parquet(folder).dropDuplicates([key])
    query = rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def counts_by_window(events: DataFrame, at: str, kind: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts of a kind by window of event time; rows later than `late` are left out of a stream."""
    from pyspark.sql import functions as F

    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")

"""Paragraphs that arrive over time: labels and counts by window, and the incremental upkeep of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators import panel


def arriving(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 16) -> DataFrame:
    """A stream of the Parquet files that appear in a folder, with the columns of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def group_counts(paragraphs: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, identity_type, n): paragraphs by window of loaded_at and identity; later ones than the watermark are left out.

    Repeated paragraph_ids count once within the watermark.
    """
    rows = paragraphs.withWatermark("loaded_at", late).dropDuplicatesWithinWatermark(["paragraph_id"])
    rows = panel.labelled(rows.withColumn("text", F.col("paragraph_text")).select("paragraph_id", "text", "loaded_at"))
    return rows.groupBy(F.window("loaded_at", window).alias("w"), panel.identity_type().alias("identity_type")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "identity_type", "n")


def keep_up(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs `apply` on what is there, batch by batch, and ends; a batch that was applied before its number was stored is applied again, so `apply` must not mind."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

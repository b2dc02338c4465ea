"""Revisions as a stream: changes per window with a bound on lateness. Beyond what batch reports need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_revisions(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder; a bounded number of files per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(folder)


def changes_per_window(revisions: DataFrame, *, at: str = "ts", op: str = "event_type", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Revisions per window and operation; rows later than the watermark are not counted."""
    return (
        revisions.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width), F.col(op).alias("op")).agg(F.count(F.lit(1)).alias("revisions"))
        .select(F.col("window.start").alias("since"), F.col("window.end").alias("until"), "op", "revisions")
    )


def first_seen(revisions: DataFrame, *, at: str = "ts", key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each revision once, however often it is delivered within the watermark."""
    return revisions.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])

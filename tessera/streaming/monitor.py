"""Run logs as streams: the success summary and windows of a growing folder of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPISODE = "task_id string, arm string, success boolean, calls int, at timestamp"


def read_log(spark: SparkSession, folder: str, schema: str = EPISODE, files_at_once: int = 100) -> DataFrame:
    """The log as a stream; so many new files a batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)


def success_windows(log: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, arm, episodes, successes, rate): by event time; rows later than ``late`` are left out."""
    out = log.withWatermark("at", late).groupBy(F.window("at", width), "arm").agg(F.count("*").alias("episodes"), F.count_if("success").alias("successes"))
    return out.select(F.col("window.start").alias("begin"), "arm", "episodes", "successes", F.try_divide(F.col("successes").cast("double"), F.col("episodes").cast("double")).alias("rate"))


def first_of_each(log: DataFrame, *keys: str, late: str = "1 hour") -> DataFrame:
    """The log with repeated keys taken once within the watermark."""
    return log.withWatermark("at", late).dropDuplicatesWithinWatermark(list(keys))


def write_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Starts the stream into a folder of parquet and runs it until what is there is done."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()

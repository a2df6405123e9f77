"""The log of model calls as a stream: files of JSON lines in, one row per call out, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ts timestamp, call_key string, ord long, event string, body string"


def read(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def calls(events: DataFrame) -> DataFrame:
    """(call_key, asked, prompt, response_at, response, attempts) of each call with a prompt; run in update or complete mode.

    State is one small row per call.
    """
    is_ = lambda e: F.col("event") == e
    at = F.when(is_("prompt"), F.col("ord"))
    rows = events.groupBy("call_key").agg(F.max(at).alias("asked"), F.max_by(F.when(is_("prompt"), F.col("body")), at).alias("prompt"), F.max(F.when(is_("response"), F.struct("ord", "body"))).alias("r"), F.count_if(is_("attempt")).alias("attempts"))
    return rows.where("asked is not null").select("call_key", "asked", "prompt", F.when(F.col("r.ord") > F.col("asked"), F.col("r.body")).alias("response"), "attempts")


def rates(events: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, event, n): events per window and kind; windows close when the watermark has passed them (append mode)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event", "n")

"""Progress events as a stream, and other streaming forms (extensions of the batch operators).

An event is a line: a prefix and a JSON object with ``event`` and a payload.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "__OCELLI_PROGRESS__ "
FIELDS = "event string, target_id string, processed long, total long, attempted long, live long, dead long, unknown long, ts timestamp"


def line(event: str, **payload) -> str:
    """One event as a line."""
    return PREFIX + json.dumps({"event": event} | payload, sort_keys=True, default=str)


def parsed(value: Column, prefix: str = PREFIX) -> Column:
    """The event of a line, or null for other output."""
    return F.when(value.startswith(prefix), F.from_json(F.substr(value, F.lit(len(prefix) + 1)), FIELDS))


def events(spark: SparkSession, path: str, prefix: str = PREFIX) -> DataFrame:
    """Events of a folder of log files, as they come."""
    return spark.readStream.text(path).select(parsed(F.col("value"), prefix).alias("e")).filter("e IS NOT NULL").select("e.*")


def latest(df: DataFrame) -> DataFrame:
    """Furthest progress of each target and event; works on streams (update mode) and on tables."""
    done = F.max("processed")
    return df.groupBy("target_id", "event").agg(done.alias("processed"), F.max("total").alias("total"), F.max("live").alias("live"), F.max("dead").alias("dead"), F.max("unknown").alias("unknown"), F.floor(10 * done / F.nullif(F.max("total"), F.lit(0))).cast("int").alias("decile"))


def windowed(df: DataFrame, time: str = "ts", width: str = "5 minutes", late: str = "10 minutes", *keys: str) -> DataFrame:
    """Counts by time window and keys; rows later than ``late`` are dropped by the watermark."""
    return df.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def refreshed(samples: DataFrame) -> DataFrame:
    """Freshness of images: each sample against the one before (``stream_url, sampled_at, etag, last_modified, body_sha``)."""
    from pyspark.sql import Window

    from ..functions.status import images_differ

    cols = F.struct("etag", "last_modified", "body_sha")
    w = Window.partitionBy("stream_url").orderBy("sampled_at")
    return samples.withColumn("_now", cols).withColumn("_before", F.lag("_now").over(w)).filter("_before IS NOT NULL").select("stream_url", "sampled_at", images_differ(F.col("_before"), F.col("_now")).alias("refreshed"))

"""Streaming operators as queries: the events table as a stream, with the same answers in SQL.

A stream hands on what its watermark has passed, so the SQL leaves out the spans that
end after the last event less the allowed lateness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import query
from .streaming import state

HOUR = 3_600_000
#: A span of an hour has closed: its end isn't after the watermark, both in milliseconds.
CLOSED = f"((epoch_us(ts) // {HOUR}000) + 1) * {HOUR} <= (SELECT max(epoch_ms(ts)) FROM events) - {HOUR}"
MOMENT, MOMENT_SQL = "yyyy-MM-dd HH:mm:ss.SSSSSS", "%Y-%m-%d %H:%M:%S.%f"

SAMPLES = {
    "stream_url": "'https://m.example/' || user_id || '.jpg'",
    "etag": "CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'view' THEN '' ELSE 'e' || (user_id % 3 + event_id % 2) END",
    "last_modified": "CASE WHEN event_id % 3 = 0 THEN event_type END",
    "body_sha": "CASE WHEN event_id % 5 > 0 THEN 's' || (event_id % 2) END",
}


def stores(spark: SparkSession, d: str) -> int:
    return state.stores(spark, spark.read.parquet(f"{d}/events.parquet"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as it arrives; the pattern finds a file as well as a folder, which a plain path as a stream doesn't."""
    return spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "WITH s AS (SELECT event_id, ts, " + ", ".join(f"{v} AS {k}" for k, v in SAMPLES.items()) + " FROM events), "
    "p AS (SELECT *, lag(event_id) OVER w AS before, lag(etag) OVER w AS b_etag, lag(last_modified) OVER w AS b_modified, lag(body_sha) OVER w AS b_sha FROM s WINDOW w AS (PARTITION BY stream_url ORDER BY ts, etag, last_modified, body_sha)) "
    f"SELECT stream_url, strftime(ts, '{MOMENT_SQL}') AS sampled_at, (coalesce(b_etag <> '' AND etag <> '' AND b_etag <> etag, false) OR coalesce(b_modified <> '' AND last_modified <> '' AND b_modified <> last_modified, false) OR b_sha IS DISTINCT FROM body_sha) AS refreshed "
    f"FROM p WHERE before IS NOT NULL AND {CLOSED}"
)
def sample_refreshes(spark: SparkSession, d: str) -> DataFrame:
    """X-05 as a stream: each image sample against the one before."""
    samples = events(spark, d).select(F.col("ts").alias("sampled_at"), *[F.expr(v).alias(k) for k, v in SAMPLES.items()])
    done = state.settled(spark, state.refreshed(samples, "1 hour", "1 hour"), "refreshes", stores(spark, d))
    return done.withColumn("sampled_at", F.date_format("sampled_at", MOMENT))


@query(
    "WITH e AS (SELECT 't' || (user_id % 7) AS target_id, event_type AS event, ts, CASE WHEN event_id % 11 > 0 THEN event_id END AS processed, CASE WHEN event_id % 4 > 0 THEN 4000 + user_id END AS total FROM events), "
    f"s AS (SELECT target_id, event, epoch_us(ts) // {HOUR}000 AS span, coalesce(max(processed), -1) AS p, coalesce(max(total), 0) AS n FROM e WHERE {CLOSED} GROUP BY 1, 2, 3), "
    "r AS (SELECT target_id, event, span, max(p) OVER w AS processed, max(n) OVER w AS total FROM s WINDOW w AS (PARTITION BY target_id, event ORDER BY span)), "
    "g AS (SELECT *, CASE WHEN total > 0 THEN least(10, greatest(-1, floor(10 * processed / total))) ELSE -1 END AS reached FROM r), "
    "m AS (SELECT *, coalesce(max(reached) OVER (PARTITION BY target_id, event ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before FROM g) "
    f"SELECT target_id, event, strftime(make_timestamp(span * {HOUR}000), '{MOMENT_SQL}') AS span_start, processed::BIGINT AS processed, total::BIGINT AS total, reached::INTEGER AS decile FROM m WHERE reached > before"
)
def decile_reports(spark: SparkSession, d: str) -> DataFrame:
    """X-02, X-04 as a stream: when a target's progress reaches each new tenth of its total."""
    made = events(spark, d).selectExpr("'t' || (user_id % 7) AS target_id", "event_type AS event", "ts", "CASE WHEN event_id % 11 > 0 THEN event_id END AS processed", "CASE WHEN event_id % 4 > 0 THEN 4000 + user_id END AS total")
    done = state.settled(spark, state.deciles(made, "1 hour", "1 hour"), "deciles", stores(spark, d))
    return done.withColumn("span_start", F.date_format("span_start", MOMENT))

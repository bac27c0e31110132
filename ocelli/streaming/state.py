"""Streams that remember earlier rows of a key: freshness pairs and decile reports.

Both go in two steps.  A windowed aggregation gathers a key's rows by spans of event
time and, in append mode, hands a span on once the watermark has passed its end; so a
key with a large share of all rows is split by time, counted before the shuffle, and
rows may arrive in any order within ``late``.  Spans then come in order of time, and a
state of one row a key links each to those before it, one row a span.  Python is called
once for a bucket of many URLs, as a call costs more than the rows of most of them.

Rows that come after their span was handed on, or without a time, are left out.  Spans
that the watermark hasn't passed wait in the checkpoint; a query that starts again
from it goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.status import images_differ

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SHUFFLES = "spark.sql.shuffle.partitions"
#: Bytes of input for each store of a stateful step.
STORE_BYTES = 64 << 20
#: Buckets of URLs, each of which is one call of Python a batch; a checkpoint keeps those of its first start.
BUCKETS = 4096
#: Moments are kept as microseconds.
SAMPLE = "sampled_at long, etag string, last_modified string, body_sha string"


def by_span(df: DataFrame, time: str, span: str, late: str, keys: list[str], *aggs) -> DataFrame:
    """One row for each key and closed span, with ``w``, the span."""
    return df.withWatermark(time, late).groupBy(*keys, F.window(time, span).alias("w")).agg(*aggs)


def stateful(df: DataFrame, keys: list[str], processor: StatefulProcessor, out: str) -> DataFrame:
    """A processor over closed spans; its session needs the RocksDB state store, which is set here."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return df.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "None")


class Links(StatefulProcessor):
    """The last sample of each span with the first one of the next; nulls are kept as they are.

    A call gets the spans of all URLs of a bucket and links them at once; the last sample of
    each URL is an entry of the bucket's map, read and written once a batch.
    """

    SIDES = tuple([f"{side}_{c}" for c in ("at", "etag", "modified", "sha")] for side in ("first", "last"))
    OUT = tuple(f"{p}_{c}" for p in "bn" for c in ("at", "etag", "modified", "sha"))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "stream_url string", SAMPLE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        spans = pd.concat(list(rows), ignore_index=True).astype({"stream_url": object})
        code = pd.factorize(spans["stream_url"])[0]  # -1 without a URL
        order = np.lexsort((spans["opened"].to_numpy(), code))
        spans, code = spans.iloc[order], code[order]
        opens = np.concatenate(([True], code[1:] != code[:-1]))
        url = spans["stream_url"].where(code >= 0, None).to_numpy()
        first, last = (spans[side].astype(object).where(spans[side].notna(), None).to_numpy() for side in self.SIDES)
        before = np.empty_like(last)
        before[1:] = last[:-1]
        linked = ~opens
        for i in np.flatnonzero(opens):
            known = self.last.getValue((url[i],))
            if known is not None:
                before[i], linked[i] = tuple(known), True
        for i in np.flatnonzero(np.append(opens[1:], True)):
            self.last.updateValue((url[i],), tuple(last[i]))
        found = pd.DataFrame(np.hstack((before, first))[linked], columns=self.OUT)
        found.insert(0, "stream_url", url[linked])
        yield found

    def close(self) -> None:
        pass


def refreshed(samples: DataFrame, span: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``progress.refreshed`` for a stream of ``stream_url, sampled_at, etag, last_modified, body_sha``.

    Samples of one moment are ordered by their other columns.  Rows without a URL are a key of their own.
    """
    sample = F.struct(F.unix_micros("sampled_at").alias("sampled_at"), "etag", "last_modified", "body_sha")
    within = by_span(samples, "sampled_at", span, late, ["stream_url"], F.array_sort(F.collect_list(sample)).alias("all"))
    pairs = within.select("stream_url", F.explode(F.arrays_zip(F.slice("all", 1, F.size("all") - 1).alias("before"), F.slice("all", 2, F.size("all")).alias("now"))).alias("p")).select("stream_url", "p.before", "p.now")
    ends = by_span(samples, "sampled_at", span, late, ["stream_url"], F.min(sample).alias("first"), F.max(sample).alias("last"))
    bucket = F.pmod(F.xxhash64("stream_url"), F.lit(BUCKETS)).cast("int").alias("bucket")
    flat = ends.select(bucket, "stream_url", F.col("w.start").alias("opened"), *[F.col(f"{side}.{c}").alias(f"{side}_{n}") for side in ("first", "last") for c, n in (("sampled_at", "at"), ("etag", "etag"), ("last_modified", "modified"), ("body_sha", "sha"))])
    out = "stream_url string, " + ", ".join(f"{p}_at long, {p}_etag string, {p}_modified string, {p}_sha string" for p in "bn")
    links = stateful(flat, ["bucket"], Links(), out)
    side = lambda p: F.struct(F.col(f"{p}_at").alias("sampled_at"), F.col(f"{p}_etag").alias("etag"), F.col(f"{p}_modified").alias("last_modified"), F.col(f"{p}_sha").alias("body_sha"))
    both = pairs.unionByName(links.select("stream_url", side("b").alias("before"), side("n").alias("now")))
    return both.select("stream_url", F.timestamp_micros("now.sampled_at").alias("sampled_at"), images_differ(F.col("before"), F.col("now")).alias("refreshed"))


class Rises(StatefulProcessor):
    """Spans in which a key's decile rises above all before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reached = handle.getValueState("reached", "processed long, total long, decile int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        processed, total, decile = self.reached.get() if self.reached.exists() else (-1, 0, -1)
        found = []
        for r in pd.concat(list(rows)).sort_values("opened").itertuples(index=False):
            processed, total = max(processed, int(r.processed)), max(total, int(r.total))
            now = min(10, 10 * processed // total) if total > 0 else -1
            if now > decile:
                decile = now
                found.append((*key, r.opened, processed, total, decile))
        self.reached.update((processed, total, decile))
        yield pd.DataFrame(found, columns=["target_id", "event", "span_start", "processed", "total", "decile"])

    def close(self) -> None:
        pass


def deciles(events: DataFrame, span: str = "1 minute", late: str = "1 minute") -> DataFrame:
    """A report for each span in which the progress of a target's event reaches a new tenth of its total.

    Progress is the largest ``processed`` so far over the largest ``total`` so far, at most
    10 tenths; without a total above 0 there is none.  Nulls count as nothing seen.
    """
    seen = lambda c, without: F.coalesce(F.max(c), F.lit(without)).cast("long").alias(c)
    spans = by_span(events, "ts", span, late, ["target_id", "event"], seen("processed", -1), seen("total", 0))
    flat = spans.select("target_id", "event", F.col("w.start").alias("opened"), "processed", "total")
    out = "target_id string, event string, span_start timestamp, processed long, total long, decile int"
    return stateful(flat, ["target_id", "event"], Rises(), out)


def settle(stream: DataFrame, path: str, checkpoint: str, partitions: int | None = None) -> DataFrame:
    """Runs a stream over all that has arrived, appends its rows to a table at ``path``, and reads that.

    Called again with the same folders it takes what has arrived since.  ``partitions`` is
    the number of stores that each stateful step is dealt to, the session's number of
    shuffle partitions if not given; a checkpoint keeps that of its first start.
    """
    conf = stream.sparkSession.conf
    usual = conf.get(SHUFFLES)
    if partitions:
        conf.set(SHUFFLES, partitions)
    try:  # a query takes the settings of its start
        done = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(SHUFFLES, usual)
    done.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def stores(spark: SparkSession, arrived: DataFrame) -> int:
    """How many stores to deal a stateful step to, by the size of what has arrived.

    Each store opens and commits a database of its own in every batch, whether rows come
    to it or not, so a small table in the session's number of stores spends its time on
    empty ones.  One for each core at least, and the session's number at most.
    """
    size = int(str(arrived._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(int(spark.conf.get(SHUFFLES)), max(spark.sparkContext.defaultParallelism, size // STORE_BYTES)))


def settled(spark: SparkSession, stream: Callable[[], DataFrame] | DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """``settle`` with folders of its own in the shared folder."""
    import uuid

    from ..staging import folder

    own = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    return settle(stream() if callable(stream) else stream, f"{own}/rows", f"{own}/checkpoint", partitions)

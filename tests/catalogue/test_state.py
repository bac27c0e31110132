"""Streams with state against the same rules over whole tables: any order of arrival, restarts, late rows."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from ocelli.streaming import progress, state

SAMPLES = "stream_url string, sampled_at timestamp, etag string, last_modified string, body_sha string"
EVENTS = "target_id string, event string, processed long, total long, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def feed(spark, folder, schema, batches, make, tmp):
    """Rows of ``make`` after each batch has arrived as files and the stream has started again."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(2).write.mode("append").parquet(folder)
        out = state.settle(make(spark.readStream.schema(schema).parquet(folder)), f"{tmp}/rows", f"{tmp}/checkpoint")
    return out


def samples(n, rng):
    return [(rng.choice(["hot"] * 6 + ["a", "b", None]), T0 + dt.timedelta(seconds=rng.randrange(40_000)), rng.choice(["x", "y", "", None]), rng.choice(["m", None]), rng.choice(["s", None])) for _ in range(n)]


def test_freshness_in_any_order_and_over_restarts(spark, tmp_path):
    rng = random.Random(5)
    rows = [("hot", T0, None, None, None)] + list({(r[0], r[1]): r for r in samples(400, rng)}.values())
    rows = list({(r[0], r[1]): r for r in rows}.values())
    rows.sort(key=lambda r: r[1].timestamp() + rng.random() * 3_000)
    batches = [rows[:150], rows[150:151], rows[151:]]
    got = feed(spark, str(tmp_path / "in"), SAMPLES, batches, lambda s: state.refreshed(s, "20 minutes", "1 hour"), tmp_path)
    mark = max(r[1] for r in rows) - dt.timedelta(hours=1)
    whole = progress.refreshed(spark.createDataFrame(rows, SAMPLES)).filter(F.window("sampled_at", "20 minutes").end <= F.lit(mark))
    key = lambda r: (str(r.stream_url), r.sampled_at, r.refreshed)
    assert sorted(map(key, got.collect())) == sorted(map(key, whole.collect())) and got.count() > 200


def test_late_and_timeless_samples_are_left_out(spark, tmp_path):
    at = lambda h: T0 + dt.timedelta(hours=h)
    batches = [[("u", at(0), "a", None, None), ("u", at(1), "b", None, None), ("u", at(9), "c", None, None)], [("u", at(0.5), "z", None, None), ("u", None, "n", None, None), ("u", at(20), "d", None, None)]]
    got = feed(spark, str(tmp_path / "in"), SAMPLES, batches, lambda s: state.refreshed(s, "1 hour", "1 hour"), tmp_path)
    assert sorted((r.sampled_at, r.refreshed) for r in got.collect()) == [(at(1), True), (at(9), True)]


def test_deciles_over_restarts(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"t{rng.randrange(3)}", rng.choice(["probe", "fetch"]), rng.choice([None, rng.randrange(0, 10 + k)]), rng.choice([None, 0, 600]), T0 + dt.timedelta(seconds=20 * k)) for k in range(600)]
    end = [("x", "end", 1, 1, T0 + dt.timedelta(days=1))]
    batches = [rng.sample(rows[:200], 200), rng.sample(rows[200:], 400), end]
    got = feed(spark, str(tmp_path / "in"), EVENTS, batches, lambda s: state.deciles(s, "1 minute", "10 minutes"), tmp_path)
    want, seen = [], {}
    for k in range(0, 600, 3):  # three rows a minute
        for key in sorted({r[:2] for r in rows[k : k + 3]}):
            p, n, d = seen.get(key, (-1, 0, -1))
            mine = [r for r in rows[k : k + 3] if r[:2] == key]
            p, n = max([p] + [r[2] for r in mine if r[2] is not None]), max([n] + [r[3] for r in mine if r[3] is not None])
            now = min(10, 10 * p // n) if n > 0 else -1
            if now > d:
                want.append((*key, rows[k][4], p, n, now))
            seen[key] = (p, n, max(d, now))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 15


def test_empty_streams(spark, tmp_path):
    none = spark.createDataFrame([], EVENTS)
    none.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    assert state.settle(state.deciles(stream), str(tmp_path / "rows"), str(tmp_path / "c")).count() == 0


def test_stores_follow_the_size_of_the_input(spark, monkeypatch):
    rows = spark.createDataFrame([("t", "e", 1, 2, T0)] * 50, EVENTS)
    usual = int(spark.conf.get(state.SHUFFLES))
    cores = spark.sparkContext.defaultParallelism
    assert state.stores(spark, rows) == min(usual, cores)
    monkeypatch.setattr(state, "STORE_BYTES", 1)
    assert state.stores(spark, rows) == usual


def test_settle_leaves_the_session_as_it_was(spark, tmp_path):
    spark.createDataFrame([("t", "e", 1, 2, T0), ("t", "e", 2, 2, T0 + dt.timedelta(hours=9))], EVENTS).write.parquet(str(tmp_path / "in"))
    usual = spark.conf.get(state.SHUFFLES)
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    assert state.settle(state.deciles(stream), str(tmp_path / "rows"), str(tmp_path / "c"), 2).count() == 1
    assert spark.conf.get(state.SHUFFLES) == usual
    assert len(list((tmp_path / "c" / "state" / "0").glob("[0-9]*"))) == 2


def test_one_call_links_the_spans_of_many_urls():
    """A bucket's URLs share calls, whatever the order and the cuts of their rows, and each is read and written once a batch."""

    class Entries(dict):
        calls = 0

        def getMapState(self, *_):  # noqa: N802
            return self

        def getValue(self, key):  # noqa: N802
            self.calls += 1
            return self.get(key)

        def updateValue(self, key, value):  # noqa: N802
            self.calls += 1
            self[key] = value

    rng, entries, links, found = random.Random(3), Entries(), state.Links(), []
    links.init(entries)
    ends = ["at", "etag", "modified", "sha"]
    names = ["bucket", "stream_url", "opened", *[f"first_{c}" for c in ends], *[f"last_{c}" for c in ends]]
    urls = [None, *[f"u{k}" for k in range(40)]]
    spans = [(7, u, pd.Timestamp(T0) + pd.Timedelta(hours=h), 10 * h, rng.choice([None, "a"]), None, "s", 10 * h + 9, rng.choice([None, "b"]), "m", None) for h in range(12) for u in urls if rng.random() < 0.6]
    for batch in (spans[:200], spans[200:]):
        rows, entries.calls = rng.sample(batch, len(batch)), 0
        for out in links.handleInputRows((7,), iter([pd.DataFrame(rows[:9], columns=names), pd.DataFrame(rows[9:], columns=names)]), None):
            found += [tuple(None if pd.isna(v) else v for v in r) for r in out.itertuples(index=False)]
        assert entries.calls == 2 * len({r[1] for r in rows})
    want = []
    for u in urls:
        own = [r for r in spans if r[1] == u]
        want += [(u, *a[7:], *b[3:7]) for a, b in zip(own, own[1:])]
    assert sorted(found, key=repr) == sorted(want, key=repr) and len(want) > 200


def test_freshness_with_all_urls_in_one_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "BUCKETS", 1)
    test_freshness_in_any_order_and_over_restarts(spark, tmp_path)

"""Error rows, a run's explanation, and coordinates near a URL at the edges of their stretch."""

import re

from pyspark.sql import functions as F

from ocelli.operators import extract, summarize
from ocelli.operators.policy import Rule
from ocelli.plans.harvest import PAYLOADS, failures


def payload(k, url, status, kind, body):
    return (k, url, url, "GET", kind, status, body, None, None)


def test_error_rows(spark):
    rows = [
        payload(0, "https://a.example/1", 503, "text/html", None),
        payload(1, "https://a.example/2", 200, "application/json", "{broken"),
        payload(2, "https://a.example/3", None, "application/json; charset=utf-8", "[1]"),
        payload(3, "https://a.example/4", 200, None, None),
        payload(4, "https://a.example/5", 200, "text/html", ""),
        payload(5, "https://bad.example/6", 404, "text/html", "x"),
        payload(6, None, 404, None, None),
    ]
    df = spark.createDataFrame(rows, PAYLOADS)
    got = lambda *a: {tuple(r) for r in failures(*a).collect()}
    want = {
        ("source_fetch_error", "https://a.example/1", "HTTP status 503"), ("row_extraction_error", "https://a.example/2", "not JSON"), ("row_extraction_error", "https://a.example/4", "no body"),
        ("source_fetch_error", None, "HTTP status 404"),
    }
    assert got(df) == want | {("source_fetch_error", "https://bad.example/6", "HTTP status 404")}
    assert got(df, [Rule("bad.example")]) == want
    told = df.filter("_ord IN (2, 4)").withColumn("error", F.when(F.col("_ord") == 2, " timed out ").otherwise(""))
    assert got(told) == {("source_fetch_error", "https://a.example/3", "timed out")}
    assert got(df.limit(0)) == set()


def test_explanation(spark):
    rows = [("hls_regex", None, 1.0, 2.0), ("harvest_handoff", {"media_type": "hls", "source_provider": "p"}, None, None), (None, {"media_type": "", "harvest_input": "true"}, 1.0, None)]
    df = spark.createDataFrame(rows, "discovery_method string, metadata map<string,string>, lat double, lon double")
    got = {(r.dimension, r.key): r.n for r in summarize.explained(df).collect()}
    assert got == {
        ("media_type", "unknown"): 2, ("media_type", "hls"): 1, ("source_provider", "hls_regex"): 1, ("source_provider", "p"): 1, ("source_provider", "unknown"): 1,
        ("origin", "native"): 1, ("origin", "harvest"): 2, ("coordinates", "present"): 1, ("coordinates", "missing"): 2,
    }
    assert summarize.explained(df.limit(0)).isEmpty()


def test_points_at_the_ends_of_the_stretch():
    url = "https://m.example/a.m3u8"
    for gap in range(470, 505):
        for text, stretch in ((url + " " * gap + "12.345, -6.789", slice(0, len(url) + 500)), ("12.345, -6.789" + " " * gap + url, slice(max(0, 14 + gap - 500), None))):
            near = re.search(r"(\d+\.\d{3,}), (-\d+\.\d{3,})", text[stretch])
            found = next(extract.near_text(text, "https://a.example/", ["hls"]))
            assert (found["lat"], found["lon"]) == ((float(near[1]), float(near[2])) if near else (None, None)), gap

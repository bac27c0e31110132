"""URL and media expressions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from ocelli.functions import media as M
from ocelli.functions import url as U
from ocelli.functions.pyfuncs import decoded_variants, is_private, private_host, url_join
from ocelli.operators import extract as X


def values(spark, items, *cols):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(items)], "k int, v string")
    return [tuple(r)[1:] for r in df.select("k", *cols).orderBy("k").collect()]


CANONICAL = [
    ("HTTPS://MEDIA.EXAMPLE/cam.m3u8#frag", "https://media.example/cam.m3u8"),
    ("https://media.example:443/a.jpg", "https://media.example/a.jpg"),
    ("http://media.example:80/a.jpg?x=1", "http://media.example/a.jpg?x=1"),
    ("http://media.example:8080/a.jpg", "http://media.example:8080/a.jpg"),
    ("https://media.example/a.m3u8\\\"),", "https://media.example/a.m3u8"),
    (r"\/\/media.example\/D3\/99_East.stream\/playlist.m3u8", "https://media.example/D3/99_East.stream/playlist.m3u8"),
    (r"https://source.example/path/\/\/media.example\/cam.m3u8", "https://media.example/cam.m3u8"),
    ("https://user:pw@Media.example/x.mjpg", "https://user:pw@media.example/x.mjpg"),
    ("rtsp://CAM.example:554/live", "rtsp://cam.example:554/live"),
    ("", ""),
    (None, ""),
]


def test_canonical_urls(spark):
    got = values(spark, [a for a, _ in CANONICAL], U.canonical(F.col("v")))
    assert [g[0] for g in got] == [b for _, b in CANONICAL]
    assert [X.canonical(a or "") for a, _ in CANONICAL] == [b for _, b in CANONICAL]
    again = values(spark, [b for _, b in CANONICAL], U.canonical(F.col("v")))
    assert [g[0] for g in again] == [b for _, b in CANONICAL]


def test_structured_canonical_drops_the_user(spark):
    assert values(spark, ["https://u:p@M.example:443/a.jpg#x"], U.canonical_structured(F.col("v"))) == [("https://m.example/a.jpg",)]
    assert X.canonical("https://u:p@M.example:443/a.jpg#x", trailers=False) == "https://m.example/a.jpg"


MEDIA = [
    ("https://a.example/x.m3u8", "", "hls"),
    ("https://a.example/x.M3U8?t=1", "", "hls"),
    ("rtsp://a.example/1", "", "rtsp"),
    ("https://a.example/x.mjpg", "", "mjpeg"),
    ("https://a.example/x.mp4", "", "video_file"),
    ("https://a.example/x.jpeg?y", "", "image_snapshot"),
    ("https://a.example/hello", "media", "stream"),
    ("https://a.example/stream/1", "", "stream"),
    ("https://a.example/page", "", None),
    ("ftp://a.example/x.m3u8", "", None),
]


def test_classification(spark):
    df = spark.createDataFrame([(k, u, key) for k, (u, key, _) in enumerate(MEDIA)], "k int, u string, key string")
    rows = df.select("k", M.classify(F.col("u"), F.col("key")), M.classify_structured(F.col("u"), F.col("key"))).orderBy("k").collect()
    assert [r[1] for r in rows] == [m for _, _, m in MEDIA] == [X.media_kind(u, key) for u, key, _ in MEDIA]
    assert rows[2][2] is None and X.media_kind("rtsp://a.example/1", rtsp=False) is None


def test_media_filter(spark):
    cases = [("hls", "https://x.example/a.m3u8"), ("video_file", "https://x.example/a.mp4"), ("image_snapshot", "https://x.example/a.jpg"), ("stream", "https://x.example/stream"), ("rtsp", "rtsp://x.example/1")]
    df = spark.createDataFrame(cases, "m string, u string")
    kept = lambda tokens: {r.m for r in df.filter(M.MediaFilter(tokens).matches(F.col("m"), F.col("u"))).collect()}
    assert kept(".m3u8,mp4") == {"hls", "video_file"}
    assert kept(["image", "stream"]) == {"image_snapshot", "stream", "rtsp"}
    assert kept("all") == kept([]) == {c[0] for c in cases}
    with pytest.raises(ValueError, match="unsupported"):
        M.MediaFilter("gif")


def test_effective_types_differ(spark):
    df = spark.createDataFrame([("", "https://x.example/a")], "d string, u string")
    row = df.select(*[f(F.col("d"), F.col("u")) for f in (M.type_for_caps, M.type_for_priority, M.type_for_playlists, M.type_for_records)]).first()
    assert tuple(row) == ("image_snapshot", "unknown", "unknown_media", "unknown_media")


def test_assets_and_thumbnails(spark):
    urls = ["https://x.example/static/og-default.png", "https://x.example/thumb/1.jpg", "https://x.example/cams/12.jpg", "https://x.example/a_preview-1.jpg", "https://x.example/default.jpg"]
    got = values(spark, urls, M.looks_like_page_asset(F.col("v")), M.looks_like_thumbnail(F.col("v")))
    assert got == [(True, False), (True, True), (False, False), (True, True), (True, False)]
    assert [(X.is_page_asset(u), X.is_thumbnail(u)) for u in urls] == got


def test_field_roles(spark):
    df = spark.createDataFrame([(1, "currentimageurl", "image_snapshot"), (2, "referenceimage12updatesagourl", "image_snapshot"), (3, "foo", "hls"), (4, "foo", "other")], "k int, a string, m string")
    assert [r[1] for r in df.select("k", M.field_role(F.col("a"), F.col("m"))).orderBy("k").collect()] == ["current_image_snapshot", "reference_image_snapshot", "hls_stream", "unknown_media"]


def test_image_filters(spark):
    base = {"title": None, "description": None, "location_text": None, "camera_id": None, "asset_role": None, "asset_field": None, "field_path": None, "discovery_method": None, "camera_record_id": None, "lat": None, "lon": None, "in_service": None, "current_image_update_frequency": None, "reference_image_update_frequency": None, "metadata": None}
    rows = [
        base | {"k": 1, "url": "https://x.example/logo.png", "media_type": "image_snapshot"},
        base | {"k": 2, "url": "https://x.example/i/7.jpg", "media_type": "image_snapshot", "asset_role": "current_image_snapshot", "camera_record_id": "cam:1"},
        base | {"k": 3, "url": "https://x.example/i/8.jpg", "media_type": "image_snapshot"},
        base | {"k": 4, "url": "https://x.example/logo.m3u8", "media_type": "hls"},
    ]
    schema = "k int, url string, media_type string, title string, description string, location_text string, camera_id string, asset_role string, asset_field string, field_path string, discovery_method string, camera_record_id string, lat double, lon double, in_service boolean, current_image_update_frequency string, reference_image_update_frequency string, metadata map<string,string>"
    df = spark.createDataFrame(rows, schema)
    reason = lambda mode: {r.k: r[1] for r in df.select("k", M.image_removal_reason(mode)).collect()}
    assert reason("raw") == dict.fromkeys(range(1, 5))
    assert reason("exclude-page-assets") == {1: "page_asset_evidence", 2: None, 3: None, 4: None}
    assert reason("camera-evidence") == {1: "missing_camera_image_evidence", 2: None, 3: "missing_camera_image_evidence", 4: None}
    with pytest.raises(ValueError):
        M.image_removal_reason("best")


def test_redaction_and_ids(spark):
    urls = ["https://u:p@h.example/a?token=1&x=2&my_secret_id=3&e", "https://h.example/a#f", "https://h.example/cams/sr99_nb_at_5thst/playlist.m3u8"]
    got = values(spark, urls, U.redacted(F.col("v")), U.camera_id(F.col("v")))
    assert got[0][0] == "https://***:***@h.example/a?token=%2A%2A%2A&x=2&my_secret_id=%2A%2A%2A&e=" and got[1][0] == "https://h.example/a#f"
    assert got[2][1] == "sr99_nb_at_5thst" == X.url_stem(urls[2])
    name = values(spark, urls, U.road_name(F.col("v")))[2][0]
    assert "SR 99" in name and "NB" in name


def test_expanded_endpoints(spark):
    urls = ["https://g.example/arcgis/MapServer", "https://g.example/arcgis/FeatureServer/3?x=1", "https://g.example/q/query", "https://g.example/x.json"]
    got = [r[0] for r in values(spark, urls, U.expanded_endpoints(F.col("v")))]
    assert [len(g) for g in got] == [9, 2, 2, 1]
    assert got[0][8] == "https://g.example/arcgis/MapServer/7/query?where=1%3D1&outFields=*&returnGeometry=true&f=json" and got[2][1].endswith("/q/query?where=1%3D1&outFields=*&returnGeometry=true&f=json")


def test_python_functions(spark):
    hosts = ["http://10.0.0.1/x", "http://[::1]/x", "http://localhost/x", "http://cam.local/x", "http://93.184.216.34/x", "http://a.example/x", "nohost", "http://169.254.1.1/", "", None]
    want = [True, True, True, True, False, False, True, True, False, False]
    assert [is_private(h) for h in hosts] == want
    assert [r[0] for r in values(spark, hosts, private_host(F.col("v")))] == want
    df = spark.createDataFrame([("https://a.example/d/p.html", "../x.jpg"), ("https://a.example/d/", "?q=1"), ("https://a.example", "//b.example/y")], "b string, l string")
    assert [r[0] for r in df.select(url_join("b", "l")).collect()] == ["https://a.example/x.jpg", "https://a.example/d/?q=1", "https://b.example/y"]
    assert decoded_variants("a%2520b&amp;") == [("raw", "a%2520b&amp;"), ("html_unescaped", "a%2520b&"), ("url_decoded", "a%20b&amp;"), ("double_url_decoded", "a b&amp;")]

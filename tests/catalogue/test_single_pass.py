"""Records are merged and places enriched without computing their input several times."""

from pyspark.sql import functions as F

from ocelli.operators import merge, scope

ROWS = "_ord long, url string, media_type string, title string, source_url string, metadata map<string,string>, lat double"


def test_records_are_read_once(spark):
    rows = [
        (3, "https://a.example/x.m3u8#f", "hls", None, "s2", {"k": "3", "n": "late"}, 2.0),
        (1, "HTTPS://A.example/x.m3u8", "unknown_media", "", "s1", {"k": "", "e": "[]", "m": "1"}, None),
        (2, "https://a.example/x.m3u8", "stream", "two", "s1", None, 1.0),
        (4, "https://a.example/x.m3u8", "hls", "four", "", {"k": "4", "m": "4"}, None),
        (5, "https://b.example/", None, None, None, None, None),
    ]

    def seen(batches):
        yield from batches

    df = spark.createDataFrame(rows, ROWS).repartition(3).mapInArrow(seen, ROWS)
    out = merge.merge_harvest_records(df)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {r.url: r for r in out.collect()}
    a, b = got["https://a.example/x.m3u8"], got["https://b.example/"]
    assert (a._ord, a.media_type, a.title, a.source_url, a.lat, a.duplicate_sources) == (1, "stream", "two", "s1", 1.0, ["s2"])
    assert a.metadata == {"m": "1", "k": "3", "n": "late"} and next(iter(a.metadata)) == "m"  # in the order of rows
    assert (b._ord, b.media_type, b.title, b.source_url, b.metadata, b.duplicate_sources) == (5, "unknown_media", None, None, {}, [])
    assert out.columns == ["_ord", "url", "media_type", "title", "source_url", "metadata", "lat", "duplicate_sources"]
    assert out.filter(F.col("url").isNull()).isEmpty()


def test_places_are_looked_for_once_and_only_where_asked(spark):
    """Queries of places are made for rows without coordinates, in one branch of the plan; the answers are as before."""
    box = "struct<min_lat:double,max_lat:double,min_lon:double,max_lon:double>"
    targets = spark.createDataFrame([("t", 0, "T", "Town, Land", "place", "Region", "Land", "Town", "traffic", None, None, False, "review_only")], f"target_id string, target_index int, target_label string, canonical_target string, scope_type string, admin_region string, country string, place_name string, camera_type string, bbox {box}, polygons {scope.POLYGONS}, bbox_verified boolean, trust_policy string")
    rows = [(1, "https://h/a.m3u8", None), (2, "https://h/b.m3u8?x=7.5&y=3.5&y=9", None), (3, "https://h/c.m3u8", 1.0), (4, "https://h/d.m3u8", None), (5, "https://h/e.m3u8?lat=95&lon=1", None)]
    df = spark.createDataFrame(rows, "_ord long, stream_url string, lat double").selectExpr("*", "lat AS lon", "'t' AS target_id", "'' AS source_url", "'' AS title", "'5th St' AS location_text", "map() :: map<string,string> AS metadata", "array() :: array<string> AS reasons", "cast(null AS string) AS coordinate_source")
    answers = spark.createDataFrame([("5th St, Town, Land, Region, Land", 5.0, 6.0, "x")], "query string, lat double, lon double, display_name string")
    out = scope.enriched(df, targets, answers, 2)
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        assert out._jdf.queryExecution().optimizedPlan().toString().count("AS _g_first#") == 1
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    got = {r._ord: (r.lat, r.lon, r.coordinate_source, r.geocoded_query) for r in out.collect()}
    asked = (5.0, 6.0, "candidate_geocoder", "5th St, Town, Land, Region, Land")
    assert got == {1: asked, 2: (3.5, 7.5, "candidate_metadata", None), 3: (1.0, 1.0, None, None), 4: asked, 5: (None, None, None, None)}

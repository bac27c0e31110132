"""Split reading of GeoJSON against json.load: tiny splits, strings with braces, members beside the features."""

import json
import random

import pytest

from ocelli.sources.features import read_features
from ocelli.sources.files import read_geojson


def feature(rng, k):
    name = "".join(rng.choice(["{", "}", '"', "\\", "[", "]", ":", ",", "a", "é", "\n", '"features":[']) for _ in range(rng.randrange(12)))
    shape = {"type": "Point", "coordinates": [k / 4, -k / 8]} if k % 3 else {"type": "LineString", "coordinates": [[k, 1], [2, 3]]}
    return {"type": "Feature", "properties": {"name": name, "k": str(k)}, "geometry": shape}


def want(path):
    out = []
    with open(path) as f:
        found = json.load(f)["features"]
    for k, v in enumerate(x for x in found if isinstance(x, dict)):
        c = v["geometry"]["coordinates"]
        point = [float(x) if isinstance(x, (int, float)) else None for x in c]
        out.append((k, v["geometry"]["type"], point[0], point[1], v["properties"]))
    return out


@pytest.mark.parametrize("split", [100, 1 << 20])
def test_same_as_json_load(spark, tmp_path, split):
    rng = random.Random(split)
    members = {"type": "FeatureCollection", "name": 'a "features":[ } {', "crs": {"type": "name", "properties": {"name": "x}"}}}
    whole = {
        "a": members | {"features": [feature(rng, k) for k in range(40)], "links": [{"href": "{"}, {"href": "y"}], "more": {"features": [{"type": "Feature"}]}},
        "b": {"features": [feature(rng, k) for k in range(7)], "type": "FeatureCollection"},
        "c": {"type": "FeatureCollection", "links": [{"a": 1}], "features": [None, feature(rng, 1), 3, feature(rng, 2)]},
    }
    for name, value in whole.items():
        (tmp_path / f"{name}.geojson").write_text(json.dumps(value, indent=2 if name == "b" else None, ensure_ascii=False))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        rows = read_features(spark, *[str(tmp_path / f"{n}.geojson") for n in whole]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name in whole:
        got = sorted((r.feature_ord, r.geometry_type, r.lon, r.lat, r.properties) for r in rows if r.source_geojson.endswith(f"/{name}.geojson"))
        assert got == want(tmp_path / f"{name}.geojson"), name


def test_files_without_features(spark, tmp_path):
    texts = {"empty": "", "none": '{"type":"FeatureCollection","features":[]}', "one": '{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{}}', "list": "[1, 2]", "cut": '{"features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"a":"b"}},{"type":"Fea'}
    texts |= {"short": texts["cut"].split(',{"type":"Fea')[0], "open": texts["cut"].split(',{"type":"Fea')[0] + "]", "good": texts["cut"].split(',{"type":"Fea')[0] + "]}", "line": texts["cut"].split(',{"type":"Fea')[0] + "]}\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.geojson").write_text(text)
    rows = read_features(spark, *[str(tmp_path / f"{n}.geojson") for n in texts]).collect()
    assert [(r.feature_ord, r.lon, r.lat, r.properties) for r in rows] == [(0, 1.0, 2.0, {"a": "b"})] * 2
    assert {r.source_geojson.rsplit("/", 1)[1] for r in rows} == {"good.geojson", "line.geojson"}


def test_large_files_are_read_in_splits(spark, tmp_path, monkeypatch):
    from ocelli.sources import files

    rng = random.Random(1)
    path = tmp_path / "x.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [None] + [feature(rng, k) for k in range(20)]}))
    key = lambda df: sorted((r.feature_ord, r.geometry_type, r.lon, r.lat, r.properties) for r in df.collect())
    whole = key(read_geojson(spark, str(path)))
    monkeypatch.setattr(files, "WHOLE", 10)
    assert key(read_geojson(spark, str(path))) == whole and len(whole) == 20

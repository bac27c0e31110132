"""Handoffs of a harvest, and GeoJSON files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import read_features

ASSETS = "array<struct<asset_id:string,camera_record_id:string,url:string,media_url:string,media_type:string,asset_role:string,asset_field:string,source_url:string,source_endpoint_url:string,source_page_url:string,source_provider:string,source_name:string,discovery_method:string,json_record_path:string,field_path:string,title:string,location_text:string,coordinate_source:string,lat:string,lon:string,metadata:string>>"
RECORD = (
    "camera_record_id string, camera_id string, url string, media_type string, title string, description string, location_text string, lat string, lon string, coordinate_source string, direction string, "
    "bearing string, heading string, orientation string, in_service string, status string, date string, time string, timestamp string, last_updated string, last_refresh string, image_description string, "
    "current_image_update_frequency string, reference_image_update_frequency string, source_url string, source_endpoint_url string, source_page_url string, source_provider string, source_name string, "
    f"json_record_path string, asset_id string, asset_role string, asset_field string, field_path string, metadata string, media_assets {ASSETS}"
)
# Scopes of a manifest, and the artifacts that they stand for.
URL_SCOPES = ("filtered_media_records", "final_media_records")


def default_artifact(files: dict, media_filter: list[str], scope: str | None) -> str:
    """Which artifact of a manifest to load: as its scope says, else URLs for a real media filter, else the inventory, else URLs."""
    urls, inventory = "camera_urls_jsonl" if files.get("camera_urls_jsonl") else None, "harvest_camera_inventory" if files.get("harvest_camera_inventory") else None
    narrow = bool(media_filter) and {m.strip().lower() for m in media_filter} not in ({"all"}, {"*"})
    order = [urls if scope in URL_SCOPES else None, inventory if scope == "structured_inventory_records" else None, urls if narrow else None, inventory, urls]
    found = next((a for a in order if a), None)
    if not found:
        raise ValueError("the manifest names no artifact that can be loaded")
    return found


def string_list(value) -> list[str]:
    items = value if isinstance(value, list) else str(value or "").split(",")
    return [str(x).strip() for x in items if str(x).strip()]


def read_handoff(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Records of a manifest's artifact, a JSON list, or JSON lines, and what was loaded.

    A line that isn't JSON fails the read; lines that aren't objects are left out.
    """
    head = spark.read.text(path, wholetext=True).first()[0].lstrip()
    info: dict = {"source_path": path, "schema_version": None, "media_filter": [], "handoff_default_scope": None, "loaded_artifact": None}
    if path.endswith(".json") and head[:1] == "{":
        manifest = json.loads(head)
        info |= {"schema_version": manifest.get("schema_version"), "media_filter": string_list(manifest.get("media_filter")), "handoff_default_scope": manifest.get("handoff_default_scope")}
        files = manifest.get("files") or {}
        info["loaded_artifact"] = default_artifact(files, info["media_filter"], info["handoff_default_scope"])
        path = path.rsplit("/", 1)[0] + "/" + files[info["loaded_artifact"]]
        info["source_file"] = path
    if path.endswith(".json"):
        return spark.read.schema(RECORD).option("mode", "FAILFAST").option("multiLine", True).json(path).withColumn("_ord", F.monotonically_increasing_id()), info
    lines = spark.read.text(path).filter("trim(value) <> ''").withColumn("_ord", F.monotonically_increasing_id())
    # FAILFAST on the text itself, so that a bad line raises and a scalar one is dropped.
    objects = lines.filter(F.ltrim("value").startswith("{") | F.try_parse_json("value").isNull())
    parsed = objects.select("_ord", F.from_json("value", RECORD, {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*", "_ord"), info


#: Bytes up to which a GeoJSON file is read as one row; larger ones are read by splits, to the same rows.
WHOLE = 16_000_000
FEATURES = "struct<type:string,features:array<struct<type:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>>"


def read_geojson(spark: SparkSession, *paths: str) -> DataFrame:
    """Features of some files: ``source_geojson, feature_ord, geometry_type, lon, lat, properties``."""
    if not spark.read.format("binaryFile").load(list(paths)).filter(F.col("length") > WHOLE).isEmpty():
        return read_features(spark, *paths)
    files = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("source_geojson"), F.from_json("value", FEATURES).alias("c"))
    rows = files.select("source_geojson", F.posexplode(F.filter("c.features", lambda f: f.isNotNull())).alias("feature_ord", "f"))
    at = lambda k: F.get_json_object("f.geometry.coordinates", f"$[{k}]").try_cast("double")
    return rows.select("source_geojson", "feature_ord", F.col("f.geometry.type").alias("geometry_type"), at(0).alias("lon"), at(1).alias("lat"), F.col("f.properties").alias("properties"))


def pick_geojson(spark: SparkSession, trusted: str, untrusted: str) -> str:
    """The trusted file where it exists, else the other."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(trusted)
    return trusted if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where) else untrusted

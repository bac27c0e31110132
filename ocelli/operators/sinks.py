"""Outputs: tables, lines, playlists, GeoJSON, inventories.

Distributed frames are written by Spark's writers.  A file that must be one
(a playlist, a manifest) is one partition of short lines, written as text.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import coerce as N
from ..functions import geo as G
from ..functions import media as M
from ..functions import status as S
from ..functions import url as U
from ..functions.pyfuncs import private_host
from ..functions.text import first_nonblank, stable_id, text
from ..staging import Stage
from .policy import Rule, block_reason
from .scope import with_target

# Columns of the URL table, in order.
URL_COLUMNS = (
    "url", "media_url", "media_type", "asset_id", "asset_role", "asset_field", "field_path", "camera_record_id", "camera_id", "title", "description", "location_text", "lat", "lon",
    "coordinate_source", "direction", "bearing", "heading", "orientation", "in_service", "status", "date", "time", "timestamp", "last_updated", "last_refresh", "image_description",
    "current_image_update_frequency", "reference_image_update_frequency", "source_url", "source_endpoint_url", "source_page_url", "source_provider", "source_name", "discovery_method",
    "json_record_path", "metadata",
)
# Names that a refresh rate may have, in order.
RATE_KEYS = (
    "camera_refresh_rate", "refresh_rate_seconds", "refresh_rate", "refresh_interval", "refresh_interval_seconds", "update_interval", "update_interval_seconds", "currentImageUpdateFrequency",
    "referenceImageUpdateFrequency", "currentimageupdatefrequency", "referenceimageupdatefrequency", "updateFrequency", "update_frequency", "image_snapshot_refresh_delay_seconds",
    "map_refresh_rate_seconds",
)
PLACE_KEYS = ("location", "location_text", "intersection", "cross_street", "road", "route", "direction", "city", "county", "district", "camera_name")


def meta(*keys: str) -> Column:
    """The first non-empty of some metadata."""
    return F.coalesce(*[F.nullif(F.try_element_at("metadata", F.lit(k)), F.lit("")) for k in keys])


def sorted_json(m: Column) -> Column:
    """A map as a JSON object with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def refresh_rate() -> Column:
    return meta(*RATE_KEYS)


def map_refresh_seconds(default: float) -> Column:
    return F.coalesce(N.refresh_seconds(refresh_rate()), F.lit(float(default)))


def location_display(target: bool = False) -> Column:
    own = [F.col("location_text"), meta("location_display"), F.col("geocoded_display_name"), *[meta(k) for k in PLACE_KEYS], F.col("title")]
    return first_nonblank(*own, *([F.col("t_canonical_target"), F.col("t_target_label")] if target else []), limit=100000)


def url_table(records: DataFrame) -> DataFrame:
    cols = {c: F.col(c) if c in records.columns else F.lit(None).cast("string") for c in URL_COLUMNS}
    cols["media_url"] = F.col("url")
    cols["metadata"] = sorted_json(F.col("metadata"))
    return records.select(*[v.alias(k) for k, v in cols.items()])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_urls_by_type(records: DataFrame, path: str) -> None:
    """URLs as text, in one folder for each media type."""
    records.select("media_type", F.col("url").alias("value")).write.mode("overwrite").partitionBy("media_type").text(path)


def write_by_target(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("target_id").json(path)


#: Lines of a list that is written as one file; longer ones are files in order.
ONE_FILE = 1_000_000


def write_text(lines: DataFrame, path: str, *order: str) -> None:
    """Lines (``value``) in order: one file for lists that people and players read, several in the order of their names beyond ``ONE_FILE`` lines."""
    short = lines.limit(ONE_FILE + 1).count() <= ONE_FILE
    done = lines.orderBy(*order).select("value")
    (done.coalesce(1) if short else done).write.mode("overwrite").text(path)


def write_json(spark, value: dict, path: str) -> None:
    """A small object with sorted keys."""
    text_ = json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, default=str)
    spark.createDataFrame([(text_,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def one_row(df: DataFrame) -> dict:
    """A one-row summary as a dictionary."""
    row = df.first()
    return row.asDict(True) if row else {}


# --- inventories ------------------------------------------------------------

FLAGS = {"source_provided_only": True, "validated": False, "geocoded": False, "scope_filtered": False, "trusted": False, "llm_reviewed": False}


def flagged(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in FLAGS.items()})


def camera_inventory(cameras: DataFrame) -> DataFrame:
    return flagged(cameras)


def url_inventory(records: DataFrame) -> DataFrame:
    """URL records as cameras of one asset each; ids from the URL where there are none."""
    asset = F.struct(
        F.coalesce(F.nullif(F.col("asset_id"), F.lit("")), stable_id("asset", F.col("url"))).alias("asset_id"), "url", "media_type", "asset_role", "asset_field", "field_path"
    )
    own = ("camera_id", "title", "description", "location_text", "lat", "lon", "coordinate_source", "direction", "bearing", "heading", "orientation", "in_service", "status", "date", "time", "timestamp", "last_updated", "last_refresh", "image_description", "current_image_update_frequency", "reference_image_update_frequency", "source_endpoint_url", "source_page_url", "source_provider", "source_name", "json_record_path", "metadata")
    return flagged(records.select(F.coalesce(F.nullif(F.col("camera_record_id"), F.lit("")), stable_id("url", F.col("url"))).alias("camera_record_id"), *[F.col(c) if c in records.columns else F.lit(None).cast("string").alias(c) for c in own], F.array(asset).alias("media_assets")))


def inventory(cameras: DataFrame, records: DataFrame) -> DataFrame:
    """Cameras, and the URL records of no camera."""
    rest = records.join(cameras.select("camera_record_id"), "camera_record_id", "left_anti")
    return camera_inventory(cameras).unionByName(url_inventory(rest), allowMissingColumns=True)


# --- tables and GeoJSON of candidates ------------------------------------------


def candidate_table(df: DataFrame, default_delay: float = 2.0) -> DataFrame:
    """Candidates that aren't rejected, for reading."""
    c = F.col
    kind = meta("media_type")
    return df.filter("trust_level IS NULL OR trust_level <> 'rejected'").select(
        F.coalesce(F.nullif(c("title"), F.lit("")), meta("source_name"), F.lit("Camera candidate")).alias("name"),
        "target_label",
        "location_text",
        location_display().alias("location_display"),
        *[meta(*k).alias(k[0]) for k in (("camera_type",), ("raw_camera_type",), ("camera_id", "id"), ("route", "road"), ("direction",), ("city",), ("county",), ("district", "region"), ("owner",), ("agency",), ("json_endpoint_url",), ("json_record_path",), ("json_record_schema_hint",))],
        "stream_url",
        "source_url",
        c("lat").alias("latitude"),
        c("lon").alias("longitude"),
        "coordinate_source",
        "geocoded_query",
        "geocoded_display_name",
        meta("snapshot_url", "thumbnail_url", "image_url").alias("thumbnail_url"),
        refresh_rate().alias("camera_refresh_rate"),
        F.when(kind == "image_snapshot", map_refresh_seconds(default_delay)).alias("map_refresh_rate_seconds"),
        kind.alias("media_type"),
        *[c(k) for k in ("protocol_label", "media_family", "protocol_confidence", "camera_evidence_score", "camera_evidence_band", "why_candidate_mattered", "candidate_priority_bucket") if k in df.columns],
        "trust_level",
        "validation_status",
        "scope_status",
        "discovery_method",
        (~F.coalesce(c("trust_level") == "trusted", F.lit(False))).alias("review_required"),
        "target_id",
        F.array_join("reasons", "; ").alias("reasons"),
    )


def features(df: DataFrame, targets: DataFrame, trusted: bool, default_delay: float = 2.0) -> DataFrame:
    """One GeoJSON feature (``value``) for each located candidate."""
    both = with_target(df.filter("lat IS NOT NULL AND lon IS NOT NULL"), targets)
    kind = F.coalesce(meta("media_type"), F.when(F.lower("stream_url").contains(".m3u8"), "hls"))
    snapshot = F.coalesce(meta("snapshot_url", "thumbnail_url", "image_url"), F.when(kind == "image_snapshot", F.col("stream_url")))
    delay = F.when(kind == "image_snapshot", map_refresh_seconds(default_delay))
    props = {
        "name": F.coalesce(F.nullif(F.col("title"), F.lit("")), meta("source_name"), F.lit("Camera candidate")),
        "location_display": location_display(True),
        **{k[0]: meta(*k) for k in (("camera_type",), ("raw_camera_type",), ("camera_id", "id"), ("camera_name",), ("route", "road"), ("direction",), ("intersection",), ("cross_street",), ("city",), ("county",), ("district", "region"), ("camera_status",), ("owner",), ("agency",), ("json_endpoint_url",), ("json_record_path",))},
        "media_type": kind,
        "snapshot_url": snapshot,
        "thumbnail_url": snapshot,
        "camera_refresh_rate": refresh_rate(),
        "map_refresh_rate_seconds": delay,
        "stream_url": F.col("stream_url"),
        "source_url": F.col("source_url"),
        "scope_status": F.col("scope_status"),
        "validation_status": F.col("validation_status"),
        "trust_level": F.lit("trusted") if trusted else F.coalesce("trust_level", F.lit("untrusted")),
        "output_policy": F.lit("trusted" if trusted else "review_only"),
        "review_required": F.lit(not trusted),
        "untrusted_reason": F.lit(None).cast("string") if trusted else S.untrusted_reason(F.col, F.coalesce("t_bbox_verified", F.lit(True))),
        "target_bbox_trusted": F.coalesce("t_bbox_verified", F.lit(False)),
        "target_id": F.col("target_id"),
        "target_label": F.col("target_label"),
    }
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    return both.select("_ord", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*[v.alias(k) for k, v in props.items()]).alias("properties"))).alias("value"))


def target_features(targets: DataFrame) -> DataFrame:
    """Geometry of verified targets: the polygon, else the box; unverified ones give a last fallback."""
    rings = F.transform("polygons", lambda p: F.transform(p, lambda r: F.transform(r, lambda x: F.array(x["lon"], x["lat"]))))
    role = F.when(F.col("bbox_verified") & (F.size("polygons") > 0), "primary").when(F.col("bbox_verified"), "fallback").otherwise("last_fallback")
    shape = F.when(role == "primary", F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), rings.alias("coordinates")))).otherwise(G.box_geometry(F.col("bbox")))
    return targets.filter("bbox IS NOT NULL OR size(polygons) > 0").select("target_id", role.alias("role"), shape.alias("geometry"))


def markdown_rows(df: DataFrame, *cols: str) -> DataFrame:
    cell = lambda c: F.replace(F.regexp_replace(text(F.col(c)), r"[\r\n]+", " "), F.lit("|"), F.lit("\\|"))
    return df.select("_ord", F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in cols]), F.lit(" |")).alias("value"))


def feature_rows(feats: DataFrame) -> DataFrame:
    """Features of ``sources.files.read_geojson`` as table rows."""
    p = lambda *ks: F.coalesce(*[F.nullif(F.try_element_at("properties", F.lit(k)), F.lit("")) for k in ks])
    web = lambda k: F.when(p(k).rlike("^(?:https?://|data:)"), p(k))
    return feats.select(
        "source_geojson",
        "feature_ord",
        F.coalesce(p("name", "title", "camera_name", "source_name"), F.format_string("Camera %d", F.col("feature_ord") + 1)).alias("name"),
        p("target_label", "target_id").alias("target_label"),
        p("location_display", "location_text", "geocoded_display_name", "source_scope_hint").alias("location_text"),
        p("camera_type", "type", "category").alias("camera_type"),
        p("camera_id", "id").alias("camera_id"),
        p("media_type").alias("media_type"),
        F.coalesce(p("lat").try_cast("double"), F.col("lat")).alias("latitude"),
        F.coalesce(p("lon").try_cast("double"), F.col("lon")).alias("longitude"),
        *[p(k).alias(k) for k in ("stream_url", "source_url")],
        F.coalesce(*[web(k) for k in ("thumbnail_url", "snapshot_url", "image_url", "thumbnail", "preview_url", "poster")]).alias("thumbnail_url"),
        *[p(k).alias(k) for k in ("trust_level", "validation_status", "scope_status", "discovery_method", "review_required", "target_id", "output_policy")],
    )


# --- playlists ----------------------------------------------------------------

PLAYABLE = ("hls", "rtsp", "mjpeg", "stream", "video_file")
TEXT_ONLY = ("dead_or_restricted_media", "image_snapshots", "harvested_image_snapshots")


def eligible(df: DataFrame, rules: list[Rule], url: str = "stream_url") -> DataFrame:
    """Rows with a URL that is neither blocked nor of a private host.

    Only names that may be an address or a local name go to Python, as a column that is null
    elsewhere; rows stay where they are, so those without such a name don't meet in one task.
    """
    open_ = df.filter((text(F.col(url)) != "") & block_reason(F.col(url), rules).isNull())
    u, where = F.col(url), U.authority(F.col(url))
    doubtful = U.host(u).rlike(r"^[0-9.]*$|(?:^|\.)(?:localhost|localdomain|local)\.?$") | ~where.rlike(r"^[A-Za-z0-9._~%!$&()*+,;=:@-]*$")
    marked = open_.withColumn("_where", F.when(doubtful, F.when(where == "", u).otherwise(F.concat(F.lit("x://"), where))))
    return marked.filter(~private_host(F.col("_where"))).select(*df.columns)


def playlist_rows(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Candidates (with ``is_trusted, is_review``) once for each playlist that they are in, each URL and target once a list."""
    kind = M.type_for_playlists(meta("media_type"), F.col("stream_url"))
    state = S.bucket(F.col("validation_status"))
    playable = kind.isin(*PLAYABLE)
    lists = {
        "trusted_media": F.col("is_trusted") & playable,
        "untrusted_review_media": F.col("is_review") & playable,
        "hls_candidates": kind == "hls",
        "rtsp_candidates": kind == "rtsp",
        "live_or_reachable_media": (state == "live") & playable,
        "dead_or_restricted_media": state.isin("dead", "restricted"),
        "image_snapshots": kind == "image_snapshot",
    }
    return _listed(eligible(df, rules), lists)


def harvest_playlist_rows(records: DataFrame, rules: list[Rule]) -> DataFrame:
    kind = M.type_for_playlists(F.col("media_type"), F.col("stream_url"))
    lists = {"harvested_media": kind.isin(*PLAYABLE), "harvested_hls": kind == "hls", "harvested_rtsp": kind == "rtsp", "harvested_image_snapshots": kind == "image_snapshot"}
    own = records.withColumnRenamed("url", "stream_url").withColumn("target_id", F.lit(None).cast("string"))
    return _listed(eligible(own, rules), lists)


def _listed(df: DataFrame, lists: dict[str, Column]) -> DataFrame:
    names = F.filter(F.array(*[F.when(cond, F.lit(n)) for n, cond in lists.items()]), lambda n: n.isNotNull())
    from .merge import first_seen

    spread = df.select("*", F.explode(names).alias("playlist"))
    return first_seen(spread, "playlist", U.without_fragment(F.col("stream_url")), "target_id")


def m3u_text(c: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.replace(text(c), F.lit('"'), F.lit("'")), r"\s+", " ")), 1, 300)


def title_of_row() -> Column:
    own = F.coalesce(F.nullif(F.trim(text(F.col("title"))), F.lit("")), meta("camera_name", "name"), F.nullif(F.trim(text(F.col("location_text"))), F.lit("")), meta("location_display", "camera_id"))
    return m3u_text(F.coalesce(own, F.nullif(U.redacted_user(F.col("stream_url")), F.lit("")), F.lit("Camera")))


def m3u_lines(rows: DataFrame, group: str | None = None) -> DataFrame:
    """Lines of each playlist: header, then a title and a URL for each row."""
    title = title_of_row()
    label = F.lit(group) if group else F.col("playlist")
    line = F.concat(F.lit('#EXTINF:-1 tvg-name="'), title, F.lit('" group-title="'), m3u_text(label), F.lit('",'), title)
    body = rows.select("playlist", "_ord", F.posexplode(F.array(line, F.col("stream_url"))).alias("k", "value"))
    # Before all rows: -1, or null where the order is a struct.
    kind = rows.schema["_ord"].dataType
    before = F.lit(-1).cast(kind) if isinstance(kind, NumericType) else F.lit(None).cast(kind)
    head = rows.select("playlist").distinct().select("playlist", before.alias("_ord"), F.lit(0).alias("k"), F.lit("#EXTM3U").alias("value"))
    return head.unionByName(body)


def playlist_files(rows: DataFrame, names: tuple[str, ...], group: str | None = None) -> DataFrame:
    """The lines of all files (``file, _ord, k, value``): a text file for each list, and an M3U file but for those of ``TEXT_ONLY``.

    A list's header stands before its rows, under a null ``_ord``; it is there for a list without rows as well.
    """
    title, url = title_of_row(), F.col("stream_url")
    label = F.lit(group) if group else F.col("playlist")
    entry = F.concat(F.lit('#EXTINF:-1 tvg-name="'), title, F.lit('" group-title="'), m3u_text(label), F.lit('",'), title)
    at = lambda end, k, v: F.struct(F.concat("playlist", F.lit(end)).alias("file"), F.lit(k).alias("k"), v.alias("value"))
    plain = F.array(at(".txt", 1, url))
    lines = F.when(F.col("playlist").isin(*TEXT_ONLY), plain).otherwise(F.concat(plain, F.array(at(".m3u", 1, entry), at(".m3u", 2, url))))
    body = rows.filter(F.col("playlist").isin(*names)).select("_ord", F.explode(lines).alias("l")).select("l.file", "_ord", "l.k", "l.value")
    heads = [(f"{n}.m3u", 0, "#EXTM3U") for n in names if n not in TEXT_ONLY]
    head = rows.sparkSession.createDataFrame(heads, "file string, k int, value string")
    return head.select("file", F.lit(None).cast(rows.schema["_ord"].dataType).alias("_ord"), "k", "value").unionByName(body)


def write_playlists(rows: DataFrame, path: str, names: tuple[str, ...], group: str | None = None) -> dict[str, int]:
    """Playlists as M3U and text; lists of images and of dead links as text only.  Returns their sizes.

    All files come from one range sort by file and order.  A list of up to ``ONE_FILE`` lines
    is one key, so one file; a longer one is cut by its order into several, in the order of
    their names.  The rows are stored once, as sizes, ranges and lines read them.  Tasks write
    to a folder beside the lists, whose subfolders then take the lists' names.  Rows without a
    list of ``names`` are left out; an empty list has an empty text folder.
    """
    spark, made, stage = rows.sparkSession, f"{path}/_lines", Stage(rows.sparkSession)
    kept = stage(rows, "playlists")
    counts = {r["playlist"]: r["n"] for r in kept.groupBy("playlist").agg(F.count("*").alias("n")).collect()}  # a row for each list
    long = [f"{n}{end}" for n in names for end, each in ((".txt", 1), (".m3u", 2)) if counts.get(n, 0) * each > ONE_FILE]
    parts = 2 * len(names) + 3 * sum(counts.values()) // ONE_FILE
    place = F.when(F.col("file").isin(*long), F.col("_ord")) if long else F.lit(None).cast(rows.schema["_ord"].dataType)
    lines = playlist_files(kept, names, group).repartitionByRange(parts, "file", place).sortWithinPartitions("file", "_ord", "k")
    lines.select("file", "value").write.mode("overwrite").partitionBy("file").text(made)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for file in [f"{n}{end}" for n in names for end in (".txt", ".m3u") if end == ".txt" or n not in TEXT_ONLY]:
        at, to = hadoop.Path(f"{made}/file={file}"), hadoop.Path(f"{path}/{file}")
        fs.delete(to, True)
        fs.rename(at, to) if fs.exists(at) else fs.mkdirs(to)
    fs.delete(hadoop.Path(made), True)
    stage.free()
    return {n: counts.get(n, 0) for n in names}


CANDIDATE_LISTS = ("trusted_media", "untrusted_review_media", "hls_candidates", "rtsp_candidates", "live_or_reachable_media", "dead_or_restricted_media", "image_snapshots")
HARVEST_LISTS = ("harvested_media", "harvested_hls", "harvested_rtsp", "harvested_image_snapshots")


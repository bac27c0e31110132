"""Harvest: from fetched payloads to URL records, cameras, endpoints and files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import url as U
from ..functions.media import MediaFilter, image_removal_reason
from ..operators import extract, merge, sinks, summarize
from ..operators.admit import first_rows, per_key
from ..operators.policy import Rule, block_reason, record_block_reason, unblocked
from ..staging import Stage


@dataclass
class HarvestConfig:
    media: list[str] = field(default_factory=lambda: ["all"])
    image_filter: str = "raw"
    max_urls: int = 0
    max_endpoints_per_page: int = 500
    rules: list[Rule] = field(default_factory=list)


PAYLOADS = "_ord long, page_url string, payload_url string, method string, content_type string, status int, body string, source_provider string, source_name string"
#: Columns of a URL record that extractors don't fill.
LATE = {
    "description": "string", "camera_record_id": "string", "asset_id": "string", "asset_role": "string", "asset_field": "string", "field_path": "string", "source_endpoint_url": "string",
    "source_page_url": "string", "orientation": "string", "in_service": "boolean", "status": "string", "last_updated": "string", "last_refresh": "string", "image_description": "string",
    "current_image_update_frequency": "string", "reference_image_update_frequency": "string",
}


def record_order(payload: str, kind: int, record: str, asset: str | None = None) -> Column:
    """The place of a URL record: by payload, assets of cameras (kind 0) before other findings (1), then record and asset."""
    at = F.col(asset) if asset else F.lit(0)
    return F.struct(F.col(payload).cast("long").alias("payload"), F.lit(kind).alias("kind"), F.col(record).cast("long").alias("record"), at.cast("long").alias("asset"))


def asset_records(cameras: DataFrame) -> DataFrame:
    """Every asset of every camera as a URL record."""
    own = cameras.select("*", F.posexplode("media_assets").alias("_k", "a"))
    meta = F.map_concat(
        F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & ~k.isin("source_provided_only", "camera_record_id", "asset_id", "asset_role", "asset_field", "field_path", "json_record_path")),
        F.create_map(F.lit("source_provided_only"), F.lit("true"), F.lit("camera_record_id"), F.col("camera_record_id"), F.lit("asset_id"), F.col("a.asset_id"), F.lit("asset_role"), F.col("a.asset_role"), F.lit("asset_field"), F.col("a.asset_field"), F.lit("field_path"), F.col("a.field_path"), F.lit("json_record_path"), F.col("json_record_path")),
    )
    cols = {"url": F.col("a.url"), "media_type": F.col("a.media_type"), "asset_id": F.col("a.asset_id"), "asset_role": F.col("a.asset_role"), "asset_field": F.col("a.asset_field"), "field_path": F.col("a.field_path"), "source_url": F.col("source_endpoint_url"), "discovery_method": F.lit("structured_camera_record"), "metadata": meta}
    same = [c for c in cameras.columns if c not in ("media_assets", "metadata", "field_map", "raw_record", "coordinates", "status_source", "payload_ord", "record_ord")]
    return own.select(record_order("payload_ord", 0, "record_ord", "_k").alias("_ord"), *same, *[v.alias(k) for k, v in cols.items()])


def url_records(payloads: DataFrame, cameras: DataFrame, config: HarvestConfig) -> DataFrame:
    """All URL records of payloads, in order: the cameras' assets before other findings of the same payload."""
    found = extract.harvest_records(payloads)
    loose = found.withColumn("_ord", record_order("payload_ord", 1, "record_ord")).drop("payload_ord", "record_ord")
    loose = loose.withColumns({c: F.lit(None).cast(t) for c, t in LATE.items()})
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    loose = loose.withColumns({"asset_field": meta("json_media_key"), "source_endpoint_url": meta("json_endpoint_url"), "status": meta("status"), "orientation": meta("orientation")})
    both = asset_records(cameras).unionByName(loose, allowMissingColumns=True)
    return both.filter(record_block_reason(F.col("url"), F.col("source_url"), config.rules).isNull()) if config.rules else both


def endpoints(payloads: DataFrame, cameras: DataFrame) -> DataFrame:
    """One row for each JSON endpoint, with what it holds."""
    counts = extract.record_counts(payloads)
    said = lambda *cs: F.greatest(*[F.col(c).isNotNull().cast("int") for c in cs]) == 1
    held = cameras.groupBy("payload_ord").agg(
        F.count("*").alias("camera_record_count"),
        F.sum(F.size("media_assets")).alias("media_asset_count"),
        F.bool_or(F.col("lat").isNotNull()).alias("has_coordinates"),
        F.bool_or(said("timestamp", "date", "time", "last_updated", "last_refresh")).alias("has_timestamps"),
        F.bool_or(said("in_service", "status")).alias("has_service_status"),
        F.bool_or(said("current_image_update_frequency", "reference_image_update_frequency")).alias("has_refresh_metadata"),
    )
    info = payloads.select(F.col("_ord").alias("payload_ord"), "content_type", "status", "source_provider", "source_name", F.col("method").alias("first_seen_method"), F.when(F.col("page_url") != F.col("payload_url"), F.col("page_url")).alias("source_page_url"))
    rows = counts.join(info, "payload_ord").join(held, "payload_ord", "left").na.fill(0, ["camera_record_count", "media_asset_count"]).na.fill(False)
    rows = rows.withColumns({"_ord": F.col("payload_ord"), "endpoint_type": U.endpoint_type(F.col("endpoint_url"), F.col("content_type")), "metadata": F.map_filter(F.create_map(F.lit("status"), F.col("status").cast("string"), F.lit("content_type"), F.col("content_type")), lambda k, v: v.isNotNull() & (v != ""))})
    return merge.merge_endpoints(rows.drop("payload_ord", "content_type", "status"))


def linked(payloads: DataFrame, config: HarvestConfig) -> DataFrame:
    """Endpoints that pages link to, expanded, not blocked, capped for each page: what to fetch next."""
    own = unblocked(extract.page_endpoints(payloads), config.rules, "endpoint_url")
    wide = own.select("payload_ord", "page_url", "record_ord", F.posexplode(U.expanded_endpoints(F.col("endpoint_url"))).alias("k", "endpoint_url"))
    first = merge.first_seen(wide.withColumn("_ord", F.struct("record_ord", "k")), "payload_ord", F.lower("endpoint_url"))
    return per_key(first, ["payload_ord"], config.max_endpoints_per_page, "_ord").drop("_ord", "k")


def failures(payloads: DataFrame, rules: list[Rule] = ()) -> DataFrame:
    """Error rows of a harvest: ``stage, subject, error`` for each payload that gives nothing.

    ``source_fetch_error``: the fetch failed, by the payload's ``error`` if it has that column, or
    answered with a status of 400 or more.  ``row_extraction_error``: it answered without a body,
    or says that it is JSON and can't be read as such.  Blocked payloads were never asked for.
    """
    said = F.nullif(F.trim("error"), F.lit("")) if "error" in payloads.columns else F.lit(None).cast("string")
    refused = F.when(F.col("status") >= 400, F.concat(F.lit("HTTP status "), F.col("status").cast("string")))
    json = F.lower(F.coalesce("content_type", F.lit(""))).contains("json")
    unread = F.when(F.col("body").isNull(), "no body").when(json & F.try_parse_json("body").isNull(), "not JSON")
    fetch = F.coalesce(said, refused)
    own = unblocked(payloads, list(rules), "payload_url") if rules else payloads
    rows = own.select(F.when(fetch.isNotNull(), "source_fetch_error").otherwise("row_extraction_error").alias("stage"), F.col("payload_url").alias("subject"), F.coalesce(fetch, unread).alias("error"))
    return rows.filter("error IS NOT NULL")


def reached(seeds: DataFrame, payloads: DataFrame, config: HarvestConfig, rounds: int = 3) -> DataFrame:
    """Endpoints that ``seeds`` (``url``) lead to within ``rounds`` steps over what has been fetched.

    Returns ``endpoint_url``, ``depth`` (the least number of steps), ``found_on`` (the page of
    that step that comes first in the payloads) and ``fetched`` (whether there is a payload).
    URLs are compared without case; seeds aren't returned, pages that lead back to them or to
    each other end there.  Null URLs lead nowhere; equal payloads count as one.

    Pages are read once, to a table of links; a round joins its new endpoints with that
    table and drops what earlier rounds have seen.  Rounds end early when nothing is new.
    """
    if rounds < 1:
        raise ValueError("rounds: 1 or more")
    stage = Stage(payloads.sparkSession)
    links = linked(payloads, config).filter("page_url IS NOT NULL AND endpoint_url IS NOT NULL")
    edges = stage(links.select(F.lower("page_url").alias("start"), F.lower("endpoint_url").alias("key"), F.struct("payload_ord", "record_ord", "endpoint_url", "page_url").alias("link")), "links")
    new = stage(seeds.filter("url IS NOT NULL").select(F.lower("url").alias("key")).distinct(), "seeds")
    seen, found = new, None
    for depth in range(1, rounds + 1):
        first = edges.join(new.select(F.col("key").alias("start")), "start").groupBy("key").agg(F.min("link").alias("link"))
        new = stage(first.join(seen, "key", "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        seen = seen.unionByName(new.select("key"))
    found = new if found is None else found  # the empty table of the first round
    have = payloads.select(F.lower("payload_url").alias("key")).distinct().withColumn("fetched", F.lit(True))
    rows = found.join(have, "key", "left")
    return rows.select("link.endpoint_url", "depth", F.col("link.page_url").alias("found_on"), F.coalesce("fetched", F.lit(False)).alias("fetched"))


@dataclass
class Harvest:
    raw: DataFrame
    unique: DataFrame
    media: DataFrame
    images: DataFrame
    records: DataFrame
    cameras: DataFrame
    endpoints: DataFrame
    removed: DataFrame
    errors: DataFrame


def harvest(payloads: DataFrame, config: HarvestConfig | None = None) -> Harvest:
    """All stages of a harvest as frames; nothing runs until one is used."""
    config = config or HarvestConfig()
    fetched = unblocked(payloads, config.rules, "payload_url").filter("status IS NULL OR status < 400")
    cameras = merge.first_cameras(extract.camera_records(fetched).withColumn("_ord", F.struct("payload_ord", "record_ord"))).drop("_ord")
    if config.rules:
        cameras = cameras.withColumn("media_assets", F.filter("media_assets", lambda a: block_reason(a["url"], config.rules).isNull()))
    raw = url_records(fetched, cameras, config)
    unique = merge.merge_harvest_records(raw)
    media = unique.filter(MediaFilter(config.media).matches(F.col("media_type"), F.col("url")))
    marked = media.withColumn("removal_reason", image_removal_reason(config.image_filter))
    images = marked.filter("removal_reason IS NULL").drop("removal_reason")
    removed = summarize.by_key(marked.filter("removal_reason IS NOT NULL"), "removal_reason")
    return Harvest(raw, unique, media, images, first_rows(images, config.max_urls, "_ord"), cameras, endpoints(fetched, cameras), removed, failures(payloads, config.rules))


def write(h: Harvest, path: str, config: HarvestConfig, query: str = "", created_at: str = "", intermediate: bool = False) -> dict:
    """All artifacts of a harvest and its handoff manifest, which is returned."""
    spark: SparkSession = h.records.sparkSession
    records, cameras = h.records.persist(), h.cameras.persist()
    sinks.write_csv(sinks.url_table(records), f"{path}/camera_urls_csv")
    sinks.write_jsonl(records.withColumn("media_url", F.col("url")).drop("_ord"), f"{path}/camera_urls_jsonl")
    sinks.write_text(records.select("_ord", F.col("url").alias("value")), f"{path}/camera_urls.txt", "_ord")
    sinks.write_urls_by_type(records, f"{path}/urls_by_type")
    sinks.write_jsonl(cameras, f"{path}/camera_records_jsonl")
    sinks.write_jsonl(cameras.select("camera_record_id", F.explode("media_assets").alias("a")).select("camera_record_id", "a.*"), f"{path}/camera_media_assets_jsonl")
    sinks.write_jsonl(h.endpoints, f"{path}/discovered_endpoints_jsonl")
    sinks.write_jsonl(h.errors, f"{path}/logs/harvest_errors_jsonl")
    sinks.write_jsonl(sinks.inventory(cameras, records), f"{path}/harvest_camera_inventory_jsonl")
    lists = sinks.write_playlists(sinks.harvest_playlist_rows(records, config.rules), f"{path}/playlists", sinks.HARVEST_LISTS, "harvest")
    if intermediate:
        for name in ("raw", "unique", "media", "images"):
            sinks.write_jsonl(getattr(h, name), f"{path}/intermediate/{name}")
    chosen = MediaFilter(config.media)
    manifest = {
        "schema_version": "harvest-handoff/v2",
        "query": query,
        "created_at": created_at,
        "mode": "harvest",
        **{k: v for k, v in sinks.FLAGS.items()},
        "media_filter": chosen.requested,
        "handoff_default_scope": "structured_inventory_records" if chosen.all else "filtered_media_records",
        "files": {"camera_urls_jsonl": "camera_urls_jsonl", "filtered_media_records": "camera_urls_jsonl", "harvest_camera_inventory": "harvest_camera_inventory_jsonl", "camera_records": "camera_records_jsonl", "camera_media_assets": "camera_media_assets_jsonl", "discovered_endpoints": "discovered_endpoints_jsonl"},
        "counts": {**sinks.one_row(summarize.harvest_summary(records)), **{f"cameras_{k}": v for k, v in sinks.one_row(summarize.camera_summary(cameras)).items()}, "playlists": lists},
        "removed_by_reason": {r["key"]: r["n"] for r in h.removed.collect()},  # a row for each reason
    }
    sinks.write_json(spark, manifest, f"{path}/harvest_handoff")
    records.unpersist()
    cameras.unpersist()
    return manifest


def ordered(df: DataFrame) -> DataFrame:
    """Numbers rows of a small frame (a registry, a list of seeds) by their present order."""
    return df.withColumn("_ord", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())).cast("long"))


def direct_candidates(rows: DataFrame) -> DataFrame:
    """Source rows that are streams themselves."""
    kind = F.when(M.looks_like_rtsp(F.col("url")), "rtsp").when(M.looks_like_hls(F.col("url")), "hls")
    return rows.withColumn("media_type", kind).filter("media_type IS NOT NULL")

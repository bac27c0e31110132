"""Evidence of what a row is: protocol labels, signatures, additive scores, bands.

Everything here reads what was already found; no expression makes a URL.  Scores
order rows for review, they never grant trust.  A row's metadata is a
``map<string, string>``; nested values are JSON texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import media as M
from .text import any_term, ends_with_any, present, text

# Fixed values: (family, name, text, confidence) of passive signatures.
SIGNATURES = (
    ("camera_path_fragment", "axis_cgi_path", "/axis-cgi/", "moderate"),
    ("mjpeg_path_fragment", "mjpg_path", "/mjpg/", "moderate"),
    ("mjpeg_path_fragment", "mjpeg_path", "/mjpeg/", "moderate"),
    ("snapshot_path_fragment", "snapshot_path", "/snapshot", "moderate"),
    ("snapshot_path_fragment", "snap_jpg", "/snap.jpg", "moderate"),
    ("snapshot_path_fragment", "image_jpg", "/image.jpg", "low"),
    ("camera_path_fragment", "video_path", "/video", "low"),
    ("camera_path_fragment", "stream_path", "/stream", "low"),
    ("camera_path_fragment", "live_path", "/live", "low"),
    ("hls_path_fragment", "hls_path", "/hls", "moderate"),
    ("playlist_extension", "playlist_m3u8", "/playlist.m3u8", "high"),
    ("playlist_extension", "master_m3u8", "/master.m3u8", "high"),
    ("camera_path_fragment", "streaming_channels", "/Streaming/Channels/", "moderate"),
    ("camera_path_fragment", "isapi_path", "/ISAPI/", "moderate"),
    ("onvif_reference", "onvif_reference", "/onvif/", "moderate"),
    ("camera_path_fragment", "realmonitor_path", "/cam/realmonitor", "moderate"),
    ("structured_endpoint_hint", "mapserver", "MapServer", "moderate"),
    ("structured_endpoint_hint", "featureserver", "FeatureServer", "moderate"),
    ("structured_endpoint_hint", "geojson", ".geojson", "moderate"),
    ("media_extension", "m3u8_extension", ".m3u8", "high"),
    ("media_extension", "mpd_extension", ".mpd", "medium"),
    ("media_extension", "jpg_extension", ".jpg", "low"),
    ("media_extension", "jpeg_extension", ".jpeg", "low"),
    ("media_extension", "png_extension", ".png", "low"),
    ("media_extension", "webp_extension", ".webp", "low"),
)
# Vendor names that are hints.
VENDORS = ("axis", "hikvision", "dahua", "mobotix", "bosch", "sony", "panasonic")
# Words of cameras and of structured endpoints.
CAMERA_WORDS = ("camera", "cameras", "webcam", "webcams", "cctv", "traffic cam", "weather cam", "snapshot", "stream", "live cam", "livestream")
STRUCTURED_WORDS = ("json", "geojson", "mapserver", "featureserver", "arcgis", "camera_id", "route", "direction", "status", "latitude", "longitude")
WEIGHTS = {"high": 10, "medium": 7, "moderate": 7}
# Bands in order, strongest first.
BANDS = ("very_strong", "strong", "moderate", "weak", "none")
LIVE = ("active_live_unknown", "active_live_verified", "active_image_snapshot_refreshing", "active_rtsp_verified")
RESTRICTED_PARTS = ("restricted", "auth_required", "unauthorized", "forbidden", "401", "403")
DEAD_PARTS = ("dead", "offline", "invalid", "decode_failed", "static_image_asset", "not_image", "dead_segments")
STRUCTURED_KEYS = ("json_endpoint_url", "json_record_path", "json_record_schema_hint", "json_metadata_extracted")
IDENTITY_KEYS = ("camera_id", "camera_name", "route", "road", "direction", "camera_status", "agency", "owner")
#: Metadata that scoring itself writes; never evidence.
DERIVED = (
    "camera_evidence_score", "camera_evidence_band", "camera_evidence_reasons", "camera_evidence_signals", "signature_matches", "protocol_label", "media_family",
    "protocol_confidence", "protocol_reasons", "why_candidate_mattered", "candidate_priority_bucket",
)


def band(score: Column) -> Column:
    return F.when(score <= 0, "none").when(score < 25, "weak").when(score < 50, "moderate").when(score < 75, "strong").otherwise("very_strong")


def protocol(url: Column, content_type: Column | None = None, declared: Column | None = None, sample: Column | None = None) -> Column:
    """Struct of ``protocol_label, media_family, protocol_confidence, protocol_reason``: an explicit label, then the scheme, then content and path."""
    blank = F.lit("")
    d, u = F.lower(F.trim(text(declared if declared is not None else blank))), F.lower(text(url))
    t, s = F.lower(text(content_type if content_type is not None else blank)), F.lower(F.substring(text(sample if sample is not None else blank), 1, 4096))
    way = F.substring_index(u, "?", 1)

    def r(label, family: str, confidence: str, reason) -> Column:
        col = lambda v: v if isinstance(v, Column) else F.lit(v)
        return F.struct(col(label).alias("protocol_label"), F.lit(family).alias("media_family"), F.lit(confidence).alias("protocol_confidence"), col(reason).alias("protocol_reason"))

    said = "metadata explicitly labels candidate as "
    other = F.concat(F.lit(said), d)
    return (
        F.when(d.isin("hls", "hls_stream"), r("hls", "stream", "high", said + "HLS"))
        .when(d.isin("rtsp", "rtsps", "rtsp_stream"), r("rtsp", "stream", "high", said + "RTSP"))
        .when(d.isin("mjpeg", "mjpg"), r("mjpeg", "stream", "high", said + "MJPEG"))
        .when(d.isin("image", "snapshot", "image_snapshot"), r("image_snapshot", "image", "high", said + "an image snapshot"))
        .when(d.isin("dash", "mpd"), r("dash", "playlist", "high", said + "DASH"))
        .when(d == "mp4", r("mp4", "video_file", "medium", other))
        .when(d.isin("webrtc", "rtmp", "srt"), r(d, "stream", "medium", other))
        .when(u.rlike("^rtsps?://"), r("rtsp", "stream", "high", "URL scheme is RTSP/RSTPS"))
        .when(u.startswith("rtmp://"), r("rtmp", "stream", "high", "URL scheme is RTMP"))
        .when(u.startswith("srt://"), r("srt", "stream", "high", "URL scheme is SRT"))
        .when(u.contains(".m3u8") | any_term(t, ("application/vnd.apple.mpegurl", "application/x-mpegurl")) | s.contains("#extm3u"), r("hls", "stream", "high", "URL/content indicates HLS playlist"))
        .when(u.contains(".mpd") | t.contains("dash+xml"), r("dash", "playlist", "high", "URL/content indicates DASH manifest"))
        .when(t.contains("multipart/x-mixed-replace") | (t.contains("multipart") & t.contains("boundary")), r("mjpeg", "stream", "high", "content type indicates multipart MJPEG"))
        .when(any_term(u, ("webrtc", "rtcpeerconnection", "whep")) | any_term(s, ("rtcpeerconnection", "webrtc", "whep")), r("webrtc", "stream", "medium", "already-discovered page/config contains WebRTC indicators"))
        .when(ends_with_any(way, M.EXTENSIONS["image_snapshot"]) | t.startswith("image/"), r("image_snapshot", "image", "medium", "URL/content type indicates image snapshot candidate"))
        .when(way.endswith(".mp4") | t.contains("video/mp4"), r("mp4", "video_file", "medium", "URL/content type indicates MP4 video file"))
        .when(any_term(u, ("/stream", "/live", "/video", "/mjpg", "/mjpeg")), r("unknown_stream", "stream", "low", "URL path looks media-like but protocol is not confirmed"))
        .when(t.contains("json"), r("unknown", "structured_data", "low", "content type indicates structured data rather than direct media"))
        .when(t.contains("html"), r("unknown", "page", "low", "content type indicates HTML page"))
        .otherwise(r("unknown", "unknown", "low", "no passive protocol evidence found"))
    )


def haystack(*cols: Column, metadata: Column | None = None) -> Column:
    """All text of a row, lower case; derived metadata is left out."""
    parts = list(cols)
    if metadata is not None:
        own = F.map_filter(metadata, lambda k, v: ~k.isin(*DERIVED))
        parts += [F.array_join(F.map_keys(own), "\n"), F.array_join(F.map_values(own), "\n")]
    return F.lower(F.concat_ws("\n", *parts))


def _quoted(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _signature_table() -> str:
    """All signatures and vendor hints, with what each looks for, as one constant array in SQL."""
    rows = [(v.lower(), f, n, v, c, WEIGHTS.get(c, 4)) for f, n, v, c in SIGNATURES] + [(v, "vendor_hint", f"{v}_vendor_hint", v, "low", 4) for v in VENDORS]
    one = "named_struct('needle', {}, 'signature_family', {}, 'signature_name', {}, 'matched_value', {}, 'confidence', {}, 'weight', {})"
    return "array(" + ", ".join(one.format(*map(_quoted, r[:-1]), r[-1]) for r in rows) + ")"


def signatures(low: Column) -> Column:
    """Matching signatures and vendor hints of a lower-case text, in their order: an array of structs.

    The table is one constant, so neither plan nor generated code grows with it.
    ``low`` is read once for each entry, so it has to be a column; it stands twice here,
    and what stands twice isn't written out by the optimizer.
    """
    table = F.expr(_signature_table())
    hits = F.when(low != "", F.filter(table, lambda x: low.contains(x["needle"]))).otherwise(F.slice(table, 1, 0))
    return F.transform(hits, lambda x: x.dropFields("needle"))


def signature_weight(matches: Column) -> Column:
    return F.aggregate(matches, F.lit(0), lambda a, x: a + x["weight"])


def _sum(*cols: Column) -> Column:
    out = F.lit(0)
    for c in cols:
        out = out + F.coalesce(c, F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), out)).cast("int")


def _points(condition: Column, points) -> Column:
    return F.when(condition, points)


def with_source_evidence(df: DataFrame, url: Column, title: Column, snippet: Column, provider: Column, content_type: Column, http_status: Column, needs_login: Column, blocked: Column, out: str = "evidence") -> DataFrame:
    """Adds a struct of ``score, band, reasons, camera_terms, protocol_label, signatures, why`` to source rows."""
    low = F.lower(F.concat_ws(" ", text(url), text(title), text(snippet)))
    first = df.withColumns(
        {
            "_s_low": low,
            "_s_kind": F.lower(text(content_type)),
            "_s_hay": haystack(url, title, snippet, content_type),
            "_s_label": protocol(url, content_type)["protocol_label"],
            "_s_stopped": blocked.isNotNull(),
            "_s_url": text(url) != "",
            "_s_provider": text(provider),
            "_s_reached": F.coalesce((http_status != 0) & (http_status < 400), F.lit(False)),
            "_s_login": F.coalesce(needs_login, F.lit(False)),
        }
    )
    s = lambda k: F.col(f"_s_{k}")
    second = first.withColumns(
        {
            "_s_found": signatures(F.col("_s_hay")),
            "_s_terms": present(*[(s("low").contains(t), t) for t in CAMERA_WORDS]),
            "_s_structured": any_term(s("low"), STRUCTURED_WORDS) | any_term(s("kind"), STRUCTURED_WORDS),
            "_s_direct": s("label").isin("hls", "rtsp", "mjpeg", "image_snapshot", "dash", "webrtc", "rtmp", "srt"),
        }
    )
    terms, configured, promoted = F.size(s("terms")), s("provider").isin("directory", "direct"), s("provider") == "asset_host_promotion"
    score = _sum(
        F.when(s("stopped"), -30).when(s("url"), 10),
        _points(terms > 0, F.least(F.lit(20), 8 + 3 * terms)),
        _points(s("structured"), 15),
        _points(s("direct"), 20),
        F.least(F.lit(20), signature_weight(s("found"))),
        _points(configured | promoted, 8),
        _points(s("reached"), 5),
        _points(s("login"), -20),
    )
    reasons = present(
        (s("stopped"), "blocked source policy match"),
        (~s("stopped") & s("url"), "source URL passed blocked-source policy check"),
        (terms > 0, "source title/snippet/URL contains camera or live-media terms"),
        (s("structured"), "source has structured camera endpoint hints"),
        (s("direct"), "source URL/content has direct media protocol evidence"),
        (F.size(s("found")) > 0, "source matched safe passive camera/media signatures"),
        (configured, "source came from configured directory/direct source"),
        (promoted, "source came from repeated camera asset-host promotion"),
        (s("reached"), "source HTTP fetch returned a reachable status"),
        (s("login"), "source advertised authentication requirement"),
    )
    done = second.withColumns({"_s_score": score, "_s_reasons": reasons})
    result = F.struct(s("score").alias("score"), band(s("score")).alias("band"), s("reasons").alias("reasons"), F.slice(s("terms"), 1, 8).alias("camera_terms"), s("label").alias("protocol_label"), F.slice(s("found"), 1, 12).alias("signatures"), why(s("reasons"), "Source").alias("why"))
    return done.withColumn(out, result).select(*df.columns, out)


def with_candidate_evidence(df: DataFrame, blocked: Column | None = None, out: str = "evidence") -> DataFrame:
    """Adds a struct of ``score, band, reasons, protocol, signatures, why`` to candidate rows.

    Needs their columns stream_url, source_url, title, location_text, lat, lon,
    scope_status, validation_status, metadata.  Texts, then protocol and
    signatures, then flags are projections of their own, so that no expression
    is written out more than once in the plan.
    """
    meta = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    of = lambda k: text(F.try_element_at(meta, F.lit(k)))
    given = lambda k: (~of(k).isin("", "[]", "{}")).cast("int")
    first = lambda *cs: F.coalesce(*[F.nullif(text(c), F.lit("")) for c in cs])
    http = F.when(of("http_metadata").startswith("{"), of("http_metadata"))
    texts = df.withColumns(
        {
            "_e_url": first(F.col("stream_url"), of("media_url")),
            "_e_title": first(F.col("title"), of("camera_name"), of("source_name")),
            "_e_place": first(F.col("location_text"), of("location_display"), of("location_text")),
            "_e_http": http,
            "_e_blocked": blocked if blocked is not None else F.lit(None).cast("string"),
            "_e_scope": F.lower(text(F.col("scope_status"))),
            "_e_status": F.lower(text(first(F.col("validation_status"), of("validation_status")))),
            "_e_structured": sum((given(k) for k in STRUCTURED_KEYS), F.lit(0)),
            "_e_identity": sum((given(k) for k in IDENTITY_KEYS), F.lit(0)),
            "_e_inherited": first(of("source_camera_evidence_score"), of("source_evidence_score")).try_cast("int"),
        }
    )
    content = F.coalesce(F.get_json_object("_e_http", "$.content_type"), F.try_element_at(meta, F.lit("content_type")))
    code = F.get_json_object("_e_http", "$.http_status").try_cast("int")
    found = texts.withColumns(
        {
            "_e_protocol": protocol(F.col("_e_url"), content, of("media_type")),
            "_e_hay": haystack(F.col("_e_url"), text(F.col("source_url")), F.col("_e_title"), F.col("_e_place"), metadata=meta),
            "_e_live": F.col("_e_status").isin(*LIVE),
            "_e_closed": ~F.col("_e_status").isin(*LIVE) & any_term(F.col("_e_status"), RESTRICTED_PARTS),
            "_e_gone": ~F.col("_e_status").isin(*LIVE) & any_term(F.col("_e_status"), DEAD_PARTS),
            "_e_login": F.coalesce(F.get_json_object("_e_http", "$.www_authenticate_present") == "true", F.lit(False)),
            "_e_reached": F.coalesce((code != 0) & (code < 400), F.lit(False)),
        }
    )
    found = found.withColumn("_e_found", signatures(F.col("_e_hay")))
    e = lambda k: F.col(f"_e_{k}")
    label = F.col("_e_protocol.protocol_label")
    direct, weaker = label.isin("hls", "rtsp", "mjpeg", "image_snapshot"), label.isin("dash", "webrtc", "rtmp", "srt", "mp4")
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    dead = e("gone") & ~e("closed")
    idle = ~e("live") & ~e("closed") & ~dead & e("status").isin("not_validated", "validation_disabled", "rtsp_validation_unavailable")
    score = _sum(
        _points(e("blocked").isNotNull(), -30),
        F.when(direct, 35).when(weaker, 25).when(label == "unknown_stream", 10),
        _points(e("structured") > 0, 30),
        _points(e("identity") > 0, F.least(F.lit(20), 5 + 4 * e("identity"))),
        _points(located, 20),
        _points(e("inherited") != 0, F.least(F.lit(15), F.floor(e("inherited") / 5).cast("int"))),
        F.least(F.lit(15), signature_weight(e("found"))),
        F.when(e("scope") == "in_scope", 10).when(e("scope") == "out_of_scope", -20),
        F.when(e("live"), 10).when(e("closed") | dead, -20),
        _points(e("login"), -20),
        _points(e("reached"), 5),
    )
    reasons = present(
        (e("blocked").isNotNull(), "candidate matched blocked-source policy"),
        (direct | weaker, F.concat(F.lit("direct "), label, F.lit(" media evidence"))),
        (label == "unknown_stream", "URL has stream-like path but protocol is unconfirmed"),
        (e("structured") > 0, "candidate came from structured camera metadata"),
        (e("identity") > 0, "candidate has camera identity/location/status fields"),
        (located, "candidate has source-extracted or geocoded coordinates"),
        (e("inherited") != 0, "candidate inherited evidence from its source row"),
        (F.size(e("found")) > 0, "candidate matched safe passive camera/media signatures"),
        (e("scope") == "in_scope", "candidate passed target scope check"),
        (e("scope") == "out_of_scope", "candidate is out of target scope"),
        (e("live"), "candidate passed media validation"),
        (e("closed"), "candidate validation indicates restricted/auth-required media"),
        (dead, "candidate validation indicates dead or non-camera media"),
        (idle, "candidate is not validated; evidence does not imply trust"),
        (e("login"), "candidate HTTP metadata advertises authentication"),
        (e("reached"), "candidate HTTP metadata shows reachable response"),
    )
    done = found.withColumns({"_e_score": score, "_e_reasons": reasons})
    result = F.struct(e("score").alias("score"), band(e("score")).alias("band"), e("reasons").alias("reasons"), e("protocol").alias("protocol"), F.slice(e("found"), 1, 12).alias("signatures"), why(e("reasons"), "Candidate").alias("why"))
    return done.withColumn(out, result).select(*df.columns, out)


def why(reasons: Column, prefix: str) -> Column:
    none = f"{prefix} had no strong passive camera evidence; it remains review/prioritization-only evidence."
    return F.when(F.size(reasons) == 0, none).otherwise(F.concat(F.lit(f"{prefix} mattered because "), F.array_join(F.slice(reasons, 1, 4), "; "), F.lit(".")))

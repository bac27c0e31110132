"""Media types: classification of URLs, effective types of rows, asset filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import url as U
from .text import any_term, ends_with_any, normalized_key, text

# Fixed values of the media vocabulary.
MEDIA_TYPES = ("hls", "rtsp", "mjpeg", "image_snapshot", "video_file", "stream", "unknown_media")
EXTENSIONS = {
    "hls": (".m3u8",),
    "rtsp": (),
    "mjpeg": (".mjpg", ".mjpeg"),
    "image_snapshot": (".jpg", ".jpeg", ".png", ".webp"),
    "video_file": (".mp4", ".webm", ".mov", ".m4v"),
    "stream": (),
    "unknown_media": (),
}
ALL_EXTENSIONS = tuple(e for es in EXTENSIONS.values() for e in es)
TOKEN_NAMES = {"image": "image_snapshot", "snapshot": "image_snapshot", "rtsps": "rtsp", "video": "video_file", "unknown": "unknown_media"}
STREAM_TOKENS = ("/stream", "stream=", "/video", "video=", "/media", "media=")

# Marks of page assets in URLs.
ASSET_MARKS = (
    "og-default", "open_graph", "opengraph", "favicon", "logo", "sprite", "placeholder", "avatar", "basemap", "/dark_all/", "/light_all/", "/tile/", "/tiles/",
    "cartocdn.com", "openstreetmap.org/", "leaflet", "mapbox", "googleapis.com", "gstatic.com", "apple-touch-icon", "mstile", "mask-icon", "site-icon", "site_icon",
    "seal_", "/seal", "/assets/", "/static/", "/template", "/banner", "/icons/", "/icon/", "/images/icons/", "retail", "store-logo", "store_logo",
)
DEFAULT_NAMES = ("default.png", "default.jpg", "blank.png", "blank.jpg", "loading.gif")
THUMB_SEGMENTS = ("thumb", "thumbs", "thumbnail", "thumbnails")
THUMB_MARKS = ("/services/thumb/", "/services/thumbs/", "/service/thumb/", "/service/thumbnail/", "/preview/thumb/", "/previews/thumb/", "/cdn/thumb/", "/cdn-cgi/image/")
# Words of page assets and of camera images in records.
PAGE_TERMS = (
    "favicon", "apple-touch-icon", "icon", "logo", "sprite", "badge", "avatar", "profile", "placeholder", "loading", "spinner", "banner", "hero", "background",
    "bg-", "open-graph", "og:image", "twitter:image", "social", "share", "site-logo", "tracking", "pixel", "1x1",
)
CAMERA_TERMS = ("camera", "cam", "cctv", "snapshot", "current", "reference", "trafficcam", "webcam", "cctvimage", "stream", "view")
CAMERA_ROLES = ("current_image_snapshot", "reference_image_snapshot", "image_snapshot")
CAMERA_FIELDS = ("currentimageurl", "referenceimageurl", "imageurl", "snapshoturl", "cameraimageurl")
CAMERA_KEYS = ("imagedescription", "currentimageupdatefrequency", "referenceimageupdatefrequency", "refreshrate", "refreshinterval", "cameraid", "inservice", "direction", "lat", "latitude", "lon", "longitude", "route", "intersection")
# Roles of media fields, by normalised name.
FIELD_ROLES = {
    "streamingvideourl": "streaming_video", "streamingurl": "streaming_video", "streamurl": "streaming_video", "streamurlhls": "hls_stream", "videourl": "video_file",
    "hlsurl": "hls_stream", "m3u8url": "hls_stream", "mjpegurl": "mjpeg_stream", "currentimageurl": "current_image_snapshot", "referenceimageurl": "reference_image_snapshot",
    "imageurl": "image_snapshot", "snapshoturl": "image_snapshot", "thumbnailurl": "thumbnail", "mediaurl": "media_url", "url": "media_url",
}
TYPE_ROLES = {"hls": "hls_stream", "mjpeg": "mjpeg_stream", "image_snapshot": "image_snapshot", "video_file": "video_file", "stream": "media_url"}


def _chain(low: Column, way: Column, kind: Column, start: Column) -> Column:
    """What all classifiers have in common, most specific first."""
    return (
        start.when(way.endswith(".m3u8") | low.contains(".m3u8") | kind.contains("mpegurl"), "hls")
        .when(ends_with_any(way, EXTENSIONS["mjpeg"]) | kind.contains("multipart/x-mixed-replace"), "mjpeg")
        .when(ends_with_any(way, EXTENSIONS["video_file"]), "video_file")
        .when(ends_with_any(way, EXTENSIONS["image_snapshot"]), "image_snapshot")
    )


def classify(url: Column, key: Column | None = None, content_type: Column | None = None) -> Column:
    """Media type of a harvested URL, or null.  ``key``: name of the field it was found in."""
    url = text(url)
    low, way = F.lower(url), F.lower(U.path(url))
    key, kind = F.lower(text(key if key is not None else F.lit(""))), F.lower(text(content_type if content_type is not None else F.lit("")))
    known = url.rlike("^(?:https?|rtsps?)://")
    out = _chain(low, way, kind, F.when(~known, F.lit(None).cast("string")).when(low.rlike("^rtsps?://"), "rtsp"))
    return out.when(any_term(key, ("stream", "video", "media", "mjpeg", "rtsp")), "stream").when(any_term(low, STREAM_TOKENS) & ~url.rlike(U.MEDIA_EXTENSION), "stream")


def classify_structured(url: Column, key: Column | None = None, content_type: Column | None = None) -> Column:
    """Media type in structured records: http and https only, field names normalised."""
    url = text(url)
    low, way = F.lower(url), F.lower(U.path(url))
    key, kind = normalized_key(key if key is not None else F.lit("")), F.lower(text(content_type if content_type is not None else F.lit("")))
    out = _chain(low, way, kind, F.when(~low.rlike("^https?://"), F.lit(None).cast("string")))
    return out.when(any_term(key, ("stream", "video", "media", "mjpeg")), "stream").when(any_term(low, STREAM_TOKENS) & ~url.rlike(U.MEDIA_EXTENSION), "stream")


def classify_record_field(url: Column, key: Column, snapshot_keys: tuple[str, ...]) -> Column:
    """Media type of a field of a flat record: knows ``other``, and snapshots by the field's name."""
    url, low = text(url), F.lower(text(url))
    return (
        F.when(low.rlike("^rtsps?://"), "rtsp")
        .when(low.contains(".m3u8"), "hls")
        .when(low.rlike(r"\.(?:mjpg|mjpeg)(?:\?|$)") | key.contains("mjpeg"), "mjpeg")
        .when(low.rlike(r"\.(?:mp4|webm|mov)(?:\?|$)"), "video_file")
        .when(looks_like_image(url) | key.isin(*snapshot_keys), "image_snapshot")
        .when(low.rlike("^(?:https?|rtsps?)://") & any_term(key, ("stream", "video", "media")), "other")
    )


def extension(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(U.path(url)), U.MEDIA_SUFFIX + "$", 0), F.lit(""))


def looks_like_hls(url: Column) -> Column:
    return F.lower(F.substring_index(text(url), "?", 1)).endswith(".m3u8")


def looks_like_rtsp(url: Column) -> Column:
    return F.lower(text(url)).rlike("^rtsps?://")


def looks_like_image(url: Column) -> Column:
    return text(url).rlike(r"(?i)\.(?:jpg|jpeg|png|webp)(?:\?|$)")


def is_http(url: Column) -> Column:
    return text(url).rlike(r"^(?i:https?)://[^/?#]+")


def looks_like_thumbnail(url: Column) -> Column:
    way = F.lower(F.coalesce(F.try_url_decode(F.replace(U.path(url), F.lit("+"), F.lit("%2B"))), U.path(url)))
    segments = F.filter(F.split(way, "/"), lambda s: s != "")
    name = F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit(""))
    return F.arrays_overlap(segments, F.array(*map(F.lit, THUMB_SEGMENTS))) | any_term(way, THUMB_MARKS) | name.rlike("(?:^|[-_])(?:thumb|thumbnail|preview)(?:[-_]|$)")


def looks_like_page_asset(url: Column) -> Column:
    return any_term(F.lower(text(url)), ASSET_MARKS) | looks_like_thumbnail(url) | F.substring_index(F.lower(U.path(url)), "/", -1).isin(*DEFAULT_NAMES)


# --- effective types of rows, by consumer ---------------------------------


def _images(low: Column) -> Column:
    return ends_with_any(F.substring_index(low, "?", 1), EXTENSIONS["image_snapshot"])


def type_for_caps(declared: Column, url: Column) -> Column:
    """Default for admission: whatever isn't a stream is an image."""
    d = F.lower(text(declared))
    return F.when(d.isin("rtsp", "rtsps", "rtsp_stream"), "rtsp").when(d != "", d).when(looks_like_rtsp(url), "rtsp").when(looks_like_hls(url), "hls").otherwise("image_snapshot")


def type_for_priority(declared: Column, url: Column) -> Column:
    d, low = F.lower(F.trim(text(declared))), F.lower(text(url))
    own = F.when(d != "", d).when(low.contains(".m3u8"), "hls").when(_images(low), "image_snapshot").otherwise("unknown")
    return F.when(own == "image", "image_snapshot").when(own == "video", "video_file").otherwise(own)


def type_for_playlists(declared: Column, url: Column) -> Column:
    d, low = F.lower(text(declared)), F.lower(text(url))
    return (
        F.when(d.isin("hls", "hls_stream"), "hls")
        .when(d.isin("rtsp", "rtsps", "rtsp_stream"), "rtsp")
        .when(d.isin("image", "snapshot", "image_snapshot"), "image_snapshot")
        .when(d != "", d)
        .when(low.rlike("^rtsps?://"), "rtsp")
        .when(low.contains(".m3u8"), "hls")
        .when(_images(low), "image_snapshot")
        .otherwise("unknown_media")
    )


def type_for_records(declared: Column, url: Column) -> Column:
    d = F.lower(F.trim(text(declared)))
    return F.when(d == "rtsps", "rtsp").when(d.isin(*MEDIA_TYPES), d).when(d == "other", "stream").otherwise(F.coalesce(classify(url), F.lit("unknown_media")))


def field_role(key: Column, media_type: Column) -> Column:
    """Role of an asset by its normalised field name, else by its type."""
    exact = F.create_map(*[F.lit(x) for kv in FIELD_ROLES.items() for x in kv])
    by_type = F.create_map(*[F.lit(x) for kv in TYPE_ROLES.items() for x in kv])
    numbered = F.when(key.startswith("referenceimage") & key.endswith("url"), "reference_image_snapshot")
    return F.coalesce(exact[key], numbered, by_type[media_type], F.lit("unknown_media"))


# --- filters ---------------------------------------------------------------


class MediaFilter:
    """A parsed list of media tokens: types, extensions, or all."""

    def __init__(self, tokens: list[str] | str | None = None) -> None:
        given = [tokens] if isinstance(tokens, str) else tokens or []
        self.requested = [t.strip().lower() for v in given for t in str(v).split(",") if t.strip()] or ["all"]
        self.all = any(t in ("all", "*") for t in self.requested)
        self.types: set[str] = set(MEDIA_TYPES) if self.all else set()
        self.extensions: set[str] = set(ALL_EXTENSIONS) if self.all else set()
        unknown = []
        for t in [] if self.all else self.requested:
            name = TOKEN_NAMES.get(t, t)
            dotted = t if t.startswith(".") else "." + t
            if dotted in ALL_EXTENSIONS:
                self.extensions.add(dotted)
            elif name in MEDIA_TYPES:
                self.types |= {name, "rtsp"} if name == "stream" else {name}
                self.extensions |= set(EXTENSIONS[name])
            else:
                unknown.append(t)
        if unknown:
            names = sorted({"all", "*", *MEDIA_TYPES, *TOKEN_NAMES, *ALL_EXTENSIONS, *[e[1:] for e in ALL_EXTENSIONS]})
            raise ValueError(f"unsupported media: {', '.join(unknown)}; supported: {', '.join(names)}")

    def matches(self, media_type: Column, url: Column) -> Column:
        if self.all:
            return F.lit(True)
        return F.coalesce(media_type.isin(*sorted(self.types)) | extension(url).isin(*sorted(self.extensions)), F.lit(False))


IMAGE_MODES = ("raw", "exclude-page-assets", "camera-evidence")


def _core_text(c) -> Column:
    return F.lower(F.concat_ws(" ", *[text(c(n)) for n in ("url", "title", "description", "location_text", "camera_id", "asset_role", "asset_field", "field_path", "discovery_method")]))


def image_removal_reason(mode: str, c=F.col) -> Column:
    """Why an image record is removed in a mode, or null.  ``c`` gives the record's columns; ``metadata`` is a map."""
    mode = (mode or "raw").strip().lower()
    if mode not in IMAGE_MODES:
        raise ValueError(f"invalid image asset filter {mode!r}; expected one of: {', '.join(sorted(IMAGE_MODES))}")
    if mode == "raw":
        return F.lit(None).cast("string")
    meta = F.coalesce(c("metadata"), F.create_map().cast("map<string,string>"))
    if mode == "exclude-page-assets":
        pairs = F.array_join(F.transform(F.map_entries(meta), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")
        drop = looks_like_page_asset(c("url")) | any_term(F.concat_ws(" ", _core_text(c), F.lower(pairs)), PAGE_TERMS)
        reason = "page_asset_evidence"
    else:
        has_id = text(c("camera_record_id")) != ""
        facts = (text(c("camera_id")) != "") | c("lat").isNotNull() | c("lon").isNotNull() | c("in_service").isNotNull() | c("current_image_update_frequency").isNotNull() | c("reference_image_update_frequency").isNotNull()
        keys = F.transform(F.map_keys(meta), lambda k: normalized_key(k))
        evidence = (
            (F.coalesce(c("asset_role").isin(*CAMERA_ROLES), F.lit(False)) & has_id)
            | normalized_key(c("asset_field")).isin(*CAMERA_FIELDS)
            | (has_id & facts)
            | F.arrays_overlap(keys, F.array(*map(F.lit, CAMERA_KEYS)))
            | any_term(_core_text(c), CAMERA_TERMS)
        )
        drop, reason = ~F.coalesce(evidence, F.lit(False)), "missing_camera_image_evidence"
    return F.when((c("media_type") == "image_snapshot") & drop, reason)

"""Validation statuses: from probe results to a status, and from a status to categories.

The two categorisations disagree on purpose (``restricted_http``,
``decode_failed``): one decides trust, the other sorts a dashboard.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import media as M
from .evidence import DEAD_PARTS, LIVE
from .text import any_term, text

DEAD = ("dead_link", "offline_http", "restricted_http", "active_playlist_dead_segments", "static_image_asset", "image_snapshot_not_image", "dead_rtsp", "offline_rtsp")
RESTRICTED_PARTS = ("restricted", "auth_required", "private_network", "not_allowed", "forbidden", "401", "403")
IDLE = ("not_validated", "validation_disabled", "not_validated_media_type", "rtsp_validation_unavailable")
# Marks of static assets at validation time.
STATIC_MARKS = (
    "/services/thumb/", "/services/thumbs/", "/thumb/", "/thumbs/", "/thumbnail/", "/thumbnails/", "favicon", "apple-touch-icon", "logo", "sprite", "placeholder",
    "avatar", "/icons/", "/icon/", "/assets/", "/static/", "/template", "/banner", "seal_", "/seal", "retail",
)


def category(status: Column) -> Column:
    """live, dead or unknown: what trust follows."""
    return F.when(status.isin(*LIVE), "live").when(status.isin(*DEAD), "dead").otherwise("unknown")


def bucket(status: Column) -> Column:
    """live, not_validated, restricted, dead or unknown: what the dashboard shows."""
    s = F.lower(text(status))
    return F.when(s.isin(*LIVE), "live").when(s.isin(*IDLE) | (s == ""), "not_validated").when(any_term(s, RESTRICTED_PARTS), "restricted").when(any_term(s, DEAD_PARTS), "dead").otherwise("unknown")


def trust(status: Column, scope: Column) -> Column:
    c = category(status)
    return F.when(c == "live", F.when(scope == "in_scope", "trusted").otherwise("untrusted")).when(c == "dead", "rejected").otherwise("untrusted")


def static_by_url(url: Column) -> Column:
    return any_term(F.lower(text(url)), STATIC_MARKS)


def static_by_headers(cache_control: Column) -> Column:
    c = F.lower(text(cache_control))
    return c.contains("immutable") | F.coalesce(F.regexp_extract(c, r"max-age=(\d+)", 1).try_cast("decimal(30,0)") >= 86400, F.lit(False))


def image_bytes(head: Column) -> Column:
    """Whether the first bytes are those of a JPEG, PNG, WebP or GIF."""
    h = F.hex(F.substring(head, 1, 12))
    return F.coalesce((F.length(head) >= 8) & (h.startswith("FFD8FF") | h.startswith("89504E470D0A1A0A") | h.rlike("^52494646.{8}57454250") | h.startswith("474946383761") | h.startswith("474946383961")), F.lit(False))


def image_problem(http_status: Column, content_type: Column, head: Column) -> Column:
    """What one image response says against the image, or null."""
    return (
        F.when(http_status.isin(401, 403), "restricted_http")
        .when(http_status >= 400, "offline_http")
        .when(~(F.lower(text(content_type)).startswith("image/") | image_bytes(head)), "image_snapshot_not_image")
    )


def images_differ(first: Column, second: Column) -> Column:
    """Whether two responses (structs with etag, last_modified, body_sha) show a refreshed image."""
    changed = lambda k: F.coalesce((text(first[k]) != "") & (text(second[k]) != "") & (first[k] != second[k]), F.lit(False))
    return changed("etag") | changed("last_modified") | ~first["body_sha"].eqNullSafe(second["body_sha"])


def first_segment(body: Column) -> Column:
    """First media line of a playlist body, or null."""
    lines = F.transform(F.split(text(body), r"\r?\n"), lambda s: F.trim(s))
    good = F.filter(lines, lambda s: (s != "") & ~s.startswith("#") & F.lower(F.substring_index(s, "?", 1)).rlike(r"\.(?:ts|m3u8)$"))
    return F.try_element_at(good, F.lit(1))


def hls_status(probe: Column, segment_status: Column, check_segments: bool) -> Column:
    """Status of a playlist from its probe (struct with error, http_status, body)."""
    body = text(probe["body"])
    verified = F.when(segment_status.between(200, 299), "active_live_verified").otherwise("active_playlist_dead_segments")
    alive = F.when(first_segment(body).isNull(), "active_live_unknown").otherwise(verified) if check_segments else F.lit("active_live_unknown")
    return (
        F.when(probe.isNull() | probe["error"].isNotNull(), "dead_link")
        .when(probe["http_status"].isin(401, 403), "restricted_http")
        .when(probe["http_status"] >= 400, "offline_http")
        .when(~F.substring(body, 1, 4096).contains("#EXTM3U"), "decode_failed")
        .otherwise(alive)
    )


def image_status(url: Column, first: Column, second: Column) -> Column:
    """Status of an image from two samples (structs with error, http_status, content_type, cache_control, etag, last_modified, body_sha, body_head)."""
    failed = lambda p: p.isNull() | p["error"].isNotNull()
    problem = lambda p: image_problem(p["http_status"], p["content_type"], p["body_head"])
    return (
        F.when(static_by_url(url), "static_image_asset")
        .when(failed(first), "dead_link")
        .when(problem(first).isNotNull(), problem(first))
        .when(static_by_headers(first["cache_control"]), "static_image_asset")
        .when(failed(second), "dead_link")
        .when(problem(second).isNotNull(), problem(second))
        .when(static_by_headers(second["cache_control"]), "static_image_asset")
        .when(images_differ(first, second), "active_image_snapshot_refreshing")
        .otherwise("active_image_snapshot_static_unverified")
    )


def probe_kind(declared: Column, url: Column) -> Column:
    """How a row is probed: rtsp, image, hls, or none."""
    t = M.type_for_playlists(declared, url)
    return F.when(t == "rtsp", "rtsp").when(t == "image_snapshot", "image").when(~t.isin("hls", "hls_stream", "video", "unknown", "unknown_media") & ~F.lower(text(url)).contains(".m3u8"), "none").otherwise("hls")


def untrusted_reason(c, target_verified: Column) -> Column:
    """Why a row isn't trusted, joined; ``c`` gives its columns."""
    decided = text(c("llm_semantic_decision"))
    items = F.array(
        F.when(c("trust_level") == "rejected", "candidate trust_level is rejected"),
        F.when(c("scope_status") == "out_of_scope", "candidate scope_status is out_of_scope"),
        F.when(text(c("validation_status")) != "", F.concat(F.lit("validation_status="), c("validation_status"))),
        F.when(~decided.isin("", "in_scope"), F.concat(F.lit("llm_semantic_decision="), decided)),
        F.when(~target_verified, "target bbox is not verified for trusted output"),
    )
    own = F.array_distinct(F.filter(F.concat(items, F.coalesce(c("reasons"), F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != "")))
    return F.when(F.size(own) == 0, "not selected for trusted GeoJSON").otherwise(F.array_join(own, "; "))

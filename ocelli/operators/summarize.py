"""Summaries: counts by key, and many conditional counts in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import status as S
from ..functions import url as U
from ..functions.evidence import BANDS
from ..functions.text import text
from .rank import BUCKETS


def by_key(df: DataFrame, col: str | Column, name: str = "key") -> DataFrame:
    """Rows by key, in order; null and empty are ``unknown``."""
    c = F.col(col) if isinstance(col, str) else col
    return df.groupBy(F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("unknown")).alias(name)).agg(F.count("*").alias("n")).orderBy(name)


def by_keys(df: DataFrame, **cols: Column) -> DataFrame:
    """Rows by each of some keys in one pass: ``dimension, key, n``."""
    key = lambda c: F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("unknown"))
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), key(c).alias("key")) for n, c in cols.items()])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.key").agg(F.count("*").alias("n"))


def explained(candidates: DataFrame) -> DataFrame:
    """What a run's candidates are, in one pass: ``dimension, key, n``.

    Dimensions: ``media_type`` and ``source_provider`` of the metadata (a provider falls back on the
    discovery method, both on ``unknown``), ``origin`` (``harvest`` for rows of a handoff, else
    ``native``), ``coordinates`` (``present`` if there are both, else ``missing``).
    """
    said = lambda k: F.nullif(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    handed = F.coalesce(F.col("discovery_method") == "harvest_handoff", F.lit(False)) | said("harvest_input").isNotNull()
    return by_keys(
        candidates,
        media_type=said("media_type"),
        source_provider=F.coalesce(said("source_provider"), F.col("discovery_method")),
        origin=F.when(handed, "harvest").otherwise("native"),
        coordinates=F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), "present").otherwise("missing"),
    )


def in_fixed_order(df: DataFrame, col: str, order: tuple[str, ...]) -> DataFrame:
    """Rows by value in a given order, absent values left out."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(col))
    return df.groupBy(col).agg(F.count("*").alias("n")).orderBy(place)


def buckets(df: DataFrame) -> DataFrame:
    return in_fixed_order(df, "candidate_priority_bucket", BUCKETS)


def bands(df: DataFrame) -> DataFrame:
    return in_fixed_order(df.withColumn("camera_evidence_band", F.coalesce("camera_evidence_band", F.lit("none"))), "camera_evidence_band", BANDS)


def harvest_counts(df: DataFrame) -> DataFrame:
    """URL records by media type, provider and host, in one pass."""
    return by_keys(df, media_type=F.col("media_type"), source_provider=F.col("source_provider"), source_host=U.host(F.col("source_url")))


def harvest_summary(df: DataFrame) -> DataFrame:
    """One row of conditional counts over URL records."""
    has = lambda *cs: F.count_if(_any(*cs))

    def _any(*cs: str) -> Column:
        out = F.lit(False)
        for c in cs:
            out = out | (text(F.col(c)) != "")
        return out

    return df.agg(
        F.count("*").alias("url_records"),
        F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("records_with_coordinates"),
        has("direction", "bearing", "heading", "orientation").alias("records_with_orientation"),
        has("date", "time", "timestamp", "last_updated", "last_refresh").alias("records_with_timestamps"),
        F.count_if(F.col("in_service").isNotNull()).alias("records_with_in_service"),
        F.count_if(F.col("in_service")).alias("in_service_true"),
        F.count_if(~F.col("in_service")).alias("in_service_false"),
        has("current_image_update_frequency", "reference_image_update_frequency").alias("records_with_update_frequency"),
        F.count_if(F.col("asset_role") == "current_image_snapshot").alias("current_images"),
        F.count_if(F.col("asset_role") == "reference_image_snapshot").alias("reference_images"),
        F.count_if(F.col("asset_role").isin("streaming_video", "hls_stream")).alias("streams"),
        F.count_if(text(F.col("camera_record_id")) != "").alias("records_of_cameras"),
        F.countDistinct("camera_record_id").alias("cameras"),
    )


def camera_summary(cameras: DataFrame) -> DataFrame:
    any_text = lambda *cs: F.greatest(*[(text(F.col(c)) != "").cast("int") for c in cs]) == 1
    return cameras.agg(
        F.count("*").alias("camera_records"),
        F.coalesce(F.sum(F.size("media_assets")), F.lit(0)).alias("media_assets"),
        F.count_if(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("records_with_coordinates"),
        F.count_if(F.col("in_service").isNotNull()).alias("records_with_in_service"),
        F.count_if(any_text("timestamp", "date", "time", "last_updated", "last_refresh")).alias("records_with_timestamps"),
        F.count_if(F.col("current_image_update_frequency").isNotNull() | F.col("reference_image_update_frequency").isNotNull()).alias("records_with_update_frequency"),
    )


def candidate_summary(df: DataFrame) -> DataFrame:
    """One row: sizes of the candidate sets and locations."""
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    s = F.col("scope_status")
    return df.agg(
        F.count("*").alias("unique_candidates"),
        F.count_if(located).alias("coordinate_bearing_candidates"),
        F.count_if(s == "in_scope").alias("in_scope_candidates"),
        F.count_if(s.isin("in_scope", "review", "unknown")).alias("review_candidates"),
        F.count_if(s == "out_of_scope").alias("rejected_candidates"),
        F.count_if(located & (s == "in_scope")).alias("located_in_scope_candidates"),
        F.count_if(located & (s == "out_of_scope")).alias("located_out_of_scope_candidates"),
        F.count_if(~located).alias("unlocated_candidates"),
    )


def source_rows_summary(rows: DataFrame) -> DataFrame:
    """One row of counters over generated source rows (``source_provider, selected, blocked``); families by the part before a colon."""
    family = F.substring_index(text(F.col("source_provider")), ":", 1)
    n = lambda c, name: F.count_if(c).alias(name)
    sel, bad = F.col("selected"), F.col("blocked")
    return rows.agg(
        F.count("*").alias("generated_rows"),
        n(sel, "selected_rows"),
        *[n(sel & (family == f), f"selected_{f}_rows") for f in ("directory", "blind", "direct")],
        *[n(family == f, f"generated_{f}_rows") for f in ("directory", "blind", "direct")],
        n(bad, "blocked_source_rows"),
        n(sel & (F.col("source_provider") == "blind"), "selected_plain_blind_rows"),
    )


def evidence_summary(df: DataFrame, most: int = 10) -> dict[str, DataFrame]:
    """Bands, protocol labels, signature families, and the most frequent reasons (ties: the first met)."""
    families = df.select(F.explode("signatures.signature_family").alias("f"))
    reasons = df.select("_ord", F.posexplode("reasons").alias("k", "reason")).groupBy("reason").agg(F.count("*").alias("n"), F.min(F.struct("_ord", "k")).alias("first"))
    return {
        "bands": bands(df),
        "protocols": by_key(df, "protocol_label"),
        "families": by_key(families, "f"),
        "reasons": reasons.orderBy(F.desc("n"), "first").select("reason", "n").limit(most),
    }


def dashboard(df: DataFrame) -> DataFrame:
    """One row: totals, distinct trusted and reviewable rows, dashboard buckets."""
    bucket = S.bucket(F.col("validation_status"))
    key = F.struct(U.without_fragment(F.col("stream_url")), F.coalesce("target_id", F.lit("")))
    return df.agg(
        F.count("*").alias("total_candidates"),
        F.count_if(bucket != "not_validated").alias("validated"),
        F.countDistinct(F.when(F.col("is_trusted"), key)).alias("trusted"),
        F.countDistinct(F.when(F.col("is_review") & ~F.col("is_trusted"), key)).alias("untrusted_review"),
        *[F.count_if(bucket == b).alias(b) for b in ("dead", "restricted", "not_validated")],
    )


def dashboard_counts(df: DataFrame) -> DataFrame:
    return by_keys(df, media_type=M.type_for_playlists(F.try_element_at("metadata", F.lit("media_type")), F.col("stream_url")), validation_status=F.coalesce(F.nullif(F.lower(text(F.col("validation_status"))), F.lit("")), F.lit("not_validated")))


def host_counts(df: DataFrame, threshold: int = 3) -> DataFrame:
    """Hosts of candidates that occur often enough, most frequent first."""
    h = df.groupBy(U.host(F.col("stream_url")).alias("host")).agg(F.count("*").alias("n"), F.min("_ord").alias("_first"))
    return h.filter((F.col("host") != "") & (F.col("n") >= threshold)).orderBy(F.desc("n"), "_first").drop("_first")


def endpoint_stats(df: DataFrame) -> DataFrame:
    """Counters of extracted candidates by endpoint."""
    kind = M.type_for_caps(F.try_element_at("metadata", F.lit("media_type")), F.col("url"))
    has = lambda k: text(F.try_element_at("metadata", F.lit(k))) != ""
    record = F.try_element_at("metadata", F.lit("json_record_path"))
    n = lambda c, name: F.count_if(c).alias(name)
    return df.groupBy(F.col("source_url").alias("endpoint")).agg(
        F.countDistinct(record).alias("records_with_media"),
        n(kind == "hls", "hls_candidates"),
        n(kind == "image_snapshot", "image_snapshot_candidates"),
        n(~kind.isin("hls", "image_snapshot"), "other_media_candidates"),
        F.countDistinct(F.when(F.col("lat").isNotNull(), record)).alias("records_with_authoritative_coordinates"),
        F.countDistinct(F.when(has("camera_refresh_rate"), record)).alias("records_with_refresh_metadata"),
        F.countDistinct(F.when(has("camera_type"), record)).alias("records_with_camera_type"),
    )


TEXT_TERMS = ("camera", "cameras", "webcam", "webcams", "cctv", "live", "snapshot")


def term_score(body: Column) -> Column:
    """Occurrences of camera words in a page; overlapping words count for each."""
    out = F.lit(0)
    for t in TEXT_TERMS:
        out = out + F.regexp_count(F.lower(text(body)), F.lit(t))
    return out


def page_signals(df: DataFrame) -> DataFrame:
    """Signals of fetched pages that speak for rendering them (``page_url, body, content_type, source_kind, static_candidates``)."""
    body = text(F.col("body"))
    low = F.lower(body)
    html = F.lower(text(F.col("content_type"))).contains("html") | F.substring(low, 1, 1000).contains("<html")
    scripts = F.when(html, F.regexp_count(low, F.lit(r"<script\b"))).otherwise(0)
    bundle = html & (low.rlike(r"<script[^>]+src\s*=\s*[\"'][^\"']*(?:app|bundle|chunk|static|assets)") | low.rlike(r"(?s)<script[^>]*>[^<]{20001,}"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(body, r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " "), r"\s+", " "))
    shell = html & (scripts >= 5) & (F.length(plain) < 1500)
    hints = {
        "hls_hint": r"(?i)\.m3u8|application/x-mpegurl|application/vnd\.apple\.mpegurl",
        "map_library": r"(?i)leaflet|mapbox|openlayers|arcgis|MapServer|FeatureServer",
        "player_library": r"(?i)video\.js|hls\.js|jwplayer|clappr",
        "javascript_state": r"__NEXT_DATA__|__NUXT__|window\.__INITIAL_STATE__",
        "json_api_hint": r"(?i)/api/|\.json|/feed|/layer|MapServer|FeatureServer",
    }
    from ..functions.text import present

    kind = text(F.col("source_kind"))
    signals = present(
        (html & (scripts >= 5), "multiple_script_tags"),
        (bundle, "large_script_bundle"),
        *[(body.rlike(p), n) for n, p in hints.items()],
        (shell, "app_shell"),
        (kind.isin("dynamic", "site", "promoted_host", "site_target_page"), F.concat(F.lit("source_kind:"), kind)),
    )
    endpoint = F.when(html, low.rlike(r"<(?:a|link|script)\b[^>]+(?:href|src)\s*=\s*[\"'][^\"']*(?:\.json(?:\?|[\"'])|/api/|/feed|/layer|camera|mapserver|featureserver)")).otherwise(False)
    return df.withColumns(
        {
            "script_count": scripts,
            "dynamic_signals": signals,
            "has_endpoint_hints": endpoint,
            "camera_text_score": term_score(F.col("body")),
            "app_shell_score": F.when(shell, 2).otherwise(0),
            "has_hls_hint": body.rlike(hints["hls_hint"]),
            "title": F.substring(F.trim(F.regexp_replace(F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")), 1, 300),
        }
    )


def capture_decision(df: DataFrame, enabled: bool = True, min_score: int = 3, blocked: Column | None = None) -> DataFrame:
    """Score and skip reason of rendering each page of ``page_signals``; the budgets come after (``admit.joint_budgets``)."""
    from ..functions.text import any_term

    c, n = F.col, lambda cond, p: F.when(F.coalesce(cond, F.lit(False)), p).otherwise(0)
    family = F.substring_index(text(c("source_provider")), ":", 1)
    kind, url = text(c("source_kind")), text(c("page_url"))
    count = F.size("dynamic_signals")
    words = F.lower(F.concat_ws(" ", *[text(c(k)) for k in ("title", "snippet", "source_name")]))
    score = (
        n(kind == "dynamic", 5) + n(family.isin("directory", "asset_host_promotion"), 2) + n(family == "blind", 1) + n(c("static_candidates") == 0, 2) + F.least(F.lit(4), count)
        + n(c("camera_text_score") >= 2, 2) + n(c("has_endpoint_hints"), 1) + c("app_shell_score") + n(c("has_hls_hint"), 2) + n(any_term(words, TEXT_TERMS), 1)
    )
    skip = (
        F.when(~F.lit(enabled), "browser_capture_disabled")
        .when(~url.startswith("http"), "invalid_url")
        .when((blocked if blocked is not None else F.lit(None)).isNotNull(), "blocked_url")
        .when(M.looks_like_hls(url) | M.looks_like_image(url), "direct_media_url")
        .when(kind.isin("direct_hls", "feed") & (count == 0), "static_endpoint_already_handled")
        .when((c("static_candidates") > 0) & ~((kind == "dynamic") | (count > 0) | c("has_endpoint_hints")), "static_candidates_sufficient")
        .when(score < min_score, "score_below_threshold")
    )
    return df.withColumns({"capture_score": score.cast("int"), "skip_reason": skip})

"""Priority buckets and total orders.  Every order ends in ``_ord``, so ties are never left to chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import url as U
from ..functions.text import text

# Names of the buckets, by number.
BUCKETS = (
    "located_in_scope_direct_media", "located_review_direct_media", "located_unknown_direct_media", "unlocated_direct_media", "structured_unlocated_camera_record",
    "located_out_of_scope", "weak_or_asset_candidate",
)
STRUCTURED_KEYS = ("camera_id", "camera_name", "camera_type", "json_record_path", "json_record_schema_hint", "json_endpoint_url", "raw_camera_type")
STRUCTURED_METHODS = ("structured_json", "json_endpoint", "linked_endpoint", "harvest_handoff")
GENERIC_SLUGS = ("stream", "playlist", "m3u8", "camera", "cameras", "video", "live", "image", "snapshot", "jpg", "jpeg", "png", "webp")


def _meta(c, key: str) -> Column:
    return text(F.try_element_at(c("metadata"), F.lit(key)))


def direct_media(c=F.col) -> Column:
    kind = M.type_for_priority(_meta(c, "media_type"), c("stream_url"))
    return kind.isin("hls", "hls_stream", "image_snapshot") | F.lower(text(c("stream_url"))).contains(".m3u8")


def structured_like(c=F.col) -> Column:
    found = F.lower(text(c("discovery_method"))).isin(*STRUCTURED_METHODS)
    for k in STRUCTURED_KEYS:
        found = found | ~_meta(c, k).isin("", "[]", "{}")
    return found


def bucket(c=F.col) -> Column:
    """0, the best, to 6."""
    scope = F.lower(F.coalesce(F.nullif(text(c("scope_status")), F.lit("")), F.lit("unknown")))
    located = c("lat").isNotNull() & c("lon").isNotNull()
    out = scope == "out_of_scope"
    return (
        F.when(out & located, 5)
        .when(located & direct_media(c), F.when(scope == "in_scope", 0).when(scope == "review", 1).otherwise(2))
        .when(direct_media(c) & ~out, 3)
        .when(structured_like(c) & ~out, 4)
        .when(out, 5)
        .otherwise(6)
    )


def bucket_label(b: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BUCKETS)), b + 1)


def prioritized(df: DataFrame, score: str = "camera_evidence_score") -> DataFrame:
    """Rows by bucket, then score, then order, with both columns."""
    marked = df.withColumn("priority_bucket", bucket()).withColumn("candidate_priority_bucket", bucket_label(F.col("priority_bucket")))
    return marked.orderBy("priority_bucket", F.desc(F.coalesce(F.col(score), F.lit(0))), "_ord")


def source_rows_in_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("score"), "source_provider", "url", "_ord")


def location_slug(url: Column) -> Column:
    """Whether the path holds a token that may name a place."""
    way = F.coalesce(F.try_url_decode(F.replace(U.path(url), F.lit("+"), F.lit("%2B"))), U.path(url))
    tokens = F.transform(F.regexp_extract_all(way, F.lit("[A-Za-z][A-Za-z0-9_-]{2,}"), F.lit(0)), lambda t: F.lower(t))
    return F.size(F.array_except(tokens, F.array(*map(F.lit, GENERIC_SLUGS)))) > 0


def enrichment_rank(c=F.col, evidence: Column | None = None) -> Column:
    """0: HLS with a place in its path; 1: HLS; 2: image with evidence; 3: the rest."""
    kind = M.type_for_caps(_meta(c, "media_type"), c("stream_url"))
    return F.when((kind == "hls") & location_slug(c("stream_url")), 0).when(kind == "hls", 1).when((kind == "image_snapshot") & (evidence if evidence is not None else F.lit(True)), 2).otherwise(3)


def for_enrichment(df: DataFrame) -> DataFrame:
    return df.orderBy(enrichment_rank(), "stream_url", "_ord")


def best_geocode(df: DataFrame, *keys: str) -> DataFrame:
    """The best candidate that isn't rejected, for each key."""
    from .admit import per_key

    return per_key(df.filter("NOT rejected"), list(keys), 1, F.desc("score"), F.col("_ord"))

"""Review, validation and trust of candidates, over tables of answers and probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import status as S
from .rank import prioritized
from .scope import with_target


def reviewed(df: DataFrame, answers: DataFrame, targets: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Advisory review applied: ``answers`` (``candidate_id, _ord, decision, confidence, reason``), the last of a candidate wins.

    Out of scope needs a confidence of 0.75; in scope a verified target and
    coordinates.  A row that was rejected stays so.  ``failed``: ids of
    candidates whose batch failed; unknown ones go to review.
    """
    last = answers.groupBy("candidate_id").agg(F.max_by(F.struct("decision", "confidence", "reason"), "_ord").alias("_a"))
    out = with_target(df, targets).join(last, "candidate_id", "left")
    known = F.lower(F.coalesce("_a.decision", F.lit("review")))
    decision = F.when(F.col("_a").isNotNull(), F.when(known.isin("in_scope", "out_of_scope", "review", "unknown"), known).otherwise("review"))
    settled = (F.col("scope_status") == "out_of_scope") & F.coalesce(F.col("trust_level") == "rejected", F.lit(False))
    leaves = ~settled & (decision == "out_of_scope") & (F.coalesce("_a.confidence", F.lit(0.0)) >= 0.75)
    enters = ~settled & (decision == "in_scope") & F.coalesce("t_bbox_verified", F.lit(False)) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    waits = ~settled & decision.isin("in_scope", "review") & (F.col("scope_status") == "unknown")
    status = F.when(leaves, "out_of_scope").when(enters & (F.col("scope_status") != "out_of_scope"), "in_scope").when(~enters & waits, "review").otherwise(F.col("scope_status"))
    trust = F.when(leaves, "rejected").otherwise(F.col("trust_level"))
    reasons = F.coalesce("reasons", F.array().cast("array<string>"))
    said = F.when(decision.isNotNull(), F.concat(reasons, F.array(F.concat(F.lit("llm_semantic_review:"), decision)))).otherwise(reasons)
    out = out.withColumns({"llm_semantic_decision": decision, "llm_semantic_confidence": F.col("_a.confidence"), "llm_semantic_reason": F.substring(F.col("_a.reason"), 1, 500), "scope_status": status, "trust_level": trust, "reasons": said})
    keep = [c for c in df.columns if not c.startswith("llm_semantic_")] + ["llm_semantic_decision", "llm_semantic_confidence", "llm_semantic_reason"]
    out = out.select(*keep)
    if failed is not None:
        out = out.join(failed.select("candidate_id", F.lit(True).alias("_failed")).distinct(), "candidate_id", "left")
        out = out.withColumns({"scope_status": F.when(F.col("_failed") & (F.col("scope_status") == "unknown"), "review").otherwise(F.col("scope_status")), "reasons": F.when(F.col("_failed"), F.concat("reasons", F.array(F.lit("llm_semantic_review_failed")))).otherwise(F.col("reasons"))})
        out = out.drop("_failed")
    return out


PROBE = "stream_url string, sample int, http_status int, content_type string, etag string, last_modified string, cache_control string, body_sha string, body_head binary, body string, error string, rtsp_status string, segment_status int"


def probed(probes: DataFrame) -> DataFrame:
    """First and second probe of each URL as structs."""
    cols = F.struct(*[c for c in probes.columns if c not in ("stream_url", "sample")])
    return probes.groupBy("stream_url").agg(F.max_by(cols, F.when(F.col("sample") == 1, 1)).alias("p1"), F.max_by(cols, F.when(F.col("sample") == 2, 1)).alias("p2"))


def validated(df: DataFrame, probes: DataFrame, enabled: bool = True, check_segments: bool = False) -> DataFrame:
    """Candidates with ``validation_status`` and trust.

    With ``enabled``, in-scope rows are validated, or the reviewable ones if
    there are none; other rows keep no status.  Otherwise reviewable rows are
    ``not_validated`` and untrusted.
    """
    reviewable = F.col("scope_status").isin("in_scope", "review", "unknown")
    if not enabled:
        return df.withColumns({"validation_status": F.when(reviewable, "not_validated").otherwise(F.col("validation_status")), "trust_level": F.when(reviewable, "untrusted").otherwise(F.col("trust_level"))})
    some = not df.filter("scope_status = 'in_scope'").isEmpty()
    chosen = F.col("scope_status") == "in_scope" if some else reviewable
    kind = S.probe_kind(F.try_element_at("metadata", F.lit("media_type")), F.col("stream_url"))
    both = df.join(probed(probes), "stream_url", "left")
    status = (
        F.when(kind == "rtsp", F.coalesce("p1.rtsp_status", F.lit("rtsp_validation_unavailable")))
        .when(kind == "image", S.image_status(F.col("stream_url"), F.col("p1"), F.col("p2")))
        .when(kind == "none", "not_validated_media_type")
        .otherwise(S.hls_status(F.col("p1"), F.col("p1.segment_status"), check_segments))
    )
    out = both.withColumn("_status", F.when(chosen, status))
    trust = F.when(F.col("_status").isNotNull(), S.trust(F.col("_status"), F.col("scope_status"))).otherwise(F.col("trust_level"))
    return out.withColumns({"trust_level": trust, "validation_status": F.coalesce("_status", "validation_status")}).select(*df.columns)


def tallies(df: DataFrame) -> DataFrame:
    """Attempted, live, dead, unknown and skipped rows, in one row."""
    c, done = S.category(F.col("validation_status")), F.coalesce(~F.col("validation_status").isin("not_validated"), F.lit(False))
    n = lambda x: F.count_if(x).alias
    return df.agg(n(done)("attempted"), n(done & (c == "live"))("live"), n(done & (c == "dead"))("dead"), n(done & (c == "unknown"))("unknown"), n(~done)("skipped"))


def trusted(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Trusted, in scope, located, of a target that may be trusted."""
    may = targets.filter("trust_policy = 'trusted_allowed' AND bbox_verified").select("target_id")
    return df.filter("trust_level = 'trusted' AND scope_status = 'in_scope' AND lat IS NOT NULL AND lon IS NOT NULL").join(may, "target_id", "left_semi")


def for_review(df: DataFrame, trusted_rows: DataFrame) -> DataFrame:
    """Located rows that aren't trusted, by URL and target; a null target is a target."""
    own = trusted_rows.select(F.col("stream_url").alias("_u"), F.col("target_id").alias("_t"))
    located = df.filter("lat IS NOT NULL AND lon IS NOT NULL")
    return located.join(own, (F.col("stream_url") == F.col("_u")) & F.col("target_id").eqNullSafe(F.col("_t")), "left_anti")


def refereed(candidates: DataFrame, rankings: DataFrame) -> DataFrame:
    """Geocoder candidates with advisory rankings (``query_id, index, _ord, recommendation, confidence``): the score moves, a rejection doesn't."""
    last = rankings.groupBy("query_id", "index").agg(F.max_by(F.struct("recommendation", "confidence"), "_ord").alias("_r"))
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_r.confidence", F.lit(0.0))))
    said = F.lower(F.coalesce("_r.recommendation", F.lit("review")))
    move = F.when(said.isin("accept", "best", "in_scope"), 15 * conf).when(said.isin("reject", "out_of_scope"), -10 * conf).otherwise(3 * conf)
    out = candidates.join(last, ["query_id", "index"], "left")
    return out.withColumn("score", F.col("score") + F.when(F.col("_r").isNotNull() & ~F.col("rejected"), move).otherwise(0.0)).drop("_r")


def handoff_bounds(native: int, candidates: int, records: int, targets: int, artifact: str | None) -> None:
    """Raises if a handoff-only run holds natively found rows, or more rows than records for all targets."""
    if native:
        raise ValueError(f"handoff-only mode found {native} native candidates")
    if artifact in ("camera_urls_jsonl", "filtered_media_records") and candidates > records * max(1, targets):
        raise ValueError(f"{candidates} candidates of {records} records for {targets} targets")


#: Rows of one bucket and score that are numbered together, by their order.
SPAN = 1_000_000


def numbered(df: DataFrame) -> DataFrame:
    """Rows in priority order with ``rank`` within their target.

    Targets are few and hot, so no window holds a whole one: rows are counted by
    target, bucket, score and span of their order, and numbered within those.
    """
    rows = prioritized(df).withColumns({"_score": F.coalesce("camera_evidence_score", F.lit(0)), "_span": F.floor(F.col("_ord") / SPAN), "_target": F.coalesce("target_id", F.lit("\0"))})
    cell = ("_target", "priority_bucket", "_score", "_span")
    sizes = rows.groupBy(*cell).agg(F.count("*").alias("_n"))
    line = Window.partitionBy("_target").orderBy("priority_bucket", F.desc("_score"), "_span")
    before = sizes.withColumn("_before", F.sum("_n").over(line) - F.col("_n")).drop("_n")
    own = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*cell).orderBy("_ord")))
    done = own.join(before, list(cell)).withColumn("rank", (F.col("_rank") + F.col("_before")).cast("int"))
    return done.drop("_score", "_span", "_target", "_rank", "_before")

"""Runs: candidates of targets from payloads or a handoff, through scope, review, validation and trust, to files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import url as U
from ..functions.evidence import with_candidate_evidence
from ..functions.geo import valid
from ..functions.text import text
from ..operators import extract, merge, scope, sinks, summarize, trust
from ..operators.admit import class_capped_per
from ..operators.policy import Rule, block_reason, record_block_reason, unblocked
from ..operators.rank import prioritized


@dataclass
class RunConfig:
    profile: str = "fast"
    max_hls: int = 100
    max_images: int = 50
    max_total: int = 150
    max_geocodes: int = 0
    max_wide_geocodes: int = 0
    max_inferences: int = 0
    min_inference_confidence: float = 0.7
    refresh_delay: float = 2.0
    rules: list[Rule] = field(default_factory=list)

    @property
    def validates(self) -> bool:
        return self.profile in ("balanced", "full")

    @property
    def checks_segments(self) -> bool:
        return self.profile == "full"


CANDIDATE = (
    "candidate_id bigint, _ord bigint, set_ord int, stream_url string, source_url string, discovery_method string, title string, lat double, lon double, location_text string, scope_status string, "
    "validation_status string, trust_level string, target_id string, target_index int, target_label string, coordinate_source string, geocoded_query string, geocoded_display_name string, llm_semantic_decision string, llm_semantic_confidence double, llm_semantic_reason string, reasons array<string>, metadata map<string,string>"
)


def shaped(df: DataFrame) -> DataFrame:
    """``df`` with all columns of a candidate, absent ones null."""
    kinds = [tuple(x.strip().split(" ", 1)) for x in CANDIDATE.split(", ")]
    have = set(df.columns)
    out = df.select(*[(F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in kinds])
    return out.withColumns({"reasons": F.coalesce("reasons", F.array().cast("array<string>")), "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>")), "scope_status": F.coalesce("scope_status", F.lit("unknown")), "trust_level": F.coalesce("trust_level", F.lit("untrusted"))})


def described(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Defaults of metadata: the target's camera type, HLS by the URL, the id from the URL."""
    both = scope.with_target(df, targets)
    add = F.map_filter(
        F.map_from_arrays(
            F.array(F.lit("camera_type"), F.lit("media_type"), F.lit("camera_id")),
            F.array(F.coalesce(F.nullif(F.col("t_camera_type"), F.lit("")), F.lit("camera")), F.when(M.looks_like_hls(F.col("stream_url")), "hls"), U.camera_id(F.col("stream_url"))),
        ),
        lambda k, v: v.isNotNull() & ~F.map_contains_key("metadata", k),
    )
    return both.withColumns({"metadata": F.map_concat("metadata", add), "target_index": F.coalesce("target_index", "t_target_index"), "target_label": F.coalesce("target_label", "t_target_label", "t_canonical_target")}).select(*df.columns)


def discovered(payloads: DataFrame, targets: DataFrame, config: RunConfig) -> DataFrame:
    """Candidates of payloads (``target_id`` included): extracted, admitted under caps for each target, folded by URL."""
    own = unblocked(payloads, config.rules, "payload_url").filter("status IS NULL OR status < 400")
    found = extract.run_candidates(own, keep="target_id")
    rows = shaped(found.withColumnRenamed("url", "stream_url").withColumn("_ord", (F.col("payload_ord") * 1000000 + F.col("record_ord")).cast("long")))
    rows = rows.filter(record_block_reason(F.col("stream_url"), F.col("source_url"), config.rules).isNull()) if config.rules else rows
    kind = M.type_for_caps(F.try_element_at("metadata", F.lit("media_type")), F.col("stream_url"))
    admitted = class_capped_per(rows, ["target_id"], kind == "hls", config.max_hls, config.max_images, config.max_total, "_ord")
    return described(merge.fold_candidates(admitted, "target_id"), targets)


def from_handoff(records: DataFrame, targets: DataFrame, rules: list[Rule]) -> DataFrame:
    """Candidates of handed-over records for all targets: one for each asset, or for the record's own URL."""
    own = F.array(F.struct(*[F.col(c).cast("string").alias(c) for c in ("asset_id", "url", "media_type", "asset_role", "asset_field", "source_url", "title", "location_text", "coordinate_source", "lat", "lon")]))
    of = lambda a: F.struct(*[a[c].alias(c) for c in ("asset_id",)], F.coalesce(F.nullif(a["url"], F.lit("")), a["media_url"]).alias("url"), *[a[c].alias(c) for c in ("media_type", "asset_role", "asset_field", "source_url", "title", "location_text", "coordinate_source", "lat", "lon")])
    assets = F.when(F.coalesce(F.size("media_assets"), F.lit(0)) > 0, F.transform("media_assets", of)).otherwise(own)
    rows = records.select("*", F.posexplode(assets).alias("_k", "a")).filter(text(F.trim("a.url")) != "")
    lat, lon = F.col("lat").try_cast("double"), F.col("lon").try_cast("double")
    lat2, lon2 = F.col("a.lat").try_cast("double"), F.col("a.lon").try_cast("double")
    keys = ("camera_record_id", "camera_id", "source_endpoint_url", "source_page_url", "source_provider", "source_name", "json_record_path", "direction", "bearing", "heading", "orientation", "in_service", "status", "timestamp", "last_updated", "last_refresh", "image_description", "current_image_update_frequency", "reference_image_update_frequency")
    values = {k: F.col(k) for k in keys} | {"media_type": F.coalesce("a.media_type", "media_type"), "asset_id": F.col("a.asset_id"), "asset_role": F.col("a.asset_role"), "asset_field": F.col("a.asset_field"), "harvest_input": F.lit("true"), "source_provided_only": F.lit("true")}
    meta = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*[v.cast("string") for v in values.values()])), lambda k, v: v.isNotNull() & (v != ""))
    out = rows.select(
        (F.col("_ord") * 1000 + F.col("_k")).cast("long").alias("_ord"),
        U.canonical(F.col("a.url")).alias("stream_url"),
        F.coalesce(F.nullif(F.col("a.source_url"), F.lit("")), "source_endpoint_url", "source_page_url").alias("source_url"),
        F.lit("harvest_handoff").alias("discovery_method"),
        F.coalesce(F.nullif(F.col("title"), F.lit("")), "a.title").alias("title"),
        F.when(valid(lat, lon), lat).when(valid(lat2, lon2), lat2).alias("lat"),
        F.when(valid(lat, lon), lon).when(valid(lat2, lon2), lon2).alias("lon"),
        F.coalesce(F.nullif(F.col("location_text"), F.lit("")), "a.location_text").alias("location_text"),
        F.coalesce(F.nullif(F.col("coordinate_source"), F.lit("")), "a.coordinate_source").alias("coordinate_source"),
        meta.alias("metadata"),
        F.array(F.lit("seeded from harvest input; still unvalidated/untrusted until normal run processing")).alias("reasons"),
    )
    out = out.filter(block_reason(F.col("stream_url"), rules).isNull()) if rules else out
    return shaped(scope.per_target(out, targets))


def finished(candidates: DataFrame, targets: DataFrame, probes: DataFrame, config: RunConfig) -> DataFrame:
    """Validated candidates with evidence, priority, and whether they are trusted or for review."""
    # Whether anything is in scope decides what is validated, so candidates are used twice.
    done = trust.validated(candidates.persist(), probes, config.validates, config.checks_segments)
    scored = with_candidate_evidence(done, record_block_reason(F.col("stream_url"), F.col("source_url"), config.rules), "_e").withColumns(
        {
            "camera_evidence_score": F.col("_e.score"),
            "camera_evidence_band": F.col("_e.band"),
            "evidence_reasons": F.col("_e.reasons"),
            "signatures": F.col("_e.signatures"),
            "protocol_label": F.col("_e.protocol.protocol_label"),
            "media_family": F.col("_e.protocol.media_family"),
            "protocol_confidence": F.col("_e.protocol.protocol_confidence"),
            "why_candidate_mattered": F.col("_e.why"),
        }
    )
    may = targets.filter("trust_policy = 'trusted_allowed' AND bbox_verified").select(F.col("target_id").alias("_may")).distinct()
    both = scored.drop("_e").join(may, F.col("target_id") == F.col("_may"), "left")
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    good = (F.col("trust_level") == "trusted") & (F.col("scope_status") == "in_scope") & located & F.col("_may").isNotNull()
    out = both.withColumns({"is_trusted": F.coalesce(good, F.lit(False)), "is_review": located & ~F.coalesce(good, F.lit(False))}).drop("_may")
    return prioritized(out)


def native(payloads: DataFrame, targets: DataFrame, geocodes: DataFrame, probes: DataFrame, config: RunConfig, answers: DataFrame | None = None, inferred: DataFrame | None = None) -> DataFrame:
    """A run over payloads; targets that stop are left out."""
    live = targets.filter("trust_policy <> 'stop'")
    own = discovered(payloads, live, config)
    located = scope.enriched(own, live, geocodes, config.max_geocodes, config.max_wide_geocodes, inferred, config.min_inference_confidence, config.max_inferences)
    placed = scope.scoped(located, live)
    if answers is not None:
        placed = trust.reviewed(placed, answers, live)
    return finished(merge.merge_target_sets(placed), live, probes, config)


def handed_over(records: DataFrame, targets: DataFrame, probes: DataFrame, config: RunConfig, artifact: str | None = None, natives: DataFrame | None = None) -> DataFrame:
    """A run over a handoff; ``natives`` are candidates of a native run to combine with, else the bounds of a handoff alone are checked."""
    live = targets.filter("trust_policy <> 'stop'")
    own = scope.scoped(from_handoff(records, live, config.rules), live, "harvest_input_").withColumn("set_ord", F.lit(1))
    if natives is None:
        trust.handoff_bounds(0, own.count(), records.count(), live.count(), artifact)
        rows = own
    else:
        rows = shaped(natives).withColumn("set_ord", F.lit(0)).unionByName(own)
    return finished(merge.merge_target_sets(described(rows, live)), live, probes, config)


def write(done: DataFrame, targets: DataFrame, path: str, config: RunConfig) -> dict:
    """All artifacts of a run; a trusted file only if something is trusted.  Returns the summary."""
    spark: SparkSession = done.sparkSession
    rows = done.persist()
    summary = {**sinks.one_row(summarize.candidate_summary(rows)), **sinks.one_row(trust.tallies(rows)), "dashboard": sinks.one_row(summarize.dashboard(rows))}
    sinks.write_csv(sinks.candidate_table(rows, config.refresh_delay), f"{path}/camera_candidates_table_csv")
    sinks.write_by_target(rows.select("target_id", "_ord", "stream_url", "scope_status", "trust_level", "lat", "lon"), f"{path}/candidates_by_target")
    for name, flag in (("trusted", True), ("untrusted", False)):
        own = rows.filter("is_trusted" if flag else "is_review")
        if not own.isEmpty():
            sinks.write_text(sinks.features(own, targets, flag, config.refresh_delay), f"{path}/{name}_features", "_ord")
    sinks.write_jsonl(sinks.target_features(targets), f"{path}/target_geometry")
    sinks.write_jsonl(summarize.explained(rows).coalesce(1), f"{path}/run_explanation")
    summary["playlists"] = sinks.write_playlists(sinks.playlist_rows(rows, config.rules), f"{path}/playlists", sinks.CANDIDATE_LISTS)
    sinks.write_text(sinks.markdown_rows(rows, "title", "stream_url", "scope_status", "trust_level"), f"{path}/cameras_md", "_ord")
    sinks.write_json(spark, summary, f"{path}/summary")
    rows.unpersist()
    return summary

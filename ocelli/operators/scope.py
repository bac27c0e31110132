"""Coordinates and scope of candidates.

Targets are few short rows but for their polygons; they are joined by id and
broadcast only while ``FEW`` bounds them, otherwise the join shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce as N
from ..functions import geo as G
from ..functions import url as U
from ..functions.text import any_term, distinct_ignoring_case, place_token, present, text
from .rank import location_slug

FEW = 10_000
FEW_POINTS = 2_000_000
POLYGONS = "array<array<array<struct<lon:double,lat:double>>>>"
TARGET = f"target_id string, target_index int, target_label string, canonical_target string, scope_type string, admin_region string, country string, place_name string, camera_type string, bbox struct<min_lat:double,max_lat:double,min_lon:double,max_lon:double>, polygons {POLYGONS}, bbox_verified boolean, trust_policy string"


def few(targets: DataFrame) -> bool:
    """Whether targets may be broadcast: few rows, and few points in their polygons (16 bytes each)."""
    points = F.size(F.flatten(F.flatten("polygons"))) if dict(targets.dtypes).get("polygons") == POLYGONS else F.lit(0)
    size = targets.limit(FEW + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(points, F.lit(0))), F.lit(0)).alias("points")).first()
    return size["n"] <= FEW and size["points"] <= FEW_POINTS


def with_target(df: DataFrame, targets: DataFrame) -> DataFrame:
    """``df`` with its target's columns as ``t_...``; rows without a target keep nulls."""
    small = few(targets)
    own = targets.select(*[F.col(c).alias(f"t_{c}") for c in targets.columns])
    return df.join(F.broadcast(own) if small else own, df["target_id"] == own["t_target_id"], "left")


def per_target(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Every record for every target: as many rows as records times targets, which is what is asked for; filter records by their source first."""
    own = targets.select("target_id", "target_index", "target_label")
    small = few(own)
    # Each task meets all targets: the smaller side is the one that is sent around.
    return records.crossJoin(F.broadcast(own) if small else own)


#: Edges that a band of a polygon has on average, and most bands of a target.
BAND_EDGES, BANDS = 16, 1 << 16
EDGE = "struct<poly:int,ring:int,p:struct<lat:double,lon:double>,q:struct<lat:double,lon:double>>"


def _band(lat: Column, low: Column, height: Column, bands: Column) -> Column:
    """The band of a latitude; it never falls as latitudes rise, so an edge lies in the bands of its ends and those between."""
    return F.least(bands - 1, F.greatest(F.lit(0), F.floor((lat - low) / height))).cast("int")


def polygon_bands(targets: DataFrame, closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """The targets' polygons cut into bands of latitude.

    ``(frames, bands)``: for each target with a polygon its lowest latitude, the
    height and number of its bands; and for each band of a target the edges that
    reach into it.  Points without numbers hold no edge.  Level edges are never crossed
    and are left out, unless rings are ``closed``: then points may lie on them.
    """
    rings = targets.filter(F.size("polygons") > 0).select("target_id", F.posexplode("polygons").alias("poly", "rings")).select("target_id", "poly", F.posexplode("rings").alias("ring", "points"))
    n = F.size("points")
    # Each point with the one before it; the last one closes the ring.
    pairs = F.arrays_zip(F.col("points").alias("p"), F.concat(F.slice("points", -1, 1), F.slice("points", F.lit(1), n - 1)).alias("q"))
    edges = rings.filter(n >= 3).select("target_id", "poly", "ring", F.explode(pairs).alias("e")).select("target_id", "poly", "ring", "e.p", "e.q")
    whole = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    edges = edges.filter(whole("p.lat") & whole("p.lon") & whole("q.lat") & whole("q.lon"))
    frames = edges.groupBy("target_id").agg(F.min("p.lat").alias("low"), F.max("p.lat").alias("high"), F.count("*").alias("n"))
    frames = frames.withColumn("bands", F.least(F.lit(BANDS), F.ceil(F.col("n") / BAND_EDGES)).cast("int")).withColumn("height", F.greatest((F.col("high") - F.col("low")) / F.col("bands"), F.lit(1e-300)))
    frames = frames.select("target_id", "low", "height", "bands")
    at = lambda c: _band(F.col(c), F.col("low"), F.col("height"), F.col("bands"))
    cut = (edges if closed else edges.filter("p.lat <> q.lat")).join(frames, "target_id")
    cut = cut.select("target_id", F.struct("poly", "ring", "p", "q").alias("edge"), F.explode(F.sequence(F.least(at("p.lat"), at("q.lat")), F.greatest(at("p.lat"), at("q.lat")))).alias("band"))
    return frames, cut.groupBy("target_id", "band").agg(F.collect_list("edge").alias("edges"))


def with_inside(df: DataFrame, bands: DataFrame, lat: Column, lon: Column, out: str = "_inside", closed: bool = False) -> DataFrame:
    """Adds whether a point is in its target's polygons: within a first ring and none of its other rings; ``closed`` rings hold their edges.

    ``df`` has ``t_target_id`` and the frame's columns as ``t_low, t_height, t_bands``.
    A point meets the edges of its own band alone, by an equi-join; no other edge can
    cross its latitude, so the even-odd rule over these is exact.
    """
    own = F.when(F.col("t_bands").isNotNull() & lat.isNotNull() & lon.isNotNull(), _band(lat, F.col("t_low"), F.col("t_height"), F.col("t_bands")))
    met = df.withColumn("_own_band", own).join(bands.select(F.col("target_id").alias("_b_target"), F.col("band").alias("_b_band"), "edges"), (F.col("t_target_id") == F.col("_b_target")) & (F.col("_own_band") == F.col("_b_band")), "left")
    rings = lambda hit: F.transform(F.filter("edges", lambda e: hit(lat, lon, e["p"], e["q"])), lambda e: F.struct(e["poly"].alias("poly"), e["ring"].alias("ring")))
    met = met.withColumn("_crossed", rings(G.crosses))
    odd = F.filter(F.array_distinct("_crossed"), lambda x: F.size(F.filter("_crossed", lambda y: y == x)) % 2 == 1)
    if closed:
        odd = F.array_union(odd, rings(G.touches))
    met = met.withColumn("_odd", odd)
    inside = F.exists("_odd", lambda x: (x["ring"] == 0) & ~F.exists("_odd", lambda y: (y["poly"] == x["poly"]) & (y["ring"] > 0)))
    return met.withColumn(out, F.coalesce(inside, F.lit(False))).drop("_own_band", "_b_target", "_b_band", "edges", "_crossed", "_odd")


def scope(lat: Column, lon: Column, bbox: Column, polygons: Column, verified: Column, prefix: str = "", inside: Column | None = None) -> Column:
    """Struct of ``scope_status, rejected, reason``: a verified polygon decides, then a verified box; else review or unknown.

    ``inside``: whether the point is in the polygons, if that is known (``with_inside``).
    """
    within = G.in_polygons(lat, lon, polygons) if inside is None else inside
    located = lat.isNotNull() & lon.isNotNull()
    verified = F.coalesce(verified, F.lit(False))
    shape, box = located & verified & F.coalesce(F.size(polygons) > 0, F.lit(False)), located & verified & bbox.isNotNull()

    def r(status: str, rejected: bool, reason: str) -> Column:
        return F.struct(F.lit(status).alias("scope_status"), F.lit(rejected).alias("rejected"), F.lit(prefix + reason).alias("reason"))

    return (
        F.when(shape, F.when(within, r("in_scope", False, "coordinate_inside_verified_target_polygon")).otherwise(r("out_of_scope", True, "coordinate_outside_verified_target_polygon")))
        .when(box, F.when(G.in_box(lat, lon, bbox), r("in_scope", False, "coordinate_inside_verified_bbox")).otherwise(r("out_of_scope", True, "coordinate_outside_verified_bbox")))
        .when(located, r("review", False, "coordinate_available_but_target_bbox_untrusted_or_missing"))
        .otherwise(r("unknown", False, "missing_candidate_coordinates"))
    )


def scoped(df: DataFrame, targets: DataFrame, prefix: str = "", closed: bool = False) -> DataFrame:
    """Candidates with ``scope_status``, and rejected where they are outside.

    Of a ring's own points the even-odd rule takes those of lower edges; with ``closed`` a
    ring holds all of them, so that a hole's edge is outside.

    Targets go to candidates without their polygons, of which a candidate meets the
    edges in its band of latitude; a target may have any number of edges.
    """
    frames, bands = polygon_bands(targets, closed)
    # Whether there is a polygon; its points stay behind.
    light = targets.withColumn("polygons", F.size("polygons") > 0).join(frames, "target_id", "left")
    both = with_inside(with_target(df, light), bands, F.col("lat"), F.col("lon"), closed=closed)
    shape = F.when(F.col("t_polygons"), F.array(F.lit(1)))
    s = scope(F.col("lat"), F.col("lon"), F.col("t_bbox"), shape, F.col("t_bbox_verified"), prefix, F.col("_inside"))
    out = both.withColumn("_scope", s)
    trust = F.when(F.col("_scope.rejected"), "rejected").otherwise(F.col("trust_level"))
    reasons = F.concat(F.coalesce("reasons", F.array().cast("array<string>")), F.array("_scope.reason"))
    return out.withColumns({"scope_status": F.col("_scope.scope_status"), "trust_level": trust, "reasons": reasons}).select(*df.columns)


def geocode_passes(lat: Column, lon: Column, bbox: Column, polygons: Column, verified: Column) -> Column:
    """Struct of ``passes, reason`` for a geocoder's answer."""
    verified = F.coalesce(verified, F.lit(False))
    inside, within = G.in_polygons(lat, lon, polygons), G.in_box(lat, lon, bbox)
    r = lambda ok, reason: F.struct(F.lit(ok).alias("passes"), F.lit(reason).alias("reason"))
    return (
        F.when(verified & F.coalesce(F.size(polygons) > 0, F.lit(False)), F.when(inside, r(True, "coordinate_inside_verified_target_polygon")).otherwise(r(False, "candidate_geocode_outside_verified_target_polygon")))
        .when(verified & bbox.isNotNull(), F.when(within, r(True, "coordinate_inside_verified_bbox")).otherwise(r(False, "candidate_geocode_outside_verified_target_bbox")))
        .otherwise(r(True, "target_bbox_unverified_review_only"))
    )


# --- texts that name a place ----------------------------------------------

CLUES = (
    r"(?i)\b(?:I-|I\s*|SR\s*|US\s*)\d+\b", r"(?i)\b(?:at|near|and|@)\b", r"(?i)\b(?:NB|SB|EB|WB|northbound|southbound|eastbound|westbound)\b", r"(?i)\b\d+(?:st|nd|rd|th)\b",
    r"(?i)\b(?:St|Street|Rd|Road|Ave|Avenue|Blvd|Boulevard|Dr|Drive|Hwy|Highway)\b",
)
GENERIC = ("live traffic cameras", "traffic cameras", "road conditions", "camera map", "webcams")


def names_place(value: Column, target: list[Column]) -> Column:
    """Whether a text is specific enough to geocode: not a generic page title of the target."""
    t = F.trim(text(value))
    low = F.lower(t)
    clue = F.lit(False)
    for c in CLUES:
        clue = clue | t.rlike(c)
    about = F.lit(False)
    for x in target:
        about = about | ((text(x) != "") & low.contains(F.lower(text(x))))
    generic = about & any_term(low, GENERIC)
    roads = generic & low.contains("road conditions") & ~t.rlike(r"(?i)\b(?:at|near|@|I-|SR\s*|US\s*)\d*")
    path = t.rlike(r"^[A-Za-z0-9_.:/?=&%-]+$") & t.contains("/")
    return (F.length(t) >= 4) & ~low.isin("camera", "cameras", "traffic", "webcam", "snapshot", "image") & ~path & ~roads & (clue | ~generic) & t.rlike(r"\p{L}")


def with_geocode_query(df: DataFrame, out: str = "geocode_query") -> DataFrame:
    """Adds the query for a candidate's place (rows of ``with_target``): the first specific metadata, else its own text or title, with the target's context; null if none."""
    context = [F.col(f"t_{k}") for k in ("canonical_target", "target_label", "admin_region", "country")]
    meta = lambda k: F.try_element_at("metadata", F.lit(k))
    keys = ("location_display", "location_text", "intersection", "cross_street", "route", "road", "direction", "city", "county", "district", "camera_name")
    structured = F.when(text(meta("json_metadata_extracted")) == "true", meta("camera_id"))
    # One test over an array of texts rather than one for each text.
    values = F.array(*[text(v) for v in (*map(meta, keys), structured, F.col("location_text"), F.col("title"))])
    first = F.trim(F.try_element_at(F.filter(values, lambda v: names_place(v, context)), F.lit(1)))
    suffix = F.array_join(distinct_ignoring_case(present(*[(text(x) != "", x) for x in (context[0], context[2], context[3])])), ", ")
    mid = df.withColumns({"_g_first": first, "_g_suffix": suffix})
    same = F.lit(False)
    for x in context:
        same = same | (F.lower("_g_first") == F.lower(text(x)))
    full = F.when((F.col("_g_suffix") != "") & ~F.lower("_g_first").contains(F.lower("_g_suffix")), F.concat_ws(", ", "_g_first", "_g_suffix")).otherwise(F.col("_g_first"))
    return mid.withColumn(out, F.when(F.col("_g_first").isNotNull() & ~same, F.substring(full, 1, 300))).drop("_g_first", "_g_suffix")


def safe_geocode_query(value: Column) -> Column:
    t = F.trim(text(value))
    low = F.lower(t)
    return F.length(t).between(3, 300) & ~t.rlike(r"(?<!\d)[-+]?\d{1,2}\.\d{3,}\s*,\s*[-+]?\d{1,3}\.\d{3,}(?!\d)") & ~any_term(low, ("latitude", "longitude", " lat ", " lon ")) & ~t.rlike(r"^https?://\S+$") & t.rlike(r"\p{L}")


def with_context(query: Column, parts: list[Column]) -> Column:
    """A query with the parts that it doesn't hold yet, at most 300 characters."""
    out = F.trim(text(query))
    for p in parts:
        v = F.trim(text(p))
        out = F.when((v != "") & ~F.lower(out).contains(F.lower(v)), F.concat(out, F.when(out != "", ", ").otherwise(""), v)).otherwise(out)
    return F.substring(out, 1, 300)


def evidence_supported(evidence: Column, haystack: Column) -> Column:
    """Whether any evidence token is in the candidate's text, as it is or without separators."""
    low = F.lower(text(haystack))
    tight = F.regexp_replace(low, "[^a-z0-9]+", "")
    compact = lambda x: F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "")
    hit = F.exists(evidence, lambda x: (F.length(F.trim(x)) >= 2) & (low.contains(F.lower(F.trim(x))) | ((compact(x) != "") & tight.contains(compact(x)))))
    return F.coalesce(hit, F.lit(False))


def too_broad(precision: Column, query: Column, display: Column, target: list[Column]) -> Column:
    """Whether an inferred place is no more than the target."""
    known = F.array_distinct(F.array(*[place_token(x) for x in target], F.lit("united states"), F.lit("usa")))
    known = F.filter(known, lambda k: k != "")
    longest = F.array_sort(known, lambda a, b: F.length(b) - F.length(a))
    rest = F.aggregate(longest, place_token(query), lambda acc, k: F.replace(acc, k, F.lit(" ")))
    left = F.filter(F.split(rest, " +"), lambda w: F.length(w) >= 3)
    broad = F.lower(text(precision)).isin("state", "country", "region", "county", "province", "administrative", "admin")
    return broad | F.array_contains(known, place_token(query)) | F.array_contains(known, place_token(display)) | (F.size(left) == 0)


def inferred_places(rows: DataFrame) -> DataFrame:
    """Normalised answers about a candidate's place (``candidate_id, query, variants, evidence, confidence, ...``): safe queries, five best for each candidate."""
    from .admit import per_key

    clean = lambda a, n: F.slice(distinct_ignoring_case(F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: (x != ""))), 1, n)
    good = rows.filter(safe_geocode_query(F.col("query"))).withColumns(
        {
            "query": F.substring(F.trim("query"), 1, 300),
            "variants": F.slice(distinct_ignoring_case(F.filter(F.coalesce("variants", F.array().cast("array<string>")), safe_geocode_query)), 1, 5),
            "evidence": clean(F.coalesce("evidence", F.array().cast("array<string>")), 12),
            "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0)))),
        }
    )
    return per_key(good, ["candidate_id"], 5, F.desc("confidence"), F.col("_ord"))


def own_coordinates(c=F.col) -> Column:
    """(lat, lon) that a candidate's metadata or URLs give, or null."""
    lat_keys, lon_keys = ("lat", "latitude", "camera_latitude", "y", "data_lat"), ("lon", "lng", "longitude", "camera_longitude", "x", "data_lon")
    asked = lambda url: F.when(text(url).contains("?"), U.query_map(url))
    maps = F.filter(F.array(c("metadata"), asked(c("stream_url")), asked(c("source_url"))), lambda m: F.size(m) > 0)
    first = lambda m, keys: F.coalesce(*[N.whole_number(F.try_element_at(m, F.lit(k))) for k in keys])
    # A map is a variable of the function, so each URL is taken apart once and not for each key.
    points = F.transform(maps, lambda m: F.struct(first(m, lat_keys).alias("lat"), first(m, lon_keys).alias("lon")))
    return F.try_element_at(F.filter(points, lambda p: G.valid(p["lat"], p["lon"])), F.lit(1))


CONFLICT_KM = 25.0


def enriched(df: DataFrame, targets: DataFrame, geocodes: DataFrame, limit: int, wide_limit: int = 0, inferred: DataFrame | None = None, min_confidence: float = 0.7, inference_limit: int = 0) -> DataFrame:
    """Candidates with coordinates by precedence: their own, metadata or URL, a geocoded place, an inferred place that is geocoded.

    ``geocodes``: answers (``query, lat, lon, display_name``), used as a cache.
    ``limit``: how many candidates are geocoded, in enrichment order (0: none);
    targets of regional scope may use up to ``wide_limit``.  ``inferred``: places
    (``candidate_id, query, variants, evidence, confidence, precision``) for rows
    with a ``candidate_id``; they never bring coordinates themselves.  Located
    rows whose coordinates come from nearby text are compared with their
    inferred place and flagged beyond ``CONFLICT_KM``.
    """
    from .rank import enrichment_rank

    base = with_target(df, targets)
    own = own_coordinates()
    base = base.withColumn("_own", F.when(F.col("lat").isNull() | F.col("lon").isNull(), own))
    # Only rows without any coordinates are asked for, and only those that are admitted take their query and answer along.
    bare = with_geocode_query(base.filter((F.col("lat").isNull() | F.col("lon").isNull()) & F.col("_own").isNull()), "_query")
    asked = bare.filter("_query IS NOT NULL").select("target_id", "_ord", "_query", enrichment_rank().alias("_r"), "stream_url", F.lower(text(F.col("t_scope_type"))).isin("state", "region", "country", "metro", "county").alias("_wide"))
    admitted = _admitted(asked, limit, wide_limit)
    cache = geocodes.filter(G.valid(F.col("lat"), F.col("lon"))).groupBy("query").agg(F.min(F.struct("lat", "lon", "display_name")).alias("_g"))
    answered = admitted.join(cache.withColumnRenamed("query", "_query"), "_query", "left").select("target_id", "_ord", "_query", "_g")
    out = base.join(answered, ["target_id", "_ord"], "left")
    passes = geocode_passes(F.col("_g.lat"), F.col("_g.lon"), F.col("t_bbox"), F.col("t_polygons"), F.col("t_bbox_verified"))
    out = out.withColumn("_ok", F.when(F.col("_g").isNotNull(), passes))
    if inferred is not None and inference_limit:
        out = _with_inferred(out, inferred, cache, min_confidence, inference_limit)
    else:
        out = out.withColumn("_i", F.lit(None).cast("struct<lat:double,lon:double,display_name:string,query:string>"))
    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    use_own, use_geo = F.col("_own").isNotNull(), F.coalesce(F.col("_ok.passes"), F.lit(False))
    use_inferred = ~located & ~use_own & ~use_geo & F.col("_i").isNotNull()
    pick = lambda k: F.when(located, F.col(k)).when(use_own, F.col(f"_own.{k}")).when(use_geo, F.col(f"_g.{k}")).when(use_inferred, F.col(f"_i.{k}"))
    km = G.haversine_km(F.col("lat"), F.col("lon"), F.col("_i.lat"), F.col("_i.lon"))
    conflict = located & (F.col("coordinate_source") == "proximity_text") & (km >= CONFLICT_KM)
    said = present(
        (~located & use_own, "coordinates_extracted_from_candidate_metadata"),
        (~located & ~use_own & use_geo, "coordinates_geocoded_from_candidate_metadata"),
        (~located & ~use_own & F.col("_ok").isNotNull() & ~use_geo, F.col("_ok.reason")),
        (use_inferred, "coordinates_geocoded_from_llm_inferred_location_name"),
        (F.coalesce(conflict, F.lit(False)), "coordinate_conflict_between_proximity_text_and_llm_geocode"),
    )
    source = F.when(located, F.col("coordinate_source")).when(use_own, F.coalesce("coordinate_source", F.lit("candidate_metadata"))).when(use_geo, "candidate_geocoder").when(use_inferred, "llm_url_location_nominatim")
    return out.withColumns(
        {
            "lat": pick("lat"),
            "lon": pick("lon"),
            "coordinate_source": source,
            "geocoded_query": F.when(~located & ~use_own & use_geo, F.col("_query")).when(use_inferred, F.col("_i.query")),
            "geocoded_display_name": F.when(~located & ~use_own & use_geo, F.col("_g.display_name")).when(use_inferred, F.col("_i.display_name")),
            "reasons": F.concat(F.coalesce("reasons", F.array().cast("array<string>")), said),
            "conflict_km": F.when(conflict, F.round(km, 3)),
        }
    ).select(*[c for c in df.columns if c not in ("geocoded_query", "geocoded_display_name")], "geocoded_query", "geocoded_display_name", "conflict_km")


def _admitted(asked: DataFrame, limit: int, wide_limit: int) -> DataFrame:
    """The first of each target in enrichment order, up to its limit."""
    from pyspark.sql import Window

    w = Window.partitionBy("target_id").orderBy("_r", "stream_url", "_ord")
    most = F.when(F.col("_wide"), F.lit(max(limit, wide_limit) if limit else 0)).otherwise(F.lit(limit))
    # The constant bound cuts ranks before the shuffle; the column's own comes after.
    return asked.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= max(limit, wide_limit)).filter(F.col("_rank") <= most)


def _with_inferred(out: DataFrame, inferred: DataFrame, cache: DataFrame, least: float, limit: int) -> DataFrame:
    """``_i``: the first inferred place that is confident, supported, resolved, specific and in scope."""
    from pyspark.sql import Window

    context = [F.col(f"t_{k}") for k in ("canonical_target", "target_label", "admin_region", "country")]
    hay = F.concat_ws(" ", "stream_url", "source_url", "title", "location_text", F.array_join(F.map_keys("metadata"), " "), F.array_join(F.map_values("metadata"), " "))
    w = Window.partitionBy("target_id").orderBy("_ord")
    rows = out.withColumn("_hay", hay).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") <= limit) & (location_slug(F.col("stream_url")) | F.col("_hay").rlike("[A-Za-z][A-Za-z0-9_-]{2,}")))
    asked = inferred_places(inferred).filter(F.col("confidence") >= least).withColumn("_place", F.row_number().over(Window.partitionBy("candidate_id").orderBy(F.desc("confidence"), "_ord"))).drop("_ord")
    both = rows.select("candidate_id", "_hay", "t_bbox", "t_polygons", "t_bbox_verified", *[f"t_{k}" for k in ("canonical_target", "target_label", "admin_region", "country")]).join(asked, "candidate_id")
    both = both.filter(evidence_supported(F.col("evidence"), F.col("_hay")))
    tries = both.select("*", F.posexplode(F.slice(distinct_ignoring_case(F.concat(F.array("query"), "variants")), 1, 5)).alias("_k", "_q"))
    tries = tries.withColumn("_full", with_context(F.col("_q"), [context[0], context[2], context[3]])).join(cache.withColumnRenamed("query", "_full").withColumnRenamed("_g", "_a"), "_full")
    good = tries.filter(~too_broad(F.col("precision"), F.col("_full"), F.col("_a.display_name"), context) & geocode_passes(F.col("_a.lat"), F.col("_a.lon"), F.col("t_bbox"), F.col("t_polygons"), F.col("t_bbox_verified"))["passes"])
    best = good.groupBy("candidate_id").agg(F.min_by(F.struct(F.col("_a.lat").alias("lat"), F.col("_a.lon").alias("lon"), F.col("_a.display_name").alias("display_name"), F.col("_full").alias("query")), F.struct("_place", "_k")).alias("_i"))
    return out.join(best, "candidate_id", "left")

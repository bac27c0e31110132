"""Source rows: pages to look at, from registries, seeds, targets and queries.

A target is a row with ``target_id, canonical_target, target_label,
admin_region, country, place_name, camera_type``; all generators are
``explode``s of array expressions, so they scale with the number of targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import media as M
from ..functions import url as U
from ..functions.text import any_term, distinct_ignoring_case, text
from ..operators.merge import first_seen
from ..operators.policy import Rule, block_reason, safe_query, unblocked

#: Registry entries that are broadcast, at most.
FEW = 10_000
COLUMNS = ("query", "title", "url", "snippet", "source_provider", "source_kind", "source_name", "source_scope_hint", "source_notes")


def dashed(c: Column) -> Column:
    s = F.regexp_replace(F.lower(F.trim(text(c))), "&", " and ")
    return F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def _slugs(values: list[Column], drop: tuple[str, ...], default: str) -> Column:
    own = F.array_distinct(F.filter(F.array(*[dashed(v) for v in values]), lambda s: (s != "") & ~s.isin(*drop)))
    return F.when(F.size(own) > 0, own).otherwise(F.array(F.lit(default)))


def region_slugs() -> Column:
    return _slugs([F.substring_index(text(F.col(c)), ",", 1) for c in ("admin_region", "canonical_target", "target_label", "place_name")], ("traffic", "traffic-cameras", "cameras", "live-cameras"), "all")


def country_slugs() -> Column:
    last = F.when(F.col("canonical_target").contains(","), F.trim(F.substring_index("canonical_target", ",", -1)))
    return _slugs([F.col("country"), last], ("",), "world")


def category_slugs() -> Column:
    intent = F.replace(F.lower(F.coalesce(F.nullif(F.col("camera_type"), F.lit("")), F.lit("camera"))), F.lit("_"), F.lit(" "))
    return _slugs([intent, F.when(intent.contains("traffic"), "traffic").otherwise("camera")], ("",), "camera")


def site_urls(base: Column) -> Column:
    """Directory pages of a site for a target: two for each country and region, six for each category there."""
    root = F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"))
    pages = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.concat(F.lit("?page="), k.cast("string"))))
    of = lambda c, r: F.concat(
        F.array(F.concat(root, F.lit("cameras/"), c, F.lit("/"), r), F.concat(root, F.lit("livetraffic/"), c, F.lit("/"), r)),
        F.flatten(F.transform(category_slugs(), lambda k: F.transform(pages, lambda p: F.concat(root, F.lit("cameras/"), c, F.lit("/"), r, F.lit("/category/"), k, p)))),
    )
    return distinct_ignoring_case(F.flatten(F.flatten(F.transform(country_slugs(), lambda c: F.transform(region_slugs(), lambda r: of(c, r))))))


def entry_rows(entries: DataFrame, targets: DataFrame, provider: str, rules: list[Rule] = ()) -> DataFrame:
    """Rows of enabled entries for each target: a site's directory pages before its root; first seen by URL."""
    own = unblocked(entries.filter("enabled AND url <> ''"), list(rules), "url")
    # Entries are a registry: the targets' side is the one that may be large.
    both = targets.crossJoin(F.broadcast(own) if own.limit(FEW + 1).count() <= FEW else own)
    pages = F.when(F.col("source_type") == "site", F.concat(F.filter(site_urls(F.col("url")), lambda u: u.startswith("http")), F.array("url"))).otherwise(F.array("url"))
    rows = both.select("target_id", "entry_ord", F.posexplode(pages).alias("page_ord", "page"), "name", "source_type", "scope_hint", "notes", F.coalesce("canonical_target", F.lit("")).alias("query"))
    rows = rows.select(
        "target_id",
        (F.col("entry_ord") * 100000 + F.col("page_ord")).cast("long").alias("_ord"),
        "query",
        F.col("name").alias("title"),
        U.without_fragment(F.col("page")).alias("url"),
        text(F.col("notes")).alias("snippet"),
        F.lit(provider).alias("source_provider"),
        F.col("source_type").alias("source_kind"),
        F.col("name").alias("source_name"),
        text(F.col("scope_hint")).alias("source_scope_hint"),
        text(F.col("notes")).alias("source_notes"),
    )
    return first_seen(rows.filter("url <> ''"), "target_id", "url")


def seed_entries(spark: SparkSession, urls: list[str]) -> DataFrame:
    """Seed URLs as entries: streams directly, others as pages."""
    df = spark.createDataFrame([(k, u.strip()) for k, u in enumerate(urls) if u.strip()], "entry_ord int, url string")
    return df.select("entry_ord", F.col("url").alias("name"), "url", F.when(M.looks_like_hls(F.col("url")), "direct_hls").otherwise("page").alias("source_type"), F.lit(None).cast("string").alias("scope_hint"), F.lit(True).alias("enabled"), F.lit(None).cast("string").alias("notes"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """A seed file: one URL a line, ``#`` begins a comment."""
    lines = spark.read.text(path).select(F.trim("value").alias("url"), F.monotonically_increasing_id().alias("_ord"))
    return lines.filter("url <> '' AND NOT startswith(url, '#')")


def with_pagination(rows: DataFrame, pages: int) -> DataFrame:
    """Rows of paginated directories with their further pages right after them."""
    more = F.when(U.paginated_directory(F.col("url")) & F.lit(pages > 1), F.sequence(F.lit(2), F.lit(max(2, pages)))).otherwise(F.array().cast("array<int>"))
    spread = rows.withColumn("_page", F.explode(F.concat(F.array(F.lit(1)), more)))
    return (
        spread.withColumn("discovery_note", F.when(F.col("_page") > 1, F.concat(F.lit("pagination_page_"), F.col("_page").cast("string"))))
        .withColumn("url", F.when(F.col("_page") > 1, U.with_page(F.col("url"), F.col("_page"))).otherwise(F.col("url")))
        .withColumn("source_kind", F.when(F.col("_page") > 1, F.coalesce(F.nullif(F.col("source_kind"), F.lit("")), F.lit("paginated_page"))).otherwise(F.col("source_kind")))
        .withColumn("_ord", F.col("_ord") * 1000 + F.col("_page"))
        .drop("_page")
    )


def selected(rows: DataFrame, rules: list[Rule], pages: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows that are followed (fetchable, not blocked, first seen, with pagination), and blocked ones with reasons."""
    fit = rows.filter(F.col("url").rlike("^(?i:https?|rtsps?)://")).withColumn("blocked_reason", block_reason(F.col("url"), rules))
    good = with_pagination(fit.filter("blocked_reason IS NULL").drop("blocked_reason"), pages)
    return first_seen(good.withColumn("url", U.without_fragment(F.col("url"))), "url"), fit.filter("blocked_reason IS NOT NULL")


# Official query templates, by group.
TEMPLATES = {
    "traffic": (
        '"traffic cameras" "{loc}" site:.gov',
        '"live traffic cameras" "{loc}" site:.gov',
        '"road cameras" "{loc}" site:.gov',
        '"highway cameras" "{loc}" site:.gov',
        '"freeway cameras" "{loc}" site:.gov',
        '"511 cameras" "{loc}" site:.gov',
        '"511 traffic cameras" "{loc}" site:.gov',
        '"traveler information" "cameras" "{loc}" site:.gov',
        '"DOT cameras" "{loc}" site:.gov',
        '"department of transportation" "cameras" "{loc}" site:.gov',
        '"traffic camera map" "{loc}" site:.gov',
        '"road conditions" "cameras" "{loc}" site:.gov',
        '"winter road cameras" "{loc}" site:.gov',
        '"highway travel cameras" "{loc}" site:.gov',
    ),
    "general": (
        '"public cameras" "{loc}" site:.gov',
        '"live cameras" "{loc}" site:.gov',
        '"camera map" "{loc}" site:.gov',
        '"webcam map" "{loc}" site:.gov',
        '"live webcam" "{loc}" site:.gov',
        '"webcams" "{loc}" site:.gov',
        '"camera feeds" "{loc}" site:.gov',
        '"public webcam" "{loc}" site:.gov',
        '"live camera" "{loc}" "official"',
    ),
    "city": (
        '"city webcam" "{loc}" site:.gov',
        '"downtown camera" "{loc}" site:.gov',
        '"downtown webcam" "{loc}" site:.gov',
        '"public square camera" "{loc}" site:.gov',
        '"city camera" "{loc}" site:.gov',
        '"municipal camera" "{loc}" site:.gov',
        '"public works camera" "{loc}" site:.gov',
        '"city live camera" "{loc}" site:.gov',
    ),
    "construction": (
        '"construction camera" "{loc}" site:.gov',
        '"construction cameras" "{loc}" site:.gov',
        '"project camera" "{loc}" site:.gov',
        '"project webcam" "{loc}" site:.gov',
        '"bridge construction camera" "{loc}" site:.gov',
        '"road project camera" "{loc}" site:.gov',
        '"capital project camera" "{loc}" site:.gov',
        '"infrastructure camera" "{loc}" site:.gov',
    ),
    "safety": (
        '"emergency management" "camera" "{loc}" site:.gov',
        '"public safety camera" "{loc}" site:.gov',
        '"flood camera" "{loc}" site:.gov',
        '"river camera" "{loc}" site:.gov',
        '"dam camera" "{loc}" site:.gov',
        '"evacuation route camera" "{loc}" site:.gov',
        '"fire weather camera" "{loc}" site:.gov',
        '"disaster camera" "{loc}" site:.gov',
    ),
    "weather": (
        '"weather cameras" "{loc}" site:.gov',
        '"weather camera" "{loc}" site:.gov',
        '"live weather camera" "{loc}" site:.gov',
        '"weather webcam" "{loc}" site:.gov',
        '"meteorological camera" "{loc}" site:.gov',
        '"airport weather camera" "{loc}" site:.gov',
        '"surface weather camera" "{loc}" site:.gov',
        '"road weather cameras" "{loc}" site:.gov',
        '"weather cameras" "{loc}" site:.edu',
        '"webcam" "weather" "{loc}" site:.edu',
    ),
    "mountain": (
        '"mountain cameras" "{loc}" site:.gov',
        '"mountain webcam" "{loc}" site:.gov',
        '"snow camera" "{loc}" site:.gov',
        '"snow cameras" "{loc}" site:.gov',
        '"ski camera" "{loc}" site:.gov',
        '"ski webcam" "{loc}" site:.gov',
        '"pass camera" "{loc}" site:.gov',
        '"mountain pass camera" "{loc}" site:.gov',
        '"avalanche camera" "{loc}" site:.gov',
    ),
    "airport": (
        '"airport cameras" "{loc}" site:.gov',
        '"airport weather camera" "{loc}" site:.gov',
        '"aviation weather camera" "{loc}" site:.gov',
        '"runway camera" "{loc}" site:.gov',
        '"airport webcam" "{loc}" site:.gov',
        '"terminal camera" "{loc}" site:.gov',
        '"airport live camera" "{loc}" site:.gov',
        '"airfield camera" "{loc}" site:.gov',
        '"aviation camera program" "{loc}" site:.gov',
    ),
    "campus": (
        '"campus webcam" "{loc}" site:.edu',
        '"campus cameras" "{loc}" site:.edu',
        '"live campus camera" "{loc}" site:.edu',
        '"university webcam" "{loc}" site:.edu',
        '"college webcam" "{loc}" site:.edu',
        '"campus live cam" "{loc}" site:.edu',
        '"weather camera" "{loc}" site:.edu',
        '"webcam" "campus" "{loc}" site:.edu',
    ),
    "beach": (
        '"beach cameras" "{loc}" site:.gov',
        '"beach webcam" "{loc}" site:.gov',
        '"surf camera" "{loc}" site:.gov',
        '"surf cam" "{loc}" site:.gov',
        '"coastal cameras" "{loc}" site:.gov',
        '"shoreline camera" "{loc}" site:.gov',
        '"pier camera" "{loc}" site:.gov',
        '"ocean camera" "{loc}" site:.gov',
        '"beach conditions" "camera" "{loc}" site:.gov',
    ),
    "harbor": (
        '"harbor cameras" "{loc}" site:.gov',
        '"port cameras" "{loc}" site:.gov',
        '"marina cameras" "{loc}" site:.gov',
        '"harbor webcam" "{loc}" site:.gov',
        '"port webcam" "{loc}" site:.gov',
        '"marina webcam" "{loc}" site:.gov',
        '"ship channel camera" "{loc}" site:.gov',
        '"waterfront camera" "{loc}" site:.gov',
        '"ferry terminal camera" "{loc}" site:.gov',
        '"marine traffic camera" "{loc}" site:.gov',
    ),
    "tourism": (
        '"official visitor" "webcam" "{loc}"',
        '"official tourism" "webcam" "{loc}"',
        '"visitor bureau" "webcam" "{loc}"',
        '"tourism" "live camera" "{loc}"',
        '"chamber of commerce" "webcam" "{loc}"',
        '"destination webcam" "{loc}" "official"',
        '"live camera" "{loc}" "visitor center"',
    ),
    "parks": (
        '"park cameras" "{loc}" site:.gov',
        '"park webcam" "{loc}" site:.gov',
        '"live park camera" "{loc}" site:.gov',
        '"wildlife camera" "{loc}" site:.gov',
        '"wildlife webcam" "{loc}" site:.gov',
        '"trail camera" "{loc}" site:.gov',
        '"visitor center webcam" "{loc}" site:.gov',
        '"national park webcam" "{loc}" site:.gov',
        '"state park webcam" "{loc}" site:.gov',
        '"public lands camera" "{loc}" site:.gov',
    ),
}

# Groups of each intent, in order; an intent is the first key that its name holds.
INTENTS = {
    "traffic": "traffic general city construction safety",
    "weather": "weather general mountain airport campus",
    "airport": "airport weather general",
    "beach": "beach harbor general tourism",
    "coastal": "beach harbor general tourism",
    "harbor": "harbor beach general",
    "port": "harbor general",
    "marina": "harbor beach general",
    "park": "parks mountain general tourism",
    "wildlife": "parks general",
    "mountain": "mountain weather general",
    "ski": "mountain weather general",
    "snow": "mountain weather general",
    "campus": "campus weather general",
    "university": "campus general",
    "construction": "construction city general",
    "infrastructure": "construction general",
    "flood": "safety general",
    "river": "safety general",
    "emergency": "safety general",
    "fire": "safety mountain general",
    "city": "city general tourism safety",
    "downtown": "city general tourism",
    "tourism": "tourism general city",
    "default": "general city tourism traffic safety",
}
EXCLUSIONS = " -site:insecam.org -site:shodan.io -site:censys.io -site:zoomeye.org -site:fofa.info"


def templates(intent: str) -> list[str]:
    """Official query templates of an intent, in order."""
    key = next((k for k in INTENTS if k in (intent or "default").lower()), "default")
    out = [t for group in INTENTS[key].split() for t in TEMPLATES[group]]
    return list(dict.fromkeys(out))


def official_queries(intent: str, place: str, most: int = 20, exclusions: bool = True) -> list[str]:
    if not (place or "").strip():
        return []
    return [t.replace("{loc}", place.strip()) + (EXCLUSIONS if exclusions else "") for t in templates(intent)][:most]


def official_scoped_queries(intent: str, place: str, most: int = 8) -> list[str]:
    """Those on official hosts."""
    return [q for q in official_queries(intent, place, 4 * most) if "site:.gov" in q or "site:.edu" in q][:most]


# Keyword groups of a harvest query's intent, in order.
HARVEST_INTENTS = {
    "traffic": ("traffic", "road", "roads", "highway", "freeway", "transportation", "511"),
    "weather": ("weather", "meteorological", "airport weather"),
    "airport": ("airport", "airfield", "aviation", "runway"),
    "beach": ("beach", "surf", "coastal", "shore", "pier"),
    "harbor": ("harbor", "port", "marina", "waterfront", "ferry"),
    "park": ("park", "wildlife", "trail", "visitor center"),
    "mountain": ("mountain", "ski", "snow", "pass"),
    "campus": ("campus", "university", "college"),
    "construction": ("construction", "project", "bridge", "infrastructure"),
    "city": ("city", "downtown", "municipal"),
}


def harvest_intent(query: Column) -> Column:
    low = F.replace(F.lower(text(query)), F.lit("_"), F.lit(" "))
    out = F.when(F.lit(False), "")
    for name, words in HARVEST_INTENTS.items():
        out = out.when(any_term(low, words), name)
    return out.otherwise("default")


# What follows the query or place in general queries.
HARVEST_SUFFIXES = (
    "", " public cameras", " live cameras", " webcams", " camera map", " camera feed json", " public camera API json", " camera MapServer FeatureServer", " camera FeatureServer query",
    " camera GeoJSON", " m3u8", " snapshot camera",
)
TARGET_SUFFIXES = {
    "traffic": (
        "traffic cameras", "traffic camera map", "department of transportation cameras", "traffic camera API json", "transportation cameras", "road conditions cameras", "CCTV traffic cameras",
        "live traffic camera list", "traffic camera MapServer FeatureServer", "traffic camera m3u8",
    ),
    "weather": (
        "weather cameras", "weather webcams", "live weather camera", "weather camera map", "weather station webcam", "airport weather camera", "mountain weather camera", "public weather webcam",
        "weather camera feed json", "weather webcam HLS",
    ),
    "": ("public live cameras", "live webcams", "public camera map", "public camera feed json", "webcam HLS", "camera snapshots"),
}
STRUCTURED_SUFFIXES = ("camera map layer feed", "public camera API json", "camera MapServer FeatureServer", "public live cameras m3u8")


def _distinct(values: list[str]) -> list[str]:
    return list({v.lower(): v for v in reversed(values)}[k] for k in dict.fromkeys(v.lower() for v in values))


def harvest_queries(query: str, most: int) -> list[str]:
    """General queries of a harvest, with a share for official ones."""
    if most <= 0:
        return []
    low = query.replace("_", " ").lower()
    intent = next((k for k, words in HARVEST_INTENTS.items() if any(w in low for w in words)), "default")
    official = official_queries(intent, query, min(8, max(2, most // 3)))
    general = _distinct([query + s for s in HARVEST_SUFFIXES])[: max(0, most - len(official))]
    return general + [q for q in official if q not in general][: most - max(0, most - len(official))]


def target_queries(place: str, intent: str, most: int, hosts: list[str] = (), operator_queries: int = 0) -> list[str]:
    """Search queries of a target: those of its intent, structured ones, a share of official ones, and guarded operator queries."""
    low = (intent or "public_live").replace("_", " ").lower()
    kind = "traffic" if "traffic" in low else "weather" if "weather" in low else ""
    general = _distinct([f"{place} {s}" for s in (*TARGET_SUFFIXES[kind], *STRUCTURED_SUFFIXES)])
    share = min(8, max(2, most // 3)) if most > 4 else 0
    official = [unscoped(q) for q in official_queries(intent or low, place, share, exclusions=False)]
    general = general[: max(0, most - len(official))]
    normal = _distinct(general + [q for q in official if q not in general])[:most]
    return _distinct(normal + operator_queries_of(place, intent or low, kind, hosts, operator_queries))


def unscoped(query: str) -> str:
    return " ".join(w for w in query.split() if not w.startswith(("site:.", "-site:")))


def phrase(value: str) -> str:
    words = " ".join("".join(c if c.isalnum() or c in "_,.'’/- " else " " for c in value or "").split())[:120]
    return f'"{words}"' if " " in words else words


# Operator queries on an allowed host, and what they exclude.
HOST_QUERIES = (
    "site:{host} {place} {kind}", "site:{host} {place} webcam OR cameras", "site:{host} filetype:json {place} camera", "site:{host} filetype:geojson {place} camera",
    "site:{host} intitle:camera {place}", "site:{host} inurl:camera {place} public",
)
HOST_EXCLUSIONS = " -shodan -censys -zoomeye -fofa -insecam -login -admin -password -credentials"


def operator_queries_of(place: str, intent: str, kind: str, hosts: list[str], most: int) -> list[str]:
    """Official scoped queries and six for each allowed host, up to ``most``; ``guarded`` filters them."""
    if most <= 0 or not phrase(place):
        return []
    out = official_scoped_queries(intent, place, most // 2)
    for h in hosts:
        if len(out) >= most:
            break
        out += [q.format(host=h, place=phrase(place), kind=f"{kind or 'public'} cameras") + HOST_EXCLUSIONS for q in HOST_QUERIES]
    return _distinct(out)[:most]


def guarded(queries: DataFrame, col: str = "query") -> DataFrame:
    """Queries that pass the guardrail."""
    return queries.filter(safe_query(F.col(col)))


def promoted_hosts(candidates: DataFrame, target: DataFrame, existing: DataFrame, rules: list[Rule], threshold: int = 3) -> DataFrame:
    """Directory rows of hosts that many candidates are on, without known or blocked URLs; most frequent hosts first."""
    counts = candidates.groupBy("target_id", F.lower(U.authority(F.col("stream_url"))).alias("host")).agg(F.count("*").alias("n"), F.min("_ord").alias("seen")).filter((F.col("host") != "") & (F.col("n") >= max(2, threshold)))
    urls = counts.join(target, "target_id").select("target_id", "host", "n", "seen", F.posexplode(U.promoted_host_urls(F.col("host"), region_slugs(), category_slugs())).alias("k", "url"))
    fresh = unblocked(urls.join(existing.select(U.without_fragment(F.col("url")).alias("url")).distinct(), "url", "left_anti"), rules, "url")
    order = F.row_number().over(Window.partitionBy("target_id").orderBy(F.desc("n"), "seen", "k"))
    return fresh.select(
        "target_id",
        order.cast("long").alias("_ord"),
        F.concat(F.lit("promoted_asset_host:"), "target_id").alias("query"),
        F.concat(F.lit("Promoted camera asset host "), "host").alias("title"),
        "url",
        F.format_string("Host appeared in %d candidate media URLs", F.col("n")).alias("snippet"),
        F.lit("asset_host_promotion").alias("source_provider"),
        F.lit("promoted_host").alias("source_kind"),
        F.col("host").alias("source_name"),
    )

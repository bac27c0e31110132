"""What payloads hold, lack and lead to, as queries whose inputs and answers come from the tables' columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import CAM_SQL, KIND, cams, query, t
from .operators import extract, summarize
from .plans.harvest import failures


def sent(pages: DataFrame, url: Column, kind: Column | str, body: Column, status: Column | int = 200) -> DataFrame:
    """Payloads made of rows of ``pages``."""
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    own = {"_ord": F.col("page_id").cast("long"), "page_url": url, "payload_url": url, "method": F.lit("static"), "content_type": column(kind), "status": column(status).cast("int"), "body": body, "source_provider": F.lit("directory"), "source_name": F.lit("src")}
    return pages.select(*[v.alias(k) for k, v in own.items()])


#: A stream, so many letters, and a point; of some rows the point comes first.
GAP, POINT, AWAY = "(page_id * 37) % 1200", "(10 + page_id % 70) || '.125, -' || (page_id % 150) || '.2500'", "page_id % 3 = 0"


@query(
    f"WITH p AS (SELECT page_id, {GAP} AS gap, {POINT} AS point, {AWAY} AS before FROM pages), "
    # The stretch goes 500 characters beyond the URL: the point must begin and have three decimals within it, or lie whole before it.
    "c AS (SELECT *, length(point) AS n, strpos(point, ',') AS k FROM p), "
    "w AS (SELECT *, CASE WHEN before THEN right(point, greatest(0, least(n, 498 - gap))) ELSE left(point, greatest(0, least(n, 498 - gap))) END AS seen FROM c), "
    "x AS (SELECT *, regexp_extract(seen, '([-+]?[0-9]{1,2}[.][0-9]{3,}), (-[0-9]{1,3}[.][0-9]{3,})', ['a', 'b']) AS r FROM w) "
    "SELECT 'https://m.example/' || page_id || '.m3u8' AS url, 'hls' AS media_type, nullif(r.a, '')::DOUBLE AS lat, nullif(r.b, '')::DOUBLE AS lon, CASE WHEN r.a <> '' THEN 'proximity_text' END AS coordinate_source FROM x"
)
def near_texts(spark: SparkSession, d: str) -> DataFrame:
    """W-08, F-40: streams of plain texts with the coordinates near them."""
    pages = t(spark, d, "pages").selectExpr("page_id", f"{GAP} AS gap", f"{POINT} AS point", f"{AWAY} AS before")
    url = F.concat(F.lit("https://m.example/"), F.col("page_id").cast("string"), F.lit(".m3u8"))
    pad = F.concat(F.lit(" "), F.repeat(F.lit("x"), F.col("gap").cast("int")), F.lit(" "))
    body = F.when(F.col("before"), F.concat("point", pad, url)).otherwise(F.concat(url, pad, F.col("point")))
    found = extract.run_candidates(sent(pages, F.lit("https://text.example/a"), "text/plain", body))
    return found.select("url", "media_type", "lat", "lon", "coordinate_source")


@query(
    "WITH p AS (SELECT page_id, (page_id % 80)::DOUBLE AS y, (page_id % 170)::DOUBLE AS x, page_id % 4 IN (0, 1) AS own, page_id % 4 IN (1, 2) AS above FROM pages) "
    "SELECT 'https://m.example/' || page_id || '/' || k || '.m3u8' AS url, CASE WHEN above THEN y WHEN k = 1 AND own THEN 1.5 END::DOUBLE AS lat, CASE WHEN above THEN x WHEN k = 1 AND own THEN 2.5 END::DOUBLE AS lon, '$.features[0].attributes.views[' || k || ']' AS json_record_path FROM p, (SELECT unnest(range(0, 3)) AS k)"
)
def inherited_places(spark: SparkSession, d: str) -> DataFrame:
    """J-17: streams deep in a tree take the outermost point above them, else their own."""
    n = F.col("page_id")
    url = lambda k: F.concat(F.lit("https://m.example/"), n.cast("string"), F.lit(f"/{k}.m3u8"))
    view = lambda k, own: F.struct(url(k).alias("streamUrl"), F.when(own, F.struct(F.lit(2.5).alias("x"), F.lit(1.5).alias("y"))).alias("geometry"))
    views = F.array(view(0, F.lit(False)), view(1, (n % 4).isin(0, 1)), view(2, F.lit(False)))
    point = F.when((n % 4).isin(1, 2), F.struct((n % 170).cast("double").alias("x"), (n % 80).cast("double").alias("y")))
    body = F.to_json(F.struct(F.array(F.struct(point.alias("geometry"), F.struct(views.alias("views")).alias("attributes"))).alias("features")))
    own = F.concat(F.lit("https://api.example/t/"), n.cast("string"))
    found = extract.harvest_records(sent(t(spark, d, "pages"), own, "application/json", body))
    return found.filter("discovery_method = 'payload_json'").select("url", "lat", "lon", "json_record_path")


@query(
    "SELECT CASE WHEN page_id % 5 = 0 THEN 'source_fetch_error' ELSE 'row_extraction_error' END AS stage, url AS subject, "
    "CASE WHEN page_id % 5 = 0 THEN 'HTTP status ' || (400 + page_id % 104) WHEN page_id % 7 = 0 THEN 'no body' ELSE 'not JSON' END AS error FROM pages "
    "WHERE page_id % 5 = 0 OR page_id % 7 = 0 OR page_id % 11 = 0"
)
def harvest_errors(spark: SparkSession, d: str) -> DataFrame:
    """K-27: what could not be fetched or read."""
    n = F.col("page_id")
    status = F.when(n % 5 == 0, 400 + n % 104).otherwise(200)
    kind = F.when(n % 11 == 0, "application/json").otherwise("text/html")
    return failures(sent(t(spark, d, "pages"), F.col("url"), kind, F.when(n % 7 > 0, F.col("html")), status))


@query(
    f"WITH {CAM_SQL}, r AS (SELECT *, {KIND} AS kind, CASE _ord % 4 WHEN 0 THEN 'harvest_handoff' WHEN 1 THEN 'hls_regex' END AS method FROM cam), "
    "l AS (SELECT unnest([{'d': 'media_type', 'k': CASE WHEN _ord % 3 > 0 THEN kind ELSE 'unknown' END}, {'d': 'source_provider', 'k': CASE WHEN _ord % 5 = 0 THEN 'p' ELSE coalesce(method, 'unknown') END}, "
    "{'d': 'origin', 'k': CASE WHEN method = 'harvest_handoff' OR _ord % 9 = 0 THEN 'harvest' ELSE 'native' END}, {'d': 'coordinates', 'k': CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 'present' ELSE 'missing' END}]) AS x FROM r) "
    "SELECT x.d AS dimension, x.k AS key, count(*)::BIGINT AS n FROM l GROUP BY 1, 2"
)
def run_explanation(spark: SparkSession, d: str) -> DataFrame:
    """K-15, A-27: a run's candidates by medium, provider, origin and coordinates."""
    at = F.col("_ord")
    method = F.when(at % 4 == 0, "harvest_handoff").when(at % 4 == 1, "hls_regex")
    meta = F.create_map(F.lit("media_type"), F.when(at % 3 > 0, F.expr(KIND)), F.lit("source_provider"), F.when(at % 5 == 0, "p").otherwise(""), F.lit("harvest_input"), F.when(at % 9 == 0, "true"))
    return summarize.explained(cams(spark, d).withColumns({"discovery_method": method, "metadata": meta}))

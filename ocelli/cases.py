"""More operators as queries with SQL: functions by tables of cases, and operators whose answers follow from the cases.

A function is applied to texts that are dealt to the rows of a table by number, and the
SQL states the answer to each.  Every row of the table is used.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import BUCKET_SQL, CAM_SQL, STATE, cams, query, t, target_rows
from .functions import coerce as N
from .functions import geo as G
from .functions import media as M
from .functions import status as S
from .functions import text as X
from .functions import url as U
from .operators import rank, scope, sinks, summarize, targets, trust
from .operators.policy import safe_query
from .sources import rows as R
from .sources import search
from .sources.features import read_features
from .staging import folder


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    return repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def dealt(values: list, key: str = "p_partkey") -> str:
    """SQL of the value that a row's number gets."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN {literal(v)}" for k, v in enumerate(values)) + " END"


def cases(name: str, columns: dict[str, Callable[..., Column]], table: dict[tuple | str | None, tuple], kinds: str = "VARCHAR", about: str = "") -> None:
    """Registers a query over ``part``: ``table`` has the inputs and, for each of ``columns``, the answer."""
    inputs = [k if isinstance(k, tuple) else (k,) for k in table]
    answers = [v if isinstance(v, tuple) else (v,) for v in table.values()]
    kinds_ = kinds.split() * (len(columns) if " " not in kinds else 1)
    sql = "SELECT p_partkey, " + ", ".join(f"({dealt([a[k] for a in answers])})::{kind} AS {c}" for k, (c, kind) in enumerate(zip(columns, kinds_))) + " FROM part"

    def run(spark: SparkSession, d: str) -> DataFrame:
        given = [F.expr(f"cast({dealt([x[k] for x in inputs])} AS {'double' if all(isinstance(x[k], (int, float, type(None))) and not isinstance(x[k], bool) for x in inputs) else 'string'})") for k in range(len(inputs[0]))]
        own = t(spark, d, "part").select("p_partkey", *[g.alias(f"v{k}") for k, g in enumerate(given)])
        return own.select("p_partkey", *[f(*[F.col(f"v{k}") for k in range(len(given))]).alias(c) for c, f in columns.items()])

    run.__name__, run.__doc__ = name, about
    query(sql)(run)


# --- URLs and media -------------------------------------------------------------

cases(
    "structured_urls",
    {"url": U.canonical_structured, "cleaned": U.cleaned},
    {
        "HTTPS://User:pw@Cdn.Example:443/a.m3u8?x=1#f": ("https://cdn.example/a.m3u8?x=1", "HTTPS://User:pw@Cdn.Example:443/a.m3u8?x=1#f"),
        "http://a.example:80/x": ("http://a.example/x", "http://a.example/x"),
        "http://a.example:8080/x": ("http://a.example:8080/x", "http://a.example:8080/x"),
        "//cdn.example/v.mp4": ("https://cdn.example/v.mp4", "https://cdn.example/v.mp4"),
        "https:\\/\\/a.example\\/b.jpg": ("https://a.example/b.jpg", "https://a.example/b.jpg"),
        "https://a.example/b.jpg\");": ("https://a.example/b.jpg\");", "https://a.example/b.jpg"),
        "'/api/list.json'": ("'/api/list.json'", "/api/list.json"),
        "": ("", ""),
        None: ("", ""),
    },
    about="F-03, F-04, F-02: canonical form in structured records, and cleaned URLs.",
)

cases(
    "media_of_fields",
    {
        "structured": lambda u, k: M.classify_structured(u, k),
        "by_field": lambda u, k: M.classify_record_field(u, X.normalized_key(k), M.CAMERA_FIELDS),
        "harvested": lambda u, k: M.classify(u, k),
    },
    {
        ("https://a.example/x.m3u8?t=1", ""): ("hls", "hls", "hls"),
        ("rtsp://a.example/x", ""): (None, "rtsp", "rtsp"),
        ("https://a.example/x.mjpg", ""): ("mjpeg", "mjpeg", "mjpeg"),
        ("https://a.example/x.webm", ""): ("video_file", "video_file", "video_file"),
        ("https://a.example/x.m4v", ""): ("video_file", None, "video_file"),
        ("https://a.example/x.PNG?y", ""): ("image_snapshot", "image_snapshot", "image_snapshot"),
        ("https://a.example/pic", "Current Image URL"): (None, "image_snapshot", None),
        ("https://a.example/pic", "stream_url"): ("stream", "other", "stream"),
        ("https://a.example/live?video=3", ""): ("stream", None, "stream"),
        ("https://a.example/page.html", "link"): (None, None, None),
        ("ftp://a.example/x.m3u8", ""): (None, "hls", None),
        ("/relative/x.jpg", ""): (None, "image_snapshot", None),
    },
    about="F-05, F-06, F-07: the three classifiers of a field's URL.",
)

cases(
    "effective_types",
    {"caps": M.type_for_caps, "priority": M.type_for_priority, "playlists": M.type_for_playlists, "records": M.type_for_records},
    {
        ("", "https://a.example/x.m3u8"): ("hls", "hls", "hls", "hls"),
        ("", "https://a.example/x.jpg?y"): ("image_snapshot", "image_snapshot", "image_snapshot", "image_snapshot"),
        ("", "rtsps://a.example/x"): ("rtsp", "unknown", "rtsp", "rtsp"),
        ("", "https://a.example/x"): ("image_snapshot", "unknown", "unknown_media", "unknown_media"),
        ("rtsp_stream", "x"): ("rtsp", "rtsp_stream", "rtsp", "unknown_media"),
        ("image", "x"): ("image", "image_snapshot", "image_snapshot", "unknown_media"),
        ("Video", "x"): ("video", "video_file", "video", "unknown_media"),
        ("hls_stream", "x"): ("hls_stream", "hls_stream", "hls", "unknown_media"),
        ("other", "x"): ("other", "other", "other", "stream"),
        ("mjpeg", "x"): ("mjpeg", "mjpeg", "mjpeg", "mjpeg"),
        (None, None): ("image_snapshot", "unknown", "unknown_media", "unknown_media"),
    },
    about="F-08: the effective type of a row, by who asks.",
)

cases(
    "url_looks",
    {
        "hls": M.looks_like_hls,
        "rtsp": M.looks_like_rtsp,
        "image": M.looks_like_image,
        "http": M.is_http,
        "thumbnail": M.looks_like_thumbnail,
        "asset": M.looks_like_page_asset,
        "static": S.static_by_url,
        "directory": U.paginated_directory,
        "paged": U.pagination_like,
    },
    {
        "https://a.example/x.m3u8?a": (True, False, False, True, False, False, False, False, False),
        "RTSP://a.example/x": (False, True, False, False, False, False, False, False, False),
        "https://a.example/x.JPEG?1": (False, False, True, True, False, False, False, False, False),
        "https://a.example/thumbs/x.jpg": (False, False, True, True, True, True, True, False, False),
        "https://a.example/pic_thumb.png": (False, False, True, True, False, False, False, False, False),
        "https://a.example/pic_thumb_2.png": (False, False, True, True, True, True, False, False, False),
        "https://a.example/favicon.png": (False, False, True, True, False, True, True, False, False),
        "https://a.example/static/default.png": (False, False, True, True, False, True, True, False, False),
        "https://a.example/x/loading.gif": (False, False, False, True, False, True, False, False, False),
        "https://a.example/cameras/list?page=2": (False, False, False, True, False, False, False, True, True),
        "https://a.example/list?offset=20": (False, False, False, True, False, False, False, False, True),
        "https://a.example/webcam": (False, False, False, True, False, False, False, True, True),
        "http:///x": (False, False, False, False, False, False, False, False, False),
        None: (False, False, False, False, False, False, False, False, False),
    },
    "BOOLEAN",
    "P-12, P-13, P-14, P-17, P-21: what a URL looks like.",
)

cases(
    "camera_names",
    {"camera_id": U.camera_id, "road": U.road_name},
    {
        "https://a.example/live/cam-7.jpg": ("cam-7", None),
        "https://a.example/sr99_nb_at_5thst/playlist.m3u8": ("sr99_nb_at_5thst", "SR 99 NB at 5th St"),
        "https://a.example/i5_main_ave.jpg": ("i5_main_ave", "I-5 main Ave"),
        "https://a.example/us101-sb.stream/playlist.m3u8?x": ("us101-sb", "US 101 SB"),
        "https://a.example/playlist.m3u8": ("playlist", None),
        "https://a.example/a%20b.png": ("a b", None),
        "https://a.example/": (None, None),
        None: (None, None),
    },
    about="F-11, F-12: a camera's id and its road, from a URL.",
)

cases(
    "promoted_urls",
    {"urls": lambda h: F.array_join(U.promoted_host_urls(h, F.array(F.lit("ohio")), F.array(F.lit("traffic"), F.lit("camera"))), " ")},
    {
        f"h{k}.example": " ".join(f"https://h{k}.example{p}" for p in ("", "/cameras", "/camera", "/traffic", "/cctv", "/ohio", "/cameras/ohio", "/traffic/ohio", "/cameras/ohio/category/traffic", "/cameras/ohio/category/camera"))
        for k in range(5)
    },
    about="F-16, J-12: directory URLs to try on a promoted host.",
)

cases(
    "image_decisions",
    {"page": lambda u, r, f, i: _removal("exclude-page-assets", u, r, f, i), "camera": lambda u, r, f, i: _removal("camera-evidence", u, r, f, i)},
    {
        ("https://a.example/favicon.png", "", "", ""): ("page_asset_evidence", "missing_camera_image_evidence"),
        ("https://a.example/p.jpg", "", "", ""): (None, "missing_camera_image_evidence"),
        ("https://a.example/webcam/p.jpg", "", "", ""): (None, None),
        ("https://a.example/p.jpg", "current_image_snapshot", "", "cam:1"): (None, None),
        ("https://a.example/p.jpg", "current_image_role", "", ""): (None, None),
        ("https://a.example/p.jpg", "", "imageUrl", ""): (None, None),
        ("https://a.example/p.jpg", "", "hero_image", ""): ("page_asset_evidence", "missing_camera_image_evidence"),
        ("https://a.example/thumb/p.jpg", "", "", ""): ("page_asset_evidence", "missing_camera_image_evidence"),
        ("https://a.example/snapshot/p.jpg", "", "", ""): (None, None),
        ("https://a.example/logo-cam.png", "", "", ""): ("page_asset_evidence", None),
    },
    about="P-09 to P-13: why an image record is removed, in either mode.",
)


def _removal(mode: str, url: Column, role: Column, field: Column, record: Column) -> Column:
    own = {"url": url, "asset_role": role, "asset_field": field, "camera_record_id": record, "media_type": F.lit("image_snapshot"), "metadata": F.create_map().cast("map<string,string>")}
    none = {"lat": "double", "lon": "double", "in_service": "boolean"}
    return M.image_removal_reason(mode, lambda n: own.get(n, F.lit(None).cast(none.get(n, "string"))))


# --- scalars ----------------------------------------------------------------------

cases(
    "loose_numbers",
    {"first": N.first_number, "whole": N.whole_number},
    {"-77.03°": (-77.03, None), " 2.5 ": (2.5, 2.5), "1e3": (1.0, 1000.0), "abc": (None, None), "+12": (12.0, 12.0), "12 km": (12.0, None), "1_000": (1.0, None), "1d": (1.0, None), ".5": (5.0, 0.5), "": (None, None), None: (None, None)},
    "DOUBLE",
    "F-47, F-48: the first number within a text, and a text that is a number.",
)
cases(
    "loose_booleans",
    {"value": N.boolean},
    {"In Service": True, "0": False, " yes ": True, "OFFLINE": False, "maybe": None, "outofservice": False, "1": True, "": None, None: None},
    "BOOLEAN",
    "F-50.",
)
cases(
    "camera_types",
    {"kind": N.camera_type},
    {
        "CCTV": "traffic", "Highway cam": "traffic", "Weather camera": "weather", "meteo": "weather", "train station": "transit", "Surf cam": "beach", "Airport": "airport", "Harbour view": "port", "trail": "transit", "state park": "park",
        "snow": "ski", "fire watch": "security_public_safety", "tourist cam": "tourism", "tour video": "camera", "tour": "other", "public webcam": "public", "video": "camera", "misc": "other", "": "camera", None: "camera",
    },
    about="F-63.",
)
cases(
    "coordinate_pairs",
    {
        "geojson_lat": lambda a, b: G.pair_geojson_first(a, b)["lat"],
        "lat_first_lat": lambda a, b: G.pair_lat_first(a, b)["lat"],
        "geojson_only_lat": lambda a, b: G.pair_geojson_only(a, b)["lat"],
    },
    {(10.0, 20.0): (20.0, 10.0, 20.0), (120.0, 20.0): (20.0, 20.0, 20.0), (20.0, 120.0): (20.0, 20.0, None), (200.0, 20.0): (None, None, None), (-90.0, 90.0): (90.0, -90.0, 90.0), (None, 5.0): (None, None, None)},
    "DOUBLE",
    "F-52, P-22: coordinate orders.",
)
cases(
    "geocoder_boxes",
    {"problem": lambda a, b, c, e: G.box_problem(G.box(a, b, c, e)), "height": lambda a, b, c, e: F.when(G.box_problem(G.box(a, b, c, e)) == "ok", F.round(G.box_height(G.pad_box(G.box(a, b, c, e), 69.0)), 6))},
    {(1.0, 2.0, 3.0, 4.0): ("ok", 69.0), (2.0, 1.0, 3.0, 4.0): ("bbox_invalid_order", None), (1.0, 3.0, 3.0, 4.0): ("ok", 138.0), (1.0, 95.0, 3.0, 4.0): ("bbox_coordinate_out_of_range", None), (1.0, 2.0, 3.0, 300.0): ("bbox_coordinate_out_of_range", None), (None, 2.0, 3.0, 4.0): ("bbox_missing_keys", None)},
    "VARCHAR DOUBLE",
    "F-55: order and range of boxes; widened boxes.",
)
cases(
    "place_words",
    {"token": X.place_token, "slug": lambda v: X.slug(v, "x"), "dashed": R.dashed},
    {"New  York, NY": ("new york ny", "new_york_ny", "new-york-ny"), "São Paulo": ("s o paulo", "s_o_paulo", "s-o-paulo"), "A & B": ("a b", "a_b", "a-and-b"), " - ": ("", "x", ""), "": ("", "x", ""), None: ("", "x", "")},
    about="F-20.",
)

# --- places, queries and intents -----------------------------------------------------

cases(
    "geocodable_texts",
    {
        "safe": scope.safe_geocode_query,
        "specific": lambda v: scope.names_place(v, [F.lit("Ohio")]),
        "with_context": lambda v: scope.with_context(v, [F.lit("Ohio"), F.lit("Land"), F.lit(None)]),
    },
    {
        "Main St at 5th": ("true", "true", "Main St at 5th, Ohio, Land"),
        "I-90 near Lake": ("true", "true", "I-90 near Lake, Ohio, Land"),
        "Ohio traffic cameras": ("true", "false", "Ohio traffic cameras, Land"),
        "Ohio road conditions": ("true", "false", "Ohio road conditions, Land"),
        "41.12345, -81.54321": ("false", "false", "41.12345, -81.54321, Ohio, Land"),
        "https://a.example/x": ("false", "false", "https://a.example/x, Ohio, Land"),
        "latitude of x": ("false", "true", "latitude of x, Ohio, Land"),
        "ab": ("false", "false", "ab, Ohio, Land"),
        "camera": ("true", "false", "camera, Ohio, Land"),
        "Lake Park": ("true", "true", "Lake Park, Ohio, Land"),
        None: ("false", "false", "Ohio, Land"),
    },
    "BOOLEAN BOOLEAN VARCHAR",
    "P-23, P-24, F-24.",
)
cases(
    "inferred_evidence",
    {
        "supported": lambda e, p: scope.evidence_supported(F.array(e), F.lit("https://a.example/oak_ave-5.m3u8 Oak")),
        "broad": lambda e, p: scope.too_broad(p, e, F.lit("somewhere"), [F.lit("Ohio"), F.lit("Land")]),
        "slug": lambda e, p: rank.location_slug(F.concat(F.lit("https://a.example/"), e, F.lit(".m3u8"))),
    },
    {
        ("oak", "road"): (True, False, True), ("OAK AVE", "road"): (True, False, True), ("elm street", "road"): (False, False, True), ("x", "road"): (False, True, False), ("Ohio", "road"): (False, True, True),
        ("oak", "state"): (True, True, True), ("ohio, land", "road"): (False, True, True), ("oakave5", ""): (True, False, True),
    },
    "BOOLEAN",
    "P-25, P-26, P-27, F-46.",
)
cases(
    "query_guards",
    {"safe": lambda q: safe_query(q), "intent": R.harvest_intent},
    {
        "ohio traffic cameras": ("true", "traffic"), "weather webcams": ("true", "weather"), "surf report": ("false", "beach"), "ferry cameras -insecam": ("true", "harbor"), "university webcam": ("true", "campus"),
        "downtown": ("false", "city"), "live camera": ("true", "default"), "snow_cam": ("false", "mountain"), "trail camera shodan": ("false", "park"), "construction camera rtsp://x": ("false", "construction"),
        "runway camera 10.0.0.1": ("false", "airport"), "webcam default login": ("false", "default"),
    },
    "BOOLEAN VARCHAR",
    "P-16, S-16: the guardrail lets harmless queries pass; their intent.",
)
cases(
    "search_links",
    {"ddg": lambda h: search.unwrapped(h), "bing": lambda h: search.unwrapped(h, "bing")},
    {
        "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx%3Fy%3D1": ("https://a.example/x?y=1", "https://duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx%3Fy%3D1"),
        "/l/?kh=-1&uddg=https%3A%2F%2Fb.example": ("https://b.example", "https://www.bing.com/l/?kh=-1&uddg=https%3A%2F%2Fb.example"[:0]),
        "https://www.bing.com/ck?u=https%3A%2F%2Fc.example": ("https://www.bing.com/ck?u=https%3A%2F%2Fc.example", "https://c.example"),
        "https://duckduckgo.com/about": ("", "https://duckduckgo.com/about"),
        "https://d.example/page": ("https://d.example/page", "https://d.example/page"),
        "javascript:void(0)": ("", ""),
        "": ("", ""),
        None: ("", ""),
    },
    about="S-17, S-18: external URLs of result links.",
)
cases(
    "endpoint_forms",
    {"n": lambda u: F.size(U.expanded_endpoints(u)), "last": lambda u: F.element_at(U.expanded_endpoints(u), -1)},
    {
        "https://a.example/x/MapServer": (9, "https://a.example/x/MapServer/7/query?where=1%3D1&outFields=*&returnGeometry=true&f=json"),
        "https://a.example/x/FeatureServer/?f=json": (9, "https://a.example/x/FeatureServer/7/query?where=1%3D1&outFields=*&returnGeometry=true&f=json"),
        "https://a.example/x/MapServer/3": (2, "https://a.example/x/MapServer/3/query?where=1%3D1&outFields=*&returnGeometry=true&f=json"),
        "https://a.example/x/0/query": (2, "https://a.example/x/0/query?where=1%3D1&outFields=*&returnGeometry=true&f=json"),
        "https://a.example/x/0/query?where=1": (1, "https://a.example/x/0/query?where=1"),
        "https://a.example/list.json": (1, "https://a.example/list.json"),
    },
    "INTEGER VARCHAR",
    "F-15: all forms of endpoints.",
)

# --- statuses -------------------------------------------------------------------------

cases(
    "playlist_probes",
    {"plain": lambda c, b, e, s: _hls(c, b, e, s, False), "segments": lambda c, b, e, s: _hls(c, b, e, s, True), "segment": lambda c, b, e, s: S.first_segment(b)},
    {
        (200.0, "#EXTM3U\n#x\na.ts\nb.ts", "", 200.0): ("active_live_unknown", "active_live_verified", "a.ts"),
        (200.0, "#EXTM3U\na.ts?x=1", "", 404.0): ("active_live_unknown", "active_playlist_dead_segments", "a.ts?x=1"),
        (200.0, "#EXTM3U\n", "", None): ("active_live_unknown", "active_live_unknown", None),
        (200.0, "<html>", "", None): ("decode_failed", "decode_failed", None),
        (403.0, "", "", None): ("restricted_http", "restricted_http", None),
        (404.0, "", "", None): ("offline_http", "offline_http", None),
        (None, "", "timeout", None): ("dead_link", "dead_link", None),
    },
    about="F-68, F-29: status of a playlist.",
)
cases(
    "image_probes",
    {"status": lambda u, c, k, cache, tag: _image(u, c, k, cache, tag), "static": lambda u, c, k, cache, tag: S.static_by_headers(cache).cast("string"), "kind": lambda u, c, k, cache, tag: S.probe_kind(F.lit(""), u)},
    {
        ("https://a.example/x.jpg", 200.0, "image/jpeg", "", "e2"): ("active_image_snapshot_refreshing", "false", "image"),
        ("https://a.example/x.jpg", 200.0, "image/jpeg", "", "e1"): ("active_image_snapshot_static_unverified", "false", "image"),
        ("https://a.example/x.jpg", 200.0, "image/jpeg", "max-age=86400", "e2"): ("static_image_asset", "true", "image"),
        ("https://a.example/x.jpg", 200.0, "image/jpeg", "max-age=60", "e1"): ("active_image_snapshot_static_unverified", "false", "image"),
        ("https://a.example/x.jpg", 200.0, "image/jpeg", "immutable", "e2"): ("static_image_asset", "true", "image"),
        ("https://a.example/favicon.png", 200.0, "image/png", "", "e2"): ("static_image_asset", "false", "image"),
        ("https://a.example/x.jpg", 200.0, "text/html", "", "e2"): ("image_snapshot_not_image", "false", "image"),
        ("https://a.example/x.jpg", 401.0, "image/jpeg", "", "e2"): ("restricted_http", "false", "image"),
        ("https://a.example/x.jpg", 500.0, "image/jpeg", "", "e2"): ("offline_http", "false", "image"),
        ("https://a.example/x.m3u8", None, "", "", "e2"): ("dead_link", "false", "hls"),
        ("rtsp://a.example/x", None, "", "", "e2"): ("dead_link", "false", "rtsp"),
        ("https://a.example/x", None, "", "", "e2"): ("dead_link", "false", "hls"),
    },
    about="F-68, P-34: status of an image from two samples; how a row is probed.",
)


def _hls(code: Column, body: Column, error: Column, segment: Column, check: bool) -> Column:
    probe = F.struct(F.nullif(error, F.lit("")).alias("error"), code.cast("int").alias("http_status"), body.alias("body"))
    return S.hls_status(probe, segment.cast("int"), check)


def _image(url: Column, code: Column, kind: Column, cache: Column, tag: Column) -> Column:
    sample = lambda e: F.struct(F.when(code.isNull(), "timeout").alias("error"), code.cast("int").alias("http_status"), kind.alias("content_type"), cache.alias("cache_control"), e.alias("etag"), F.lit("").alias("last_modified"), F.lit("h").alias("body_sha"), F.lit(None).cast("binary").alias("body_head"))
    return S.image_status(url, sample(F.lit("e1")), sample(tag))


cases(
    "untrusted_reasons",
    {"reason": lambda tr, s, v, d: S.untrusted_reason(lambda n: {"trust_level": tr, "scope_status": s, "validation_status": v, "llm_semantic_decision": d}.get(n, F.array().cast("array<string>")), F.lit(True))},
    {
        ("trusted", "in_scope", "", ""): "not selected for trusted GeoJSON",
        ("rejected", "out_of_scope", "", ""): "candidate trust_level is rejected; candidate scope_status is out_of_scope",
        ("untrusted", "in_scope", "dead_link", ""): "validation_status=dead_link",
        ("untrusted", "review", "", "review"): "llm_semantic_decision=review",
        ("untrusted", "review", None, "in_scope"): "not selected for trusted GeoJSON",
    },
    about="F-28.",
)

# --- operators over the orders -----------------------------------------------------------


@query(f"WITH {CAM_SQL} SELECT count_if(validation_status IS NOT NULL AND validation_status <> 'not_validated')::BIGINT AS attempted, count_if({STATE} IN ('active_live_verified', 'active_image_snapshot_refreshing'))::BIGINT AS live, count_if({STATE} IN ('dead_link', 'restricted_http', 'static_image_asset'))::BIGINT AS dead, count_if(validation_status IN ('', 'decode_failed', 'auth_required_rtsp'))::BIGINT AS unknown, count_if(coalesce(validation_status, 'not_validated') = 'not_validated')::BIGINT AS skipped FROM cam")
def validation_tallies(spark: SparkSession, d: str) -> DataFrame:
    """A-23."""
    return trust.tallies(cams(spark, d))


@query(
    f"WITH {CAM_SQL}, k AS (SELECT *, CASE WHEN _ord % 7 = 1 THEN 'image' ELSE 'hls' END AS kind, (_ord // 7) % 4 AS p FROM cam) SELECT _ord, CASE WHEN scope_status <> 'in_scope' THEN validation_status WHEN kind = 'hls' THEN CASE p WHEN 0 THEN 'active_live_unknown' WHEN 1 THEN 'restricted_http' WHEN 2 THEN 'decode_failed' ELSE 'dead_link' END "
    "ELSE CASE p WHEN 0 THEN 'image_snapshot_not_image' WHEN 1 THEN 'restricted_http' WHEN 2 THEN 'image_snapshot_not_image' ELSE 'dead_link' END END AS status, "
    "CASE WHEN scope_status <> 'in_scope' THEN trust_level WHEN kind = 'hls' AND p IN (0, 2) THEN CASE WHEN p = 0 THEN 'trusted' ELSE 'untrusted' END ELSE 'rejected' END AS trust FROM k"
)
def validated_candidates(spark: SparkSession, d: str) -> DataFrame:
    """F-68, J-11: probes of three quarters of the URLs, and the trust that follows."""
    rows = cams(spark, d)
    probes = rows.filter("(_ord div 7) % 4 < 3").selectExpr("stream_url", "explode(array(1, 2)) AS sample", "CASE (_ord div 7) % 4 WHEN 1 THEN 403 ELSE 200 END AS http_status", "'' AS content_type", "cast(null AS string) AS etag", "cast(null AS string) AS last_modified", "'' AS cache_control", "'h' AS body_sha", "cast(null AS binary) AS body_head", "CASE (_ord div 7) % 4 WHEN 0 THEN '#EXTM3U' ELSE '' END AS body", "cast(null AS string) AS error", "cast(null AS string) AS rtsp_status", "cast(null AS int) AS segment_status")
    return trust.validated(rows, probes).select("_ord", F.col("validation_status").alias("status"), F.col("trust_level").alias("trust"))


@query(
    f"WITH {CAM_SQL} SELECT _ord, CASE WHEN scope_status = 'out_of_scope' AND trust_level = 'rejected' THEN 'out_of_scope' WHEN _ord % 3 = 0 AND _ord % 2 = 0 THEN 'out_of_scope' WHEN _ord % 3 = 1 AND target_id <> 't2' AND lat IS NOT NULL AND scope_status <> 'out_of_scope' THEN 'in_scope' "
    "WHEN _ord % 3 IN (1, 2) AND NOT (_ord % 3 = 1 AND target_id <> 't2' AND lat IS NOT NULL) AND scope_status = 'unknown' THEN 'review' ELSE scope_status END AS scope, CASE _ord % 3 WHEN 0 THEN 'out_of_scope' WHEN 1 THEN 'in_scope' ELSE 'review' END AS decision FROM cam"
)
def reviewed_candidates(spark: SparkSession, d: str) -> DataFrame:
    """F-72, J-08: advisory answers by candidate; out of scope needs confidence, in scope a verified target and coordinates."""
    rows = cams(spark, d).withColumn("candidate_id", F.col("_ord").cast("long"))
    answers = rows.selectExpr("candidate_id", "1 AS _ord", "CASE candidate_id % 3 WHEN 0 THEN 'out_of_scope' WHEN 1 THEN 'In_Scope' ELSE 'perhaps' END AS decision", "CASE WHEN candidate_id % 2 = 0 THEN 0.75D ELSE 0.5D END AS confidence", "'r' AS reason")
    return trust.reviewed(rows, answers, target_rows(spark)).select("_ord", F.col("scope_status").alias("scope"), F.col("llm_semantic_decision").alias("decision"))


@query(
    f"WITH {CAM_SQL}, q AS (SELECT *, lat IS NULL AND location_text IS NOT NULL AS asks, CASE WHEN _ord % 7 IN (0, 2) THEN 1 WHEN _ord % 7 = 1 THEN 2 ELSE 2 END AS _r FROM cam), "
    "a AS (SELECT _ord, row_number() OVER (PARTITION BY target_id ORDER BY CASE WHEN _ord % 7 IN (0, 2) THEN 1 ELSE 2 END, stream_url, _ord) AS n FROM q WHERE asks) "
    "SELECT q._ord, CASE WHEN lat IS NOT NULL THEN lat::DOUBLE WHEN asks AND n <= 500 AND target_id <> 't1' THEN 10.5 END AS lat, CASE WHEN lat IS NULL AND asks AND n <= 500 AND target_id <> 't1' THEN 'candidate_geocoder' END AS source, "
    "CASE WHEN lat IS NULL AND asks AND n <= 500 AND target_id = 't1' THEN 1 ELSE 0 END::INTEGER AS refused FROM q LEFT JOIN a USING (_ord)"
)
def enriched_candidates(spark: SparkSession, d: str) -> DataFrame:
    """F-70, J-10, W-04: geocoded places for rows without coordinates; the first of each target (the limit is the feature) are asked, answers outside of a verified target are refused."""
    rows = cams(spark, d).withColumns({"coordinate_source": F.lit(None).cast("string"), "title": F.lit(None).cast("string"), "location_text": F.when(F.col("location_text").isNotNull(), F.concat(F.col("location_text"), F.lit(" at Main St")))})
    routes = spark.range(40).select(F.explode(F.array(*[F.concat(F.lit("Route "), F.col("id").cast("string"), F.lit(f" at Main St, Place {k}, Land, Region, Land")) for k in range(3)])).alias("query"))
    geocodes = routes.select("query", F.lit(10.5).alias("lat"), F.lit(10.5).alias("lon"), F.lit("x").alias("display_name"))
    out = scope.enriched(rows, target_rows(spark), geocodes, 500)
    return out.select("_ord", "lat", F.col("coordinate_source").alias("source"), F.array_contains("reasons", "candidate_geocode_outside_verified_target_polygon").cast("int").alias("refused"))


@query("WITH r AS (SELECT o_orderkey AS k, o_custkey % 4 AS g, o_custkey % 3 AS s, o_orderkey % 5 = 0 AS sel FROM orders) SELECT count(*)::BIGINT AS generated_rows, count_if(sel)::BIGINT AS selected_rows, count_if(sel AND g = 0)::BIGINT AS selected_directory_rows, count_if(sel AND g IN (1, 2))::BIGINT AS selected_blind_rows, count_if(sel AND g = 3)::BIGINT AS selected_direct_rows, count_if(g = 0)::BIGINT AS generated_directory_rows, count_if(g IN (1, 2))::BIGINT AS generated_blind_rows, count_if(g = 3)::BIGINT AS generated_direct_rows, count_if(s = 0)::BIGINT AS blocked_source_rows, count_if(sel AND g = 2)::BIGINT AS selected_plain_blind_rows FROM r")
def source_row_counts(spark: SparkSession, d: str) -> DataFrame:
    """A-13."""
    rows = t(spark, d, "orders").selectExpr("CASE o_custkey % 4 WHEN 0 THEN 'directory' WHEN 1 THEN 'blind:ddg' WHEN 2 THEN 'blind' ELSE 'direct' END AS source_provider", "o_orderkey % 5 = 0 AS selected", "o_custkey % 3 = 0 AS blocked")
    return summarize.source_rows_summary(rows)


RECORD_COLUMNS = {
    "lat": "CASE WHEN event_id % 2 = 0 THEN 1.0D END", "lon": "CASE WHEN event_id % 3 = 0 THEN 1.0D END", "direction": "CASE WHEN event_id % 5 = 0 THEN 'N' ELSE '' END", "bearing": "cast(null AS string)", "heading": "CASE WHEN event_id % 7 = 0 THEN '90' END",
    "orientation": "''", "date": "''", "time": "cast(null AS string)", "timestamp": "CASE WHEN event_id % 4 = 0 THEN 'x' END", "last_updated": "''", "last_refresh": "''", "in_service": "CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END",
    "current_image_update_frequency": "CASE WHEN event_id % 6 = 0 THEN '60' END", "reference_image_update_frequency": "''", "asset_role": "CASE event_id % 4 WHEN 0 THEN 'current_image_snapshot' WHEN 1 THEN 'reference_image_snapshot' WHEN 2 THEN 'hls_stream' ELSE 'thumbnail' END",
    "camera_record_id": "CASE WHEN event_id % 8 > 0 THEN 'cam:' || user_id END", "media_type": "event_type", "source_provider": "CASE WHEN event_id % 2 = 0 THEN 'directory' END", "source_url": "'https://S' || (user_id % 9) || '.example/x'",
}


def records(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").selectExpr(*[f"{v} AS {k}" for k, v in RECORD_COLUMNS.items()])


@query(
    "SELECT count(*)::BIGINT AS url_records, count_if(event_id % 6 = 0)::BIGINT AS records_with_coordinates, count_if(event_id % 5 = 0 OR event_id % 7 = 0)::BIGINT AS records_with_orientation, count_if(event_id % 4 = 0)::BIGINT AS records_with_timestamps, count_if(event_id % 3 < 2)::BIGINT AS records_with_in_service, count_if(event_id % 3 = 0)::BIGINT AS in_service_true, count_if(event_id % 3 = 1)::BIGINT AS in_service_false, "
    "count_if(event_id % 6 = 0)::BIGINT AS records_with_update_frequency, count_if(event_id % 4 = 0)::BIGINT AS current_images, count_if(event_id % 4 = 1)::BIGINT AS reference_images, count_if(event_id % 4 = 2)::BIGINT AS streams, count_if(event_id % 8 > 0)::BIGINT AS records_of_cameras, count(DISTINCT CASE WHEN event_id % 8 > 0 THEN user_id END)::BIGINT AS cameras FROM events"
)
def harvest_record_counts(spark: SparkSession, d: str) -> DataFrame:
    """A-15."""
    return summarize.harvest_summary(records(spark, d))


@query("SELECT 'media_type' AS dimension, coalesce(nullif(event_type, ''), 'unknown') AS key, count(*)::BIGINT AS n FROM events GROUP BY 2 UNION ALL SELECT 'source_provider', CASE WHEN event_id % 2 = 0 THEN 'directory' ELSE 'unknown' END, count(*)::BIGINT FROM events GROUP BY 2 UNION ALL SELECT 'source_host', 's' || (user_id % 9) || '.example', count(*)::BIGINT FROM events GROUP BY 2")
def harvest_key_counts(spark: SparkSession, d: str) -> DataFrame:
    """A-14."""
    return summarize.harvest_counts(records(spark, d))


@query(f"WITH {CAM_SQL}, b AS (SELECT {BUCKET_SQL} AS b FROM cam) SELECT b::INTEGER AS bucket, count(*)::BIGINT AS n FROM b GROUP BY 1")
def priority_counts(spark: SparkSession, d: str) -> DataFrame:
    """A-18, A-19: candidates by bucket."""
    ranked = rank.prioritized(cams(spark, d).withColumn("camera_evidence_score", F.lit(0)))
    found = summarize.buckets(ranked)
    place = F.array_position(F.array(*map(F.lit, rank.BUCKETS)), F.col("candidate_priority_bucket")) - 1
    return found.select(place.cast("int").alias("bucket"), "n")


@query("SELECT event_type AS media_type, 'asset:' || sha256(u || '')[1:16] AS asset_id, coalesce(c, 'url:' || sha256(u)[1:16]) AS camera_record_id, u AS url, false AS trusted FROM (SELECT event_type, 'https://m.example/' || event_id AS u, CASE WHEN event_id % 8 > 0 THEN 'cam:' || user_id END AS c FROM events)")
def inventory_rows(spark: SparkSession, d: str) -> DataFrame:
    """K-08: URL records as cameras of one asset each."""
    ev = t(spark, d, "events").selectExpr("'https://m.example/' || event_id AS url", *[f"{v} AS {k}" for k, v in RECORD_COLUMNS.items()])
    out = sinks.url_inventory(ev.withColumns({c: F.lit(None).cast("string") for c in ("asset_id", "asset_field", "field_path")}))
    a = F.col("media_assets")[0]
    return out.select(a["media_type"].alias("media_type"), a["asset_id"].alias("asset_id"), "camera_record_id", a["url"].alias("url"), "trusted")


@query(f"WITH {CAM_SQL} SELECT _ord, coalesce(title, 'Camera candidate') AS name, lon::DOUBLE AS lon, lat::DOUBLE AS lat, coalesce(trust_level, 'untrusted') AS trust, target_id <> 't2' AS box FROM cam WHERE lat IS NOT NULL")
def candidate_features(spark: SparkSession, d: str) -> DataFrame:
    """K-11: GeoJSON features of located candidates, read back."""
    rows = cams(spark, d).withColumns({c: F.lit(None).cast("string") for c in ("geocoded_display_name", "llm_semantic_decision", "target_label")})
    v = lambda p: F.get_json_object("value", p)
    got = sinks.features(rows, target_rows(spark), trusted=False)
    return got.select("_ord", v("$.properties.name").alias("name"), v("$.geometry.coordinates[0]").cast("double").alias("lon"), v("$.geometry.coordinates[1]").cast("double").alias("lat"), v("$.properties.trust_level").alias("trust"), v("$.properties.target_bbox_trusted").cast("boolean").alias("box"))


@query(f"WITH {CAM_SQL} SELECT _ord, '| ' || coalesce(title, '') || ' | ' || coalesce(location_text, '') || ' | ' || stream_url || ' |' AS value FROM cam")
def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    """K-13."""
    return sinks.markdown_rows(cams(spark, d), "title", "location_text", "stream_url")


@query("SELECT 't0' AS target_id, 'fallback' AS role, 'Polygon' AS kind UNION ALL SELECT 't1', 'primary', 'MultiPolygon'")
def target_shapes(spark: SparkSession, d: str) -> DataFrame:
    """K-12: geometry of targets, of the targets' table of the other queries."""
    return sinks.target_features(target_rows(spark)).select("target_id", "role", F.get_json_object("geometry", "$.type").alias("kind"))


@query("WITH u AS (SELECT page_id, url FROM pages) SELECT page_id, 'ddg' AS engine, 0::BIGINT AS k, regexp_replace(url, '#.*$', '') AS url, 'T' || page_id AS title FROM u UNION ALL SELECT page_id, 'ddg', 1, 'https://second.example/' || page_id, 'Two' FROM u UNION ALL SELECT page_id, 'bing', 0, 'https://second.example/' || page_id, 'B' FROM u")
def search_results(spark: SparkSession, d: str) -> DataFrame:
    """S-17, S-18: saved result pages of two engines, made of the pages' URLs."""
    pages = t(spark, d, "pages").select(F.col("page_id").cast("string").alias("query"), F.col("url").alias("u"))
    ddg = F.concat(F.lit('<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg='), F.url_encode("u"), F.lit('">T'), F.col("query"), F.lit('</a><a href="/settings">S</a></div><h3><a href="https://second.example/'), F.col("query"), F.lit('">Two</a></h3>'))
    bing = F.concat(F.lit('<li class="b_algo"><h2><a href="https://second.example/'), F.col("query"), F.lit('">B</a></h2></li><a href="https://www.bing.com/x">x</a>'))
    both = pages.select("query", F.lit("ddg").alias("search_engine"), ddg.alias("body")).unionByName(pages.select("query", F.lit("bing").alias("search_engine"), bing.alias("body")))
    return search.parse_pages(both).select(F.col("query").cast("long").alias("page_id"), F.col("search_engine").alias("engine"), F.col("_ord").alias("k"), "url", "title")


@query("SELECT page_id, 0::BIGINT AS k, regexp_replace(url, '#.*$', '') AS url, regexp_replace(url, '#.*$', '') AS title FROM pages")
def search_answers(spark: SparkSession, d: str) -> DataFrame:
    """S-19: JSON answers; untitled results are named by their URL, repeats and other schemes go."""
    own = t(spark, d, "pages").select(F.col("page_id").cast("string").alias("query"), "url")
    r = lambda u, title: F.struct(u.alias("url"), F.lit(title).alias("title"), F.lit("s").alias("content"))
    body = F.to_json(F.struct(F.array(r(F.col("url"), ""), r(F.col("url"), "again"), r(F.lit("ftp://x"), "no")).alias("results")))
    return search.parse_json(own.select("query", body.alias("body"))).select(F.col("query").cast("long").alias("page_id"), F.col("_ord").alias("k"), "url", "title")


@query("SELECT n_nationkey, 't' || k AS target_id, CASE WHEN n_nationkey % 2 = 0 THEN 'https://page' || n_nationkey || '.example/x' ELSE 'https://site.example/' END AS first_url, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END::INTEGER AS single FROM nation, (SELECT unnest(range(0, 3)) AS k) WHERE n_nationkey % 5 > 0 AND n_nationkey % 2 = 0")
def registry_rows(spark: SparkSession, d: str) -> DataFrame:
    """S-05, S-09, S-10: enabled registry entries as rows for each target."""
    own = t(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("entry_ord"), F.col("n_name").alias("name"), F.concat(F.lit("https://page"), F.col("n_nationkey").cast("string"), F.lit(".example/x#f")).alias("url"), F.lit("page").alias("source_type"), F.lit("").alias("scope_hint"), F.lit(None).cast("string").alias("notes"), (F.col("n_nationkey") % 5 > 0).alias("enabled"))
    rows = R.entry_rows(own.filter("entry_ord % 2 = 0"), target_rows(spark), "directory")
    return rows.select((F.col("_ord") / 100000).cast("long").alias("n_nationkey"), "target_id", F.col("url").alias("first_url"), F.lit(1).alias("single"))


@query("WITH s AS (SELECT s_suppkey, 'https://d' || s_suppkey || '.example/' || CASE WHEN s_suppkey % 2 = 0 THEN 'cameras' ELSE 'news' END AS u, s_suppkey % 7 = 0 AS bad FROM supplier) SELECT s_suppkey * 1000 + k AS o, CASE WHEN k = 1 THEN u ELSE u || '?page=' || k END AS url, CASE WHEN k > 1 THEN 'pagination_page_' || k END AS note FROM s, (SELECT unnest(range(1, 4)) AS k) WHERE NOT bad AND (k = 1 OR s_suppkey % 2 = 0)")
def selected_sources(spark: SparkSession, d: str) -> DataFrame:
    """P-05, P-06, O-04: rows that are followed, with further pages of directories; others are no web addresses."""
    own = t(spark, d, "supplier").selectExpr("s_suppkey AS _ord", "CASE WHEN s_suppkey % 7 = 0 THEN 'mailto:x' ELSE 'https://d' || s_suppkey || '.example/' || CASE WHEN s_suppkey % 2 = 0 THEN 'cameras' ELSE 'news' END END AS url", "'page' AS source_kind")
    good, _ = R.selected(own, [], 3)
    return good.select(F.col("_ord").alias("o"), "url", F.col("discovery_note").alias("note"))


@query("SELECT o_orderkey AS _ord, CASE WHEN o_orderkey % 7 = 0 THEN 0 WHEN o_orderkey % 7 = 2 THEN 1 ELSE 2 END::INTEGER AS enrichment FROM orders")
def enrichment_ranks(spark: SparkSession, d: str) -> DataFrame:
    """O-03: HLS with a word in its path that may name a place, other HLS, images."""
    rows = cams(spark, d).withColumn("stream_url", F.when(F.col("_ord") % 7 == 2, F.lit("https://h.example/live/playlist.m3u8")).otherwise(F.col("stream_url")))
    return rows.select("_ord", rank.enrichment_rank().alias("enrichment"))


QUERIES_OF_PLACES = [
    ("traffic cameras from California and West Virginia", "California|West Virginia", "state|state", "traffic|traffic"),
    ("weather webcams near Lane County", "Lane County", "county", "weather"),
    ("live cameras in Springfield, Ohio", "Springfield, Ohio", "place", "public_live"),
    ("airport cameras in greater Boston", "greater Boston", "metro", "public_live"),
    ("beach webcams around Lake Tahoe; Santa Cruz", "Lake Tahoe|Santa Cruz", "place|place", "webcam|webcam"),
]


@query("SELECT p_partkey, " + ", ".join(f"{dealt([c[k] for c in QUERIES_OF_PLACES])} AS {n}" for k, n in ((1, "places"), (2, "scopes"), (3, "kinds"))) + " FROM part")
def target_intents(spark: SparkSession, d: str) -> DataFrame:
    """F-73, F-74: targets that a query names, with scope and kind.  Queries are a user's, so few: each distinct one is read once."""
    asked = t(spark, d, "part").select("p_partkey", F.expr(dealt([c[0] for c in QUERIES_OF_PLACES])).alias("query"))
    found = [(q, *["|".join(str(i[k]) for i in targets.intents(q)) for k in ("canonical_target", "scope_type", "camera_type")]) for q, *_ in QUERIES_OF_PLACES]
    return asked.join(F.broadcast(spark.createDataFrame(found, "query string, places string, scopes string, kinds string")), "query").drop("query")


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'verified' WHEN 2 THEN 'unverified_review_only' ELSE 'missing' END AS status, CASE n_nationkey % 4 WHEN 0 THEN 'nominatim_bbox' WHEN 1 THEN 'geocoder_padded' WHEN 2 THEN 'generic_point_bbox' END AS source, CASE WHEN n_nationkey % 4 < 2 THEN 'trusted_allowed' ELSE 'stop' END AS policy, n_nationkey % 4 = 1 AS padded FROM nation")
def resolved_targets(spark: SparkSession, d: str) -> DataFrame:
    """F-74, O-05: geometry and trust of a target by its best answer; rejected answers don't count."""
    box = "struct<min_lat:double,max_lat:double,min_lon:double,max_lon:double>"
    base = t(spark, d, "nation").filter("n_nationkey % 4 < 3").selectExpr("n_nationkey", "cast(n_nationkey AS string) AS target_id", "explode(array(1, 2)) AS _ord")
    wide, tiny = G.box(38, 42, -85, -80), G.box(1, 1.0001, 2, 2.0001)
    kind = F.expr("CASE WHEN _ord = 2 AND n_nationkey % 4 = 0 THEN 'road' WHEN n_nationkey % 4 = 0 THEN 'administrative' WHEN n_nationkey % 4 = 1 THEN 'monument' ELSE 'x' END")
    answers = base.withColumns({
        "display_name": F.lit("Place, Land"), "result_type": kind, "lat": F.lit(1.0), "lon": F.lit(2.0), "bbox": F.when(F.col("n_nationkey") % 4 == 0, wide).when(F.col("n_nationkey") % 4 == 1, tiny).otherwise(F.lit(None).cast(box)),
        "scope_type": F.expr("CASE WHEN n_nationkey % 4 = 0 THEN 'state' ELSE 'place' END"), "admin_region": F.lit(None).cast("string"), "country": F.lit("Land"), "place_name": F.lit("x"), "raw_class": F.lit(""), "raw_type": F.lit(""), "polygons": F.lit(None).cast(scope.POLYGONS),
    })
    asked = t(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("target_id"), F.lit(None).cast(box).alias("llm_bbox"))
    out = targets.resolved(targets.scored(answers), asked, validation=True, fast=False)
    return out.select(F.col("target_id").cast("int").alias("n_nationkey"), F.col("geometry_status").alias("status"), F.col("geometry_source").alias("source"), F.col("trust_policy").alias("policy"), F.col("bbox_padding_applied").alias("padded"))


@query("SELECT n_nationkey, i::INTEGER AS i, (20 + i + CASE WHEN i = 2 THEN 0 WHEN n_nationkey % 3 = 0 THEN 7.5 WHEN n_nationkey % 3 = 1 THEN -5 ELSE 1.5 END)::DOUBLE AS score FROM nation, (SELECT unnest([0, 1, 2]) AS i)")
def refereed_answers(spark: SparkSession, d: str) -> DataFrame:
    """F-66, J-09: advisory rankings move the score of answers that aren't rejected."""
    both = t(spark, d, "nation").select("n_nationkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("index"))
    own = both.select(F.col("n_nationkey").alias("query_id"), "index", (F.col("index") + 20.0).alias("score"), (F.col("index") == 2).alias("rejected"))
    said = both.select(F.col("n_nationkey").alias("query_id"), "index", F.lit(1).alias("_ord"), F.expr("CASE n_nationkey % 3 WHEN 0 THEN 'Accept' WHEN 1 THEN 'reject' ELSE 'unsure' END").alias("recommendation"), F.lit(0.5).alias("confidence"))
    return trust.refereed(own, said).select(F.col("query_id").alias("n_nationkey"), F.col("index").alias("i"), "score")


@query("SELECT c_nationkey::INTEGER AS file, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INTEGER AS feature_ord, 'Point' AS geometry_type, ((c_custkey * 7919 % 3600) / 10.0 - 180)::DOUBLE AS lon, ((c_custkey * 104729 % 1800) / 10.0 - 90)::DOUBLE AS lat, c_name || ' }{\"[' || c_custkey AS name FROM customer")
def feature_rows(spark: SparkSession, d: str) -> DataFrame:
    """S-29 by splits: customers written as a collection for each nation, and read again."""
    lon, lat = ((F.col("c_custkey") * a % m / F.lit(10.0) - b).cast("double") for a, m, b in ((7919, 3600, 180), (104729, 1800, 90)))
    name = F.concat("c_name", F.lit(' }{"['), F.col("c_custkey").cast("string"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(name.alias("name")).alias("properties"))
    own = t(spark, d, "customer").select("c_nationkey", F.col("c_custkey").alias("o"), F.concat(F.lit(","), F.to_json(feature)).alias("value"))
    nations = own.select("c_nationkey").distinct()
    ends = [nations.select("c_nationkey", F.lit(o).cast("long").alias("o"), F.lit(v).alias("value")) for o, v in ((-1, '{"type": "FeatureCollection", "features": [null'), (2**62, "]}"))]
    path = f"{folder(spark)}/collections-{uuid.uuid4().hex}"
    own.unionByName(ends[0]).unionByName(ends[1]).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "o").select("c_nationkey", "value").write.partitionBy("c_nationkey").text(path)
    return read_features(spark, path).select(F.regexp_extract("source_geojson", r"c_nationkey=(\d+)", 1).cast("int").alias("file"), "feature_ord", "geometry_type", "lon", "lat", F.col("properties")["name"].alias("name"))

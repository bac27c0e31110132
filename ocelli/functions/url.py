"""URL expressions by regular expressions, without UDFs.

``parse_url`` raises on characters that occur in crawled text and keeps the
host's case, so a URL is cut by the pattern of the generic syntax instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

MEDIA_SUFFIX = r"\.(m3u8|mjpg|mjpeg|jpg|jpeg|png|webp|mp4|webm|mov|m4v)"
MEDIA_EXTENSION = r"(?i)" + MEDIA_SUFFIX + r"(?:$|[?#])"
GENERIC = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# The same, where a line break may stand in a URL.
GENERIC = "(?s)" + GENERIC

# Query keys whose values are masked.
SENSITIVE_KEYS = ("access_token", "api_key", "apikey", "auth", "authorization", "client_secret", "code", "key", "password", "secret", "session", "sig", "signature", "token")
SENSITIVE_PARTS = ("token", "secret", "password", "signature")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once for a row, however often ``f`` names it."""
    return F.transform(F.array(value), lambda v: f(v))[0]


def part(url: Column, n: int) -> Column:
    """1: scheme, 2: authority, 3: path, 4: query, 5: fragment; absent parts are empty."""
    return F.regexp_extract(text(url), GENERIC, n)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    return part(url, 2)


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def host(url: Column) -> Column:
    """Host name in lower case, without user and port."""
    return host_of(authority(url))


def host_of(authority: Column) -> Column:
    return F.lower(F.regexp_extract(authority, r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def port(url: Column) -> Column:
    return port_of(authority(url))


def port_of(authority: Column) -> Column:
    return F.regexp_extract(authority, r":(\d+)$", 1)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(text(url), "(?s)#.*$", "")


def unescape_slashes(url: Column) -> Column:
    return F.regexp_replace(text(url), r"\\(?:/|u002[Ff])", "/")


def prefer_embedded(url: Column) -> Column:
    """The first scheme-relative media URL that another URL has swallowed, with that one's scheme; else the URL."""
    swallowed = lambda u: F.regexp_extract(u, r"(?i)(?<!:)(//[A-Za-z0-9.-]+\.[A-Za-z]{2,}/[^\s'\"<>]*?" + MEDIA_SUFFIX + r"(?:[?#][^\s'\"<>]*)?)(?=$|[\s'\"<>])", 1)
    with_scheme = lambda own, inner: F.concat(F.when(own == "", F.lit("https")).otherwise(own), F.lit(":"), inner)
    return once(url, lambda u: once(swallowed(u), lambda inner: F.when(inner != "", with_scheme(scheme(u), inner)).otherwise(u)))


def strip_trailers(url: Column) -> Column:
    """Trimmed, slashes unescaped, closing punctuation cut, an embedded media URL preferred."""
    cut = F.regexp_replace(unescape_slashes(F.trim(text(url))), r"[\\'\"),;}\]\s]+$", "")
    return prefer_embedded(cut)


def _assembled(value: Column, keep_user: bool) -> Column:
    cut = once(value, lambda v: F.array(*[part(v, n) for n in range(1, 5)]))
    return once(cut, lambda p: _joined(F.lower(p[0]), p[1], p[2], p[3], keep_user))


def _joined(own: Column, auth: Column, path: Column, q: Column, keep_user: bool) -> Column:
    proto = F.when((own == "") & (auth != ""), "https").otherwise(own)
    number = port_of(auth)
    default = ((proto == "https") & (number == "443")) | ((proto == "http") & (number == "80"))
    name = F.concat(host_of(auth), F.when((number == "") | default, "").otherwise(F.concat(F.lit(":"), number)))
    if keep_user:
        user = F.regexp_extract(auth, r"^(.*)@", 1)
        name = F.when(user != "", F.concat(user, F.lit("@"), name)).otherwise(name)
    return F.concat(
        F.when(proto != "", F.concat(proto, F.lit(":"))).otherwise(""),
        F.when(auth != "", F.concat(F.lit("//"), name)).otherwise(""),
        path,
        F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""),
    )


def canonical(url: Column) -> Column:
    """Canonical media URL of the harvest: trailers cut, scheme and host lower, default ports and fragment dropped, user kept."""
    return _assembled(strip_trailers(url), True)


def canonical_structured(url: Column) -> Column:
    """The variant for structured records: no trailers cut, user dropped."""
    return _assembled(prefer_embedded(unescape_slashes(F.trim(text(url)))), False)


def cleaned(url: Column) -> Column:
    """Absolute URLs in canonical form, others without outer punctuation."""
    raw = unescape_slashes(F.trim(text(url)))
    return F.when(raw.rlike(r"^(?:(?:https?|rtsps?):)?//"), canonical(raw)).otherwise(F.regexp_replace(raw, r"^['\"),;}\]]+|['\"),;}\]]+$", ""))


def redacted_user(url: Column) -> Column:
    """User and password masked."""
    return F.regexp_replace(text(url), r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#]*@", "$1***:***@")


def redacted(url: Column) -> Column:
    """User masked, and the values of sensitive query keys (``%2A%2A%2A``); null stays null."""
    pieces = F.filter(F.split(query(url), "&"), lambda p: p != "")

    def mask(p: Column) -> Column:
        key = F.lower(F.substring_index(p, "=", 1))
        hidden = key.isin(*SENSITIVE_KEYS)
        for t in SENSITIVE_PARTS:
            hidden = hidden | key.contains(t)
        plain = F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))
        return F.when(hidden, F.concat(F.substring_index(p, "=", 1), F.lit("=%2A%2A%2A"))).otherwise(plain)

    q = F.array_join(F.transform(pieces, mask), "&")
    base = redacted_user(F.regexp_replace(text(url), r"(?s)[?#].*$", ""))
    fragment = part(url, 5)
    full = F.concat(base, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""), F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))
    return F.when(url.isNull() | (url == ""), url).otherwise(full)


def query_map(url: Column) -> Column:
    """Query as a map, the first value of a repeated key, keys without a value as empty."""
    pairs = F.transform(
        F.filter(F.split(query(url), "&"), lambda p: p != ""),
        lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(p.contains("="), F.regexp_extract(p, "(?s)=(.*)$", 1)).otherwise("").alias("v")),
    )
    keys = F.transform(pairs, lambda p: p["k"])
    return F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(keys, p["k"]) == i + 1))


def with_page(url: Column, page: Column) -> Column:
    """The URL with its ``page`` parameter replaced or added."""
    rest = F.filter(F.split(query(url), "&"), lambda p: (p != ""))
    number = F.concat(F.lit("page="), page.cast("string"))
    has = F.exists(rest, lambda p: F.substring_index(p, "=", 1) == "page")
    first = F.array_position(F.transform(rest, lambda p: F.substring_index(p, "=", 1)), F.lit("page"))
    swapped = F.filter(F.transform(rest, lambda p, i: F.when(F.substring_index(p, "=", 1) != "page", p).when(i + 1 == first, number)), lambda p: p.isNotNull())
    joined = F.array_join(F.when(has, swapped).otherwise(F.concat(rest, F.array(number))), "&")
    fragment = part(url, 5)
    return F.concat(F.regexp_replace(text(url), r"(?s)[?#].*$", ""), F.lit("?"), joined, F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""))


def paginated_directory(url: Column) -> Column:
    low = F.lower(text(url))
    return low.startswith("http") & low.rlike(r"/camera|/traffic|/category/|/livet|webcam|cctv")


def pagination_like(url: Column) -> Column:
    return F.lower(text(url)).rlike(r"page=|/page/|offset=|start=|next|camera|webcam|cctv")


def endpoint_type(url: Column, content_type: Column | None = None) -> Column:
    low, kind = F.lower(text(url)), F.lower(text(content_type if content_type is not None else F.lit("")))
    return (
        F.when(kind.contains("geojson") | low.endswith(".geojson") | low.contains("f=geojson"), "geojson")
        .when(low.contains("featureserver"), "arcgis_featureserver")
        .when(low.contains("mapserver"), "arcgis_mapserver")
        .when(kind.contains("rss") | low.endswith(".rss"), "rss")
        .when(kind.contains("xml") | low.endswith(".xml"), "xml")
        .when(kind.contains("json") | low.endswith(".json") | low.contains("f=json"), "json")
        .otherwise("unknown_api")
    )


def expanded_endpoints(url: Column) -> Column:
    """The URL and what it expands to: layer queries of a map service, the query of a layer, default parameters of a bare query."""
    tail = "query?where=1%3D1&outFields=*&returnGeometry=true&f=json"
    bare = F.regexp_replace(F.regexp_replace(text(url), r"(?s)[?#].*$", ""), "/+$", "")
    way = F.regexp_replace(path(url), "/+$", "")
    layers = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.concat(bare, F.lit("/"), k.cast("string"), F.lit("/" + tail)))
    return (
        F.when(way.rlike("(?i)/(?:MapServer|FeatureServer)$"), F.concat(F.array(url), layers))
        .when(way.rlike(r"(?i)/(?:MapServer|FeatureServer)/\d+$"), F.array(url, F.concat(bare, F.lit("/" + tail))))
        .when(F.lower(way).contains("/query") & (query(url) == ""), F.array(url, F.concat(F.regexp_replace(text(url), r"(?s)[?#].*$", ""), F.lit("?" + tail.partition("?")[2]), F.when(part(url, 5) != "", F.concat(F.lit("#"), part(url, 5))).otherwise(""))))
        .otherwise(F.array(url))
    )


def camera_id(url: Column) -> Column:
    """Stem of the last path segment; of the one before where that is a playlist."""
    parts = F.filter(F.transform(F.split(path(url), "/"), lambda p: F.trim(p)), lambda p: p != "")
    stem = lambda p: F.trim(F.substring_index(F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p), ".", 1))
    last, before = F.try_element_at(parts, F.lit(-1)), F.try_element_at(parts, F.lit(-2))
    return F.nullif(F.when((F.lower(stem(last)) == "playlist") & before.isNotNull(), stem(before)).otherwise(stem(last)), F.lit(""))


def road_name(url: Column) -> Column:
    """A readable road name from a compact slug such as ``sr99_nb_at_5thst``; null without a clue of a road."""
    s = F.regexp_replace(F.lower(text(camera_id(url))), r"[_\-]+", " ")
    for pattern, to in (
        (r"sr(\d{1,3})(\d+(?:st|nd|rd|th))", "SR $1 $2"),
        (r"\bsr\s*(\d+)", "SR $1 "),
        (r"\bus\s*(\d+)", "US $1 "),
        (r"\bi\s*(\d+)", "I-$1 "),
        (r"\bnb\b", "NB"),
        (r"\bsb\b", "SB"),
        (r"\beb\b", "EB"),
        (r"\bwb\b", "WB"),
        (r"(?<=\d)nb", " NB "),
        (r"(?<=\d)sb", " SB "),
        (r"(?<=\d)eb", " EB "),
        (r"(?<=\d)wb", " WB "),
        (r"(\d+)(st|nd|rd|th)", "$1$2 "),
        (r"\bst\b", "St"),
        (r"\brd\b", "Rd"),
        (r"\bave\b", "Ave"),
    ):
        s = F.regexp_replace(s, pattern, to)
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    clue = s.rlike(r"(?i)\b(?:I-|SR|US)\s*\d+\b|\b\d+(?:st|nd|rd|th)\b|\b(?:NB|SB|EB|WB)\b|\b(?:St|Rd|Ave)\b")
    return F.when((F.length(camera_id(url)) >= 4) & clue, F.substring(s, 1, 120))


def promoted_host_urls(name: Column, regions: Column, categories: Column) -> Column:
    """Directory URLs to try on a host: five fixed ones, three for each region, one for each region and category."""
    base = F.concat(F.lit("https://"), name)
    at = lambda *p: F.concat(base, *[F.lit(x) if isinstance(x, str) else x for x in p])
    fixed = F.array(base, *[at(x) for x in ("/cameras", "/camera", "/traffic", "/cctv")])
    by_region = F.flatten(
        F.transform(
            F.slice(regions, 1, 3),
            lambda r: F.concat(F.array(at("/", r), at("/cameras/", r), at("/traffic/", r)), F.transform(F.slice(categories, 1, 3), lambda c: at("/cameras/", r, "/category/", c))),
        )
    )
    return F.array_distinct(F.concat(fixed, by_region))

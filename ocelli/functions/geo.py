"""Coordinates, boxes and polygons.  Boxes are structs, polygons arrays of rings of (lon, lat)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
MILES = 69.0
# Least and most square miles of a target by scope.
AREA_LIMITS = {"city": (1, 5000), "place": (0.01, 10000), "county": (20, 25000), "metro": (50, 75000), "region": (100, 250000), "state": (500, 700000), "country": (1000, 8000000)}
REGIONAL = ("city", "county", "metro", "region", "state", "country")


def valid(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    r = lambda c: F.radians(c.cast("double"))
    a = F.pow(F.sin((r(lat2) - r(lat1)) / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin((r(lon2) - r(lon1)) / 2), 2)
    return F.when(valid(lat1, lon1) & valid(lat2, lon2), 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a)))


def box(min_lat, max_lat, min_lon, max_lon) -> Column:
    col = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(col(min_lat).alias("min_lat"), col(max_lat).alias("max_lat"), col(min_lon).alias("min_lon"), col(max_lon).alias("max_lon"))


def in_box(lat: Column, lon: Column, b: Column) -> Column:
    """Inclusive."""
    return F.coalesce(lat.between(b["min_lat"], b["max_lat"]) & lon.between(b["min_lon"], b["max_lon"]), F.lit(False))


def in_ring(lat: Column, lon: Column, ring: Column, closed: bool = False) -> Column:
    """Even-odd rule along the ring; rings of fewer than three points hold nothing.

    Of the ring's own points the rule takes those of lower edges; with ``closed`` all of them are in it.
    """
    n = F.size(ring)
    ends = lambda i: (F.element_at(ring, i), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1)))
    within = F.size(F.filter(F.sequence(F.lit(1), n), lambda i: crosses(lat, lon, *ends(i)))) % 2 == 1
    if closed:
        within = within | F.exists(F.sequence(F.lit(1), n), lambda i: touches(lat, lon, *ends(i)))
    return F.when(n >= 3, within).otherwise(False)


def crosses(lat: Column, lon: Column, p: Column, q: Column) -> Column:
    """Whether the edge of two points crosses the line from a point towards greater longitudes."""
    dy = q["lat"] - p["lat"]
    at = (q["lon"] - p["lon"]) * (lat - p["lat"]) / F.when(dy == 0, 1e-12).otherwise(dy) + p["lon"]
    return ((p["lat"] > lat) != (q["lat"] > lat)) & (lon < at)


def touches(lat: Column, lon: Column, p: Column, q: Column) -> Column:
    """Whether a point lies on the edge of two points, its ends included."""
    level = (q["lon"] - p["lon"]) * (lat - p["lat"]) == (q["lat"] - p["lat"]) * (lon - p["lon"])
    return level & lat.between(F.least(p["lat"], q["lat"]), F.greatest(p["lat"], q["lat"])) & lon.between(F.least(p["lon"], q["lon"]), F.greatest(p["lon"], q["lon"]))


def in_polygons(lat: Column, lon: Column, polygons: Column, closed: bool = False) -> Column:
    """In any polygon: within its first ring and none of the others; ``closed`` rings hold their edges."""
    hit = F.exists(polygons, lambda rings: (F.size(rings) > 0) & in_ring(lat, lon, F.try_element_at(rings, F.lit(1)), closed) & ~F.exists(F.slice(rings, 2, 100000), lambda h: in_ring(lat, lon, h, closed)))
    return F.coalesce(hit, F.lit(False))


def box_of_polygons(polygons: Column) -> Column:
    """Smallest box around all plausible points; null if there are none or it has no extent."""
    points = F.filter(F.flatten(F.flatten(polygons)), lambda p: valid(p["lat"], p["lon"]))
    lat, lon = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
    b = box(F.array_min(lat), F.array_max(lat), F.array_min(lon), F.array_max(lon))
    return F.when(box_problem(b) == "ok", b)


def box_from_geocoder(values: Column) -> Column:
    """Box of (south, north, west, east) as texts, or null."""
    v = F.transform(values, lambda x: x.try_cast("double"))
    b = box(v[0], v[1], v[2], v[3])
    good = (F.size(v) == 4) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return F.when(good, F.when(box_problem(b) == "ok", b))


def box_problem(b: Column) -> Column:
    """``ok``, or what is wrong with a box."""
    return (
        F.when(b["min_lat"].isNull() | b["max_lat"].isNull() | b["min_lon"].isNull() | b["max_lon"].isNull(), "bbox_missing_keys")
        .when((b["max_lat"] <= b["min_lat"]) | (b["max_lon"] <= b["min_lon"]), "bbox_invalid_order")
        .when(~(valid(b["min_lat"], b["min_lon"]) & valid(b["max_lat"], b["max_lon"])), "bbox_coordinate_out_of_range")
        .otherwise("ok")
    )


def _lon_miles(lat: Column) -> Column:
    return MILES * F.greatest(F.cos(F.radians(lat)), F.lit(0.05))


def box_height(b: Column) -> Column:
    return F.abs(b["max_lat"] - b["min_lat"]) * MILES


def box_width(b: Column) -> Column:
    return F.abs(b["max_lon"] - b["min_lon"]) * _lon_miles((b["min_lat"] + b["max_lat"]) / 2)


def box_plausible(b: Column, scope: Column) -> Column:
    """``ok``, or why a box can't be of a target of this scope."""
    limit = lambda k: F.coalesce(F.create_map(*[F.lit(x) for s, v in AREA_LIMITS.items() for x in (s, float(v[k]))])[scope], F.lit(float((0.01, 8000000)[k])))
    area = box_height(b) * box_width(b)
    return F.when(box_problem(b) != "ok", box_problem(b)).when(area < limit(0), "implausibly_small_for_scope_type").when(area > limit(1), "implausibly_large_for_scope_type").otherwise("ok")


def pad_box(b: Column, miles: float) -> Column:
    """The box widened around its centre to at least ``miles`` on each side."""
    lat, lon = (b["min_lat"] + b["max_lat"]) / 2, (b["min_lon"] + b["max_lon"]) / 2
    dy = F.greatest(box_height(b), F.lit(miles)) / (2 * MILES)
    dx = F.greatest(box_width(b), F.lit(miles)) / (2 * _lon_miles(lat))
    return box(F.greatest(lat - dy, F.lit(-90.0)), F.least(lat + dy, F.lit(90.0)), F.greatest(lon - dx, F.lit(-180.0)), F.least(lon + dx, F.lit(180.0)))


def box_around(lat: Column, lon: Column, miles: float) -> Column:
    return pad_box(box(lat, lat + 1e-9, lon, lon + 1e-9), miles)


def box_geometry(b: Column) -> Column:
    """A box as GeoJSON text."""
    p = lambda x, y: F.array(b[x], b[y])
    ring = F.array(p("min_lon", "min_lat"), p("max_lon", "min_lat"), p("max_lon", "max_lat"), p("min_lon", "max_lat"), p("min_lon", "min_lat"))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def pair_geojson_first(a: Column, b: Column) -> Column:
    """(lat, lon) of a pair that is (lon, lat) if plausible, else (lat, lon)."""
    s = lambda y, x: F.struct(y.cast("double").alias("lat"), x.cast("double").alias("lon"))
    return F.when(valid(b, a), s(b, a)).when(valid(a, b), s(a, b))


def pair_lat_first(a: Column, b: Column) -> Column:
    """(lat, lon) of a pair that is (lat, lon) if plausible, else (lon, lat)."""
    s = lambda y, x: F.struct(y.cast("double").alias("lat"), x.cast("double").alias("lon"))
    return F.when(valid(a, b), s(a, b)).when(valid(b, a), s(b, a))


def pair_geojson_only(a: Column, b: Column) -> Column:
    return F.when(valid(b, a), F.struct(b.cast("double").alias("lat"), a.cast("double").alias("lon")))

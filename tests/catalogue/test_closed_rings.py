"""Points on the edges and corners of rings, by the plain test and by bands."""

import pytest
from pyspark.sql import functions as F

from ocelli.functions import geo as G
from ocelli.operators import scope

BOX = "struct<min_lat:double,max_lat:double,min_lon:double,max_lon:double>"
SQUARE, HOLE, SLANT = [(-6, -6), (6, -6), (6, 6), (-6, 6)], [(-2, -2), (2, -2), (2, 2), (-2, 2)], [(0, 0), (4, 8), (8, 0)]


@pytest.fixture(scope="module")
def spots(spark):
    """Every whole point around, for a square with a hole and for a triangle."""
    shapes = [("square", [[SQUARE, HOLE]]), ("slant", [[SLANT]])]
    rows = [(name, None, [[[(float(x), float(y)) for x, y in ring] for ring in poly] for poly in polys], True) for name, polys in shapes]
    targets = spark.createDataFrame(rows, f"target_id string, bbox {BOX}, polygons {scope.POLYGONS}, bbox_verified boolean")
    at = [(name, float(y), float(x)) for name, _ in shapes for y in range(-8, 10) for x in range(-8, 10)]
    own = spark.createDataFrame([(k, *a) for k, a in enumerate(at)], "_ord long, target_id string, lat double, lon double")
    return targets, own.withColumns({"scope_status": F.lit(""), "trust_level": F.lit(""), "reasons": F.array().cast("array<string>")})


def held(name, y, x):
    if name == "square":
        return max(abs(x), abs(y)) <= 6 and max(abs(x), abs(y)) > 2
    return 0 <= y <= 2 * min(x, 8 - x)


def test_closed_rings_hold_their_edges(spots):
    targets, df = spots
    plain = scope.with_target(df, targets).withColumn("within", G.in_polygons(F.col("lat"), F.col("lon"), F.col("t_polygons"), closed=True)).collect()
    banded = scope.scoped(df, targets, closed=True).collect()
    assert len(plain) == len(banded) == df.count()
    for r in plain:
        assert r.within == held(r.target_id, r.lat, r.lon), r
    for r in banded:
        assert (r.scope_status == "in_scope") == held(r.target_id, r.lat, r.lon), r


def test_open_rings_keep_the_even_odd_rule(spots):
    """A run's scope is as before: of the edges, the lower ones are inside."""
    targets, df = spots
    for r in scope.scoped(df.filter("target_id = 'square'"), targets).collect():
        in_ = lambda n: -n <= r.lat < n and -n <= r.lon < n  # noqa: B023, E731
        assert (r.scope_status == "in_scope") == (in_(6) and not in_(2)), r

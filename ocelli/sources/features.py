"""Features of large GeoJSON collections, read by as many tasks as a file has splits.

A file is cut at every closing brace, which Spark's text source does for splits of a file
side by side.  Whether a piece begins inside a string, and how deep, follows from all
pieces before it; each split sums up what it does to either beginning, those sums are
added along the file (one row a split), and every piece knows its depth.  Pieces between
two objects of depth two make one of these, and those in the top-level ``features`` are read
as JSON.  No task holds more than a split or a feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import Stage

FEATURE = "type string, geometry struct<type:string,coordinates:string>, properties map<string,string>"
#: Text outside of objects: anything but braces, and whole strings.
OUTSIDE = r'(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'
PLACE = ["source_geojson", "block"]


def _before(value: Column | str, how=F.sum) -> Column:
    """What the splits of a file before this one add up to."""
    return how(value).over(Window.partitionBy("source_geojson").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))


def _within(value: Column, how=F.sum) -> Column:
    """What the pieces of a split add up to, this one included."""
    return how(value).over(Window.partitionBy(*PLACE).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))


def pieces(spark: SparkSession, *paths: str) -> DataFrame:
    """Pieces up to a brace, with what each does to the depth for a split that begins outside (0) or inside (1) of a string."""
    raw = spark.read.option("lineSep", "}").text(list(paths)).select(F.col("_metadata.file_path").alias("source_geojson"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), "value", (F.octet_length("value") + 1).cast("long").alias("bytes"), F.col("_metadata.file_size").alias("size"))
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"', -1)
    opened = lambda odd: F.aggregate(F.filter("parts", lambda _, k: k % 2 == odd), F.lit(0), lambda a, x: a + F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit(""))))
    cut = raw.withColumn("parts", parts).withColumns({"quotes": F.size("parts") - 1, "opens0": opened(0), "opens1": opened(1)}).drop("parts")
    # The state in which a piece begins if its split begins outside; for the other beginning it is the other state.
    cut = cut.withColumn("flips", F.coalesce(_within(F.col("quotes")), F.lit(0)) - F.col("quotes"))
    for side in (0, 1):
        inside = (F.col("flips") + side) % 2
        ends = (inside + F.col("quotes")) % 2
        cut = cut.withColumn(f"step{side}", F.when(inside == 0, F.col("opens0")).otherwise(F.col("opens1")) - F.when(ends == 0, 1).otherwise(0))
        cut = cut.withColumn(f"depth{side}", _within(F.col(f"step{side}")))
    return cut.select(*PLACE, "n", "value", "bytes", "size", "flips", "quotes", *[f"{c}{side}" for side in (0, 1) for c in ("step", "depth")])


def objects(cut: DataFrame) -> DataFrame:
    """Objects of depth two in order: ``source_geojson, block, n`` of the first piece, ``first`` of the file, ``whole``, its text with what stands before it."""
    splits = cut.groupBy(*PLACE).agg(F.sum("quotes").alias("quotes"), F.sum("step0").alias("step0"), F.sum("step1").alias("step1"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"))
    begun = splits.withColumn("inside", F.coalesce(_before("quotes"), F.lit(0)) % 2)
    begun = begun.withColumn("step", F.when(F.col("inside") == 0, F.col("step0")).otherwise(F.col("step1"))).withColumn("base", F.coalesce(_before("step"), F.lit(0)))
    # A last piece without a brace was counted with one.
    file = Window.partitionBy("source_geojson")
    left = F.sum("step").over(file) + F.when(F.sum("bytes").over(file) > F.max("size").over(file), 1).otherwise(0)
    begun = begun.withColumn("left", left).filter("left = 0").select(*PLACE, "inside", "base")
    side = lambda c: F.when(F.col("inside") == 0, F.col(f"{c}0")).otherwise(F.col(f"{c}1"))
    ends = (F.col("inside") + F.col("flips") + F.col("quotes")) % 2 == 0
    deep = cut.join(begun, PLACE).withColumn("closed", (ends & (F.col("base") + side("depth") == 1)).cast("long"))
    counted = deep.groupBy(*PLACE).agg(F.sum("closed").alias("sum")).select(*PLACE, F.coalesce(_before("sum"), F.lit(0)).alias("past"))
    numbered = deep.join(counted, PLACE).withColumn("object", F.col("past") + _within(F.col("closed")) - F.col("closed"))
    piece = F.struct("block", "n", "value")
    gathered = numbered.groupBy("source_geojson", "object").agg(F.array_sort(F.collect_list(piece)).alias("all"), F.max("closed").alias("done")).filter("done = 1")
    return gathered.select("source_geojson", F.col("all")[0]["block"].alias("block"), F.col("all")[0]["n"].alias("n"), (F.col("object") == 0).alias("first"), F.concat(F.array_join("all.value", "}"), F.lit("}")).alias("whole"))


def read_features(spark: SparkSession, *paths: str) -> DataFrame:
    """Features of collections: ``source_geojson, feature_ord, geometry_type, lon, lat, properties``.

    ``feature_ord`` counts the objects in ``features`` from 0; other elements have no row.  A
    feature that can't be read has nulls; files that aren't collections, or that are cut short,
    have no rows.  Two tables are written to the shared folder.
    """
    stage = Stage(spark)
    found = objects(stage(pieces(spark, *paths), "geojson-pieces"))
    lead = F.when(F.col("first"), F.regexp_extract("whole", "^" + OUTSIDE + r"\{" + OUTSIDE, 0)).otherwise(F.regexp_extract("whole", "^" + OUTSIDE, 0))
    found = found.withColumn("lead", lead)
    starts = F.col("lead").rlike(r'"features"\s*:\s*\[[^\]:]*$')
    goes_on = ~F.col("first") & ~F.regexp_replace("lead", r'"(?:[^"\\]++|\\.)*+"', "").rlike(r"[\]:]")
    mark = F.when(~goes_on, F.struct("block", "n", starts.alias("features")))
    listed = stage(found.select(*PLACE, "n", mark.alias("mark"), F.substr("whole", F.length("lead") + 1).alias("text")), "geojson-objects")
    marks = listed.groupBy(*PLACE).agg(F.max("mark").alias("last")).select(*PLACE, _before("last", F.max).alias("past"))
    known = listed.join(marks, PLACE).withColumn("member", F.coalesce(F.greatest("past", _within(F.col("mark"), F.max))["features"], F.lit(False)).cast("long"))
    sums = known.groupBy(*PLACE).agg(F.sum("member").alias("sum")).select(*PLACE, F.coalesce(_before("sum"), F.lit(0)).alias("earlier"))
    numbered = known.join(sums, PLACE).withColumn("feature_ord", (F.col("earlier") + _within(F.col("member")) - 1).cast("int")).filter("member = 1")
    rows = numbered.select("source_geojson", "feature_ord", F.from_json("text", FEATURE).alias("f"))
    at = lambda k: F.get_json_object("f.geometry.coordinates", f"$[{k}]").try_cast("double")
    return rows.select("source_geojson", "feature_ord", F.col("f.geometry.type").alias("geometry_type"), at(0).alias("lon"), at(1).alias("lat"), F.col("f.properties").alias("properties"))

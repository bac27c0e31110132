"""Private hosts are left out of lists without gathering the rows of all others in one task."""

from pyspark.sql import functions as F

from ocelli.operators import sinks

GOOD = ["https://a.example/x.m3u8", "https://8.8.8.8/y", "https://b.example:8080/z"]
BAD = ["http://10.0.0.1/a", "http://localhost/b", "http://cam.local/c", "http://[::1]/d", "http://127.0.0.1:81/e", "", None]


def test_rows_without_a_doubtful_name_stay_where_they_are(spark):
    rows = spark.createDataFrame([(k, u) for k, u in enumerate((GOOD + BAD) * 50)], "_ord long, stream_url string").repartition(4)
    # Sides of unknown size are joined by a shuffle: a null name would be one key of nearly all rows.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = sinks.eligible(rows, [])
        assert "Join" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, kept.collect())) == [(k, u) for k, u in enumerate((GOOD + BAD) * 50) if u in GOOD]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert kept.columns == rows.columns and kept.filter(F.col("stream_url").isNull()).isEmpty()

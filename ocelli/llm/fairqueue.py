"""Mixing sources to target weights by weighted fair queueing.

Every document of a source, in a shuffled order, is a packet whose virtual
finish time is the source's cumulative words divided by the source's target.
The whole corpus is range-sorted by finish time and cut where the total budget
is used up.  A source whose target exceeds its size goes round again (up to
``most`` times its size), so a document may be taken more than once; the
document at the cut is taken in part.

No step gathers a source in one task: cumulative sums come from a range
partitioning by (source, shuffle key), written once so that its bounds stay
fixed, with one total for each partition.

Edge cases: a null text has size 0; documents of size 0 take 0 words; null is a
source of its own and sorts last; rows that repeat an id are separate packets;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import freed, made, numbered, parts, written

WORD = r"[^\x20\x09-\x0D]+"


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` written in range partitions of ``order``, numbered by ``part``."""
    spread = df.repartitionByRange(parts(df.sparkSession), *order)
    return written(spread.withColumn("part", F.spark_partition_id()), name)


def running(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds the global running sum of ``value`` (inclusive) to a frame of ``ranged``."""
    totals = df.groupBy("part").agg(F.sum(value).alias("_t"))
    before = totals.select("part", F.coalesce(F.sum("_t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # One row for each partition: bounded by the number of partitions.
    inside = F.sum(value).over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_in", inside).join(F.broadcast(before), "part").withColumn(out, F.col("_in") + F.col("_before")).drop("_in", "_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: weights repeat in code-point order of the sources.

    Each target is ``min(most * size, level * weight)``; the common level makes
    them sum to ``share`` of all sizes.  That is what sharing the excess by
    weight again and again comes to.  It is found by one sort of the sources by
    the level at which each is full.
    """
    spark = sizes.sparkSession
    named = ranged(sizes.withColumn("absent", F.col("source").isNull().cast("int")).withColumn("one", F.lit(1).cast("long")), ["absent", "source"], "wfq-sources")
    ranked = running(named, ["absent", "source"], "one", "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    full = ranked.drop("part").select("absent", "source", "source_size", weight.cast("long").alias("weight"))
    full = full.withColumn("full_at", F.col("source_size") * float(most) / F.col("weight"))
    order = ["full_at", "absent", "source"]
    levels = running(running(ranged(full, order, "wfq-levels"), order, "source_size", "size_to"), order, "weight", "weight_to")
    total, weight_all = full.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * float(total or 0)
    # With every source up to this one full, the rest share what is left.
    level = (F.lit(budget) - most * (F.col("size_to") - F.col("source_size"))) / (F.lit(int(weight_all or 0)) - (F.col("weight_to") - F.col("weight")))
    found = levels.withColumn("level", level).filter(F.col("level") <= F.col("full_at")).orderBy(*order).select("level").first()
    cut = F.lit(found[0] if found else float("inf"))
    target = F.when(F.col("full_at") <= cut, F.col("source_size") * float(most)).otherwise(F.col("weight") * cut)
    return full.select("source", "source_size", target.cast("double").alias("target"))


def shuffle_key(id_col: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs``; with ``keep`` the columns of ``docs`` and ``taken`` for rows that are taken."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    whole, name = numbered(docs) if keep else (docs, None)
    began = made()
    rid = F.col(name) if keep else F.monotonically_increasing_id()
    slim = whole.select(rid.alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"))
    slim = slim.withColumn("absent", F.col("source").isNull().cast("int")).withColumn("shuffled", shuffle_key(F.col("doc_id")))
    order = ["absent", "source", "shuffled", "doc_id", "rid"]
    queue = ranged(slim, order, "wfq-queue")
    goal = written(targets(queue.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "wfq-targets")
    placed = running(queue, order, "size", "position")
    # A source begins where all sources before it end.
    goal = goal.withColumn("absent", F.col("source").isNull().cast("int"))
    starts = running(ranged(goal, ["absent", "source"], "wfq-starts"), ["absent", "source"], "source_size", "source_end")
    starts = starts.select(F.col("absent").alias("_a"), F.col("source").alias("_s"), "source_size", "target", (F.col("source_end") - F.col("source_size")).alias("begin"))
    packets = placed.join(starts, (F.col("absent") == F.col("_a")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_a", "_s")
    packets = packets.withColumn("sent", F.col("position") - F.col("begin")).select("rid", "doc_id", "shuffled", "size", "source_size", "target", "sent")
    packets = written(packets, "wfq-packets")
    budget = F.lit(share) * F.lit(float(goal.agg(F.sum("source_size")).first()[0] or 0))
    finish = lambda k: F.when(F.col("target") > 0, (F.col("sent") + k * F.col("source_size")) / F.col("target"))
    rounds = packets.filter("size > 0").select("shuffled", "doc_id", "rid", "size", F.explode(F.array(*[F.struct(F.lit(k).alias("round"), finish(k).alias("finish")) for k in range(most)])).alias("p"))
    rounds = rounds.select("p.finish", "shuffled", "doc_id", "rid", "p.round", "size")
    line = ["finish", "shuffled", "doc_id", "rid", "round"]
    sent = running(ranged(rounds, line, "wfq-line"), line, "size", "total").withColumn("room", budget - (F.col("total") - F.col("size")))
    # The first packet that doesn't fit in whole is taken in part; what comes later is not taken.
    cut = sent.filter(F.col("room") < F.col("size")).orderBy(*line).select(*line, F.floor("room").alias("part_taken")).first()
    freed(spark, began, packets)
    taken = F.lit(0).cast("long")
    for k in range(most):
        if cut is None:
            taken = taken + F.col("size")
            continue
        at = F.struct(finish(k).alias("a"), F.col("shuffled").alias("b"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("c"), F.col("rid").alias("d"), F.lit(k).alias("e"))
        last = F.struct(F.lit(cut[0]).alias("a"), F.lit(cut[1]).cast("long").alias("b"), F.lit(-(1 << 63) if cut[2] is None else cut[2]).cast("long").alias("c"), F.lit(cut[3]).cast("long").alias("d"), F.lit(cut[4]).alias("e"))
        taken = taken + F.when(F.col("size") == 0, 0).when(at < last, F.col("size")).when(at == last, F.lit(int(cut[5]))).otherwise(0)
    done = packets.withColumn("taken", taken.cast("long"))
    if keep:
        amount = "taken" if "taken" not in {c.lower() for c in docs.columns} else "taken_words"
        rows = done.filter("taken > 0").select(F.col("rid").alias(name), F.col("taken").alias(amount))
        return whole.join(rows, name).select(*[F.col(f"`{c}`") for c in docs.columns], amount)
    return done.select("doc_id", "size", "source_size", "target", "taken")


#: DuckDB SQL for ``mix`` over ``documents`` with the default parameters.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS shuffled
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
f AS (SELECT *, source_size * 2.0::DOUBLE / weight AS full_at, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(weight) OVER () AS weight_all FROM w),
l AS (
  SELECT *, (budget - 2 * (sum(source_size) OVER o - source_size)) / (weight_all - (sum(weight) OVER o - weight))::DOUBLE AS level
  FROM f WINDOW o AS (ORDER BY full_at, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
c AS (SELECT coalesce(min_by(level, full_at), 'inf'::DOUBLE) AS cut, any_value(budget) AS b FROM l WHERE level <= full_at),
t AS (SELECT source, source_size, (CASE WHEN full_at <= cut THEN source_size * 2.0 ELSE weight * cut END)::DOUBLE AS target FROM f, c),
p AS (
  SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY shuffled, doc_id ROWS UNBOUNDED PRECEDING) AS sent
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT p.*, k, (sent + k * source_size)::DOUBLE / target AS finish FROM p, (VALUES (0), (1)) v(k) WHERE size > 0),
q AS (
  SELECT *, greatest(0, least(size, floor((SELECT 1.5::DOUBLE * sum(size) FROM d) - (sum(size) OVER (ORDER BY finish, shuffled, doc_id, k ROWS UNBOUNDED PRECEDING) - size))))::BIGINT AS part
  FROM r),
g AS (SELECT doc_id, sum(part)::BIGINT AS taken FROM q GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(g.taken, 0)::BIGINT AS taken FROM p LEFT JOIN g ON p.doc_id = g.doc_id
"""

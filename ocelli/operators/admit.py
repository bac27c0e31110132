"""Caps and budgets as windows.

Caps over the whole input are ranks in global order.  They only need the first
rows of each class, so each class is first cut by a distributed top-k and the
window sees no more rows than the caps allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import Stage


def first_rows(df: DataFrame, limit: int, *order: str, unlimited_at_zero: bool = True) -> DataFrame:
    """The first rows in order; 0 may mean all."""
    return df if unlimited_at_zero and limit == 0 else df.orderBy(*order).limit(limit)


def per_key(df: DataFrame, keys: list[str], limit: int, *order: str | Column) -> DataFrame:
    """The first rows of each key (per page, per query, per target)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= limit).drop("_rank")


def class_capped(df: DataFrame, is_class: Column, class_cap: int, other_cap: int, total_cap: int, *order: str, taken: tuple[int, int] = (0, 0)) -> DataFrame:
    """Rows admitted one after the other under a cap for a class, one for all others, and one for all.

    ``taken``: rows of the class and of others that an earlier phase admitted.
    A row of a full class is passed over and uses up nothing, so admission is:
    the first of each class, then the first of those together.
    """
    left_class, left_other = max(0, class_cap - taken[0]), max(0, other_cap - taken[1])
    left_all = max(0, total_cap - sum(taken))
    own = df.filter(F.coalesce(is_class, F.lit(False))).orderBy(*order).limit(left_class)
    rest = df.filter(~F.coalesce(is_class, F.lit(False))).orderBy(*order).limit(left_other)
    return own.unionByName(rest).orderBy(*order).limit(left_all)


def class_capped_per(df: DataFrame, keys: list[str], is_class: Column, class_cap: int, other_cap: int, total_cap: int, *order: str) -> DataFrame:
    """``class_capped`` for each key at once: ranks are limited before the shuffle, so a key with most of the rows sends only its first ones."""
    marked = df.withColumn("_class", F.coalesce(is_class, F.lit(False)))
    inner = F.row_number().over(Window.partitionBy(*keys, "_class").orderBy(*order))
    fit = marked.withColumn("_n", inner).filter(F.col("_n") <= max(class_cap, other_cap)).filter(F.col("_n") <= F.when(F.col("_class"), class_cap).otherwise(other_cap))
    outer = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return fit.withColumn("_n", outer).filter(F.col("_n") <= total_cap).drop("_n", "_class")


def batches(df: DataFrame, size: int, *order: str, out: str = "batch") -> DataFrame:
    """Numbers rows by batches of ``size``, in order.

    The order is global; rows are ranked within range partitions and shifted by
    the sizes of those before, so no task holds all rows.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Stored, so that the sizes and the ranks are of the same partitions.
    spread = Stage(df.sparkSession)(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "batches")
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    # One row for each partition.
    ranked = spread.withColumn("_rank", rank).join(F.broadcast(before), "_part")
    return ranked.withColumn(out, F.floor((F.col("_rank") + F.col("_before") - 1) / size).cast("long")).drop("_part", "_rank", "_before")


def joint_budgets(df: DataFrame, total: int, by_provider: dict[str, int], per_host: int, failures: int = 2) -> DataFrame:
    """Rows admitted only while all budgets allow: total, provider, host, and not after ``failures`` failed pages of a host.

    A row uses up budget only if every budget lets it pass.  ``df`` has ``run_id,
    _ord, provider, host, failed`` (whether its capture failed); ``_ord`` differs
    within a run.  Adds ``admitted`` and ``skip_reason``, the first budget of these
    that is used up.

    The rows of one host and provider that are admitted are the first few of them:
    once one is turned away, so are all later ones.  So the first ``per_host`` of each
    are all that can be admitted, whatever else happens, and they are cut where the
    rows lie.  Among those, hosts don't depend on each other but through the budgets
    of providers and of the run, and these close once, in order.  Each round admits by
    host with the closings known so far, and finds the run's next closing: the place
    of the row that uses up a budget.  There are as many rounds as budgets that close,
    no more than providers with a budget, and one.  No task holds a run.
    """
    hold = Stage(df.sparkSession)
    family = F.substring_index(F.coalesce("provider", F.lit("")), ":", 1)
    named = {k: v for k, v in by_provider.items() if v < total}
    budget = F.coalesce(F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[family], F.lit(total)) if named else F.lit(total)
    lean = df.select("run_id", "_ord", "host", F.coalesce("failed", F.lit(False)).cast("int").alias("failed"), family.alias("family"), budget.alias("budget"))
    own = Window.partitionBy("run_id", "host", "family").orderBy("_ord")
    # The most rows that any budget leaves; ranks under a constant are cut before the shuffle.
    most = max(0, min(per_host, total))
    able = lean.filter(F.col("budget") > 0).withColumn("n", F.row_number().over(own)).filter(F.col("n") <= most).drop("n")
    able = hold(able, "budget-rows")
    shut = df.sparkSession.createDataFrame([], _closing(able))
    while True:
        admitted = hold(_by_host(able, shut, per_host, failures), "budget-admitted")
        found = hold(_next_closing(admitted, shut, total, max(named.values(), default=0)), "budget-shut")
        if found.isEmpty():
            break
        shut = hold(shut.union(found), "budget-shut")
    last = lambda keys, n, which=F.lit(True): admitted.filter(which).withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("_ord"))).filter(F.col("n") <= n).filter(F.col("n") == n)
    ends = [
        (["run_id"], total, shut.filter("family IS NULL").select("run_id", F.col("at").alias("_t"))),
        (["run_id", "family"], None, shut.filter("family IS NOT NULL").select("run_id", "family", F.col("at").alias("_f"))),
        (["run_id", "host"], per_host, last(["run_id", "host"], per_host).select("run_id", "host", F.col("_ord").alias("_h"))),
        (["run_id", "host"], failures, last(["run_id", "host"], failures, F.col("failed") == 1).select("run_id", "host", F.col("_ord").alias("_b"))),
    ]
    out = df.withColumns({"_family": family, "_budget": budget})
    for keys, _, end in ends:
        other = end.toDF(*[f"_k{i}" for i in range(len(keys))], end.columns[-1])
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col("_family" if k == "family" else k).eqNullSafe(F.col(f"_k{i}"))
        out = out.join(other, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    after = lambda c, n: F.lit(n <= 0) | F.coalesce(F.col("_ord") > F.col(c), F.lit(False))
    reason = (
        F.when(after("_t", total), "global_browser_budget_exhausted")
        .when((F.col("_budget") <= 0) | after("_f", 1), F.concat("_family", F.lit("_browser_budget_exhausted")))
        .when(after("_h", per_host), "host_browser_budget_exhausted")
        .when(after("_b", failures), "host_browser_cooldown")
    )
    out = out.withColumn("skip_reason", reason)
    return out.select(*df.columns, F.col("skip_reason").isNull().alias("admitted"), "skip_reason")


def _closing(able: DataFrame) -> str:
    kind = {f.name: f.dataType.simpleString() for f in able.schema.fields}
    return f"run_id {kind['run_id']}, family string, at {kind['_ord']}"


def _by_host(able: DataFrame, shut: DataFrame, per_host: int, failures: int) -> DataFrame:
    """Rows that their host admits, of those before the closings of their provider and run (``family`` null)."""
    one = shut.filter("family IS NOT NULL").select(F.col("run_id").alias("_r"), F.col("family").alias("_f"), F.col("at").alias("_a"))
    all_ = shut.filter("family IS NULL").select(F.col("run_id").alias("_q"), F.col("at").alias("_t"))
    open_ = able.join(one, F.col("run_id").eqNullSafe(F.col("_r")) & (F.col("family") == F.col("_f")), "left").join(all_, F.col("run_id").eqNullSafe(F.col("_q")), "left")
    open_ = open_.filter(F.coalesce(F.col("_ord") <= F.col("_a"), F.lit(True)) & F.coalesce(F.col("_ord") <= F.col("_t"), F.lit(True)))
    w = Window.partitionBy("run_id", "host").orderBy("_ord")
    ranked = open_.select(*able.columns, F.row_number().over(w).alias("n")).filter(F.col("n") <= per_host)
    bad = F.coalesce(F.sum("failed").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("bad", bad).filter(F.col("bad") < failures).drop("n", "bad")


def _next_closing(admitted: DataFrame, shut: DataFrame, total: int, largest: int) -> DataFrame:
    """Each run's first closing that isn't known yet: ``run_id, family, at``; none once the run is closed."""
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("_ord"))
    ends = admitted.withColumn("n", rank("run_id")).filter(F.col("n") <= total).filter(F.col("n") == total).select("run_id", F.lit(None).cast("string").alias("family"), F.col("_ord").alias("at"))
    if largest:
        own = admitted.filter(F.col("budget") < total).withColumn("n", rank("run_id", "family")).filter(F.col("n") <= largest).filter(F.col("n") == F.col("budget"))
        ends = ends.union(own.select("run_id", "family", F.col("_ord").alias("at")))
    known = shut.select(F.col("run_id").alias("_r"), F.col("family").alias("_f"))
    over = shut.filter("family IS NULL").select(F.col("run_id").alias("_q"))
    new = ends.join(known, F.col("run_id").eqNullSafe(F.col("_r")) & F.col("family").eqNullSafe(F.col("_f")), "left_anti").join(over, F.col("run_id").eqNullSafe(F.col("_q")), "left_anti")
    first = new.groupBy("run_id").agg(F.min("at").alias("_at")).withColumnRenamed("run_id", "_r")
    return new.join(first, F.col("run_id").eqNullSafe(F.col("_r")) & (F.col("at") == F.col("_at"))).select("run_id", "family", "at")

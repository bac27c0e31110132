r"""Source divergence audit: how far each source's words stand from the other sources of its language.

A group is a (lang, source) pair.  Its term probabilities are smoothed over the
terms that its language keeps and held as whole billionths, so all arithmetic is
exact.  Two reports come of them:

* ``pair``: the divergence of each group from each other source of its language,
  over all kept terms.  Terms that neither side uses all have the same value;
  terms of one side alone depend on how often they occur there, so a histogram of
  counts stands for them; only terms of both sides meet, by one join on the term,
  and add what they differ from these two baselines.
* ``term``: the ``k`` terms of each group that most exceed their language's share,
  by radix selection.  Histograms over 12 bits of the value at a time, summed
  where the rows lie, narrow each group to its k-th value; terms that tie at this
  value are narrowed in the same way by four UTF-8 bytes at a time.  No group is
  sorted but its ``k`` winners.

Words are counted where they are read; a source with a third of all rows sends
one row for each of its terms and tasks.  A group's rounds only pass histograms.

Edge cases: null text, lang and source count as ''; every row is a document, also
one that repeats another's id; a group without kept terms has pairs and no terms;
a language without kept terms has pairs of value 0; one with a single source has
none; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import freed, made, written

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of a value that one round of the selection looks at, and bits of the largest value (10**18).
DIGIT, BITS = 12, 60
#: UTF-8 bytes of a term that one round looks at.
CHUNK = 4


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, term, n, n_docs``: occurrences of each term in each group and its documents there."""
    words = F.regexp_extract_all(lowered(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TERM), F.lit(0))
    read = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), words.alias("words"))
    twice = F.array(F.struct(F.col("words"), F.lit(1).alias("n"), F.lit(0).alias("d")), F.struct(F.array_distinct("words").alias("words"), F.lit(0).alias("n"), F.lit(1).alias("d")))
    each = read.select("lang", "source", F.explode(twice).alias("x")).select("lang", "source", F.explode("x.words").alias("term"), "x.n", "x.d")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("n_docs"))


def share(count: Column, size: Column, kept: Column) -> Column:
    """``1 + floor(10**9 * (count + 1) / (size + kept))`` in decimals, so that no count is too large."""
    wide = "decimal(20,0)"
    return F.lit(1).cast("long") + F.call_function("div", F.lit(1_000_000_000).cast("decimal(10,0)") * (count + 1).cast(wide), (size + kept).cast(wide))


def excess(p: Column, q: Column) -> Column:
    """``floor((p - q)**2 / q)``."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = 3, k: int = 200, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``lang, source, part, item, value, rank`` of both reports."""
    spark, began = docs.sparkSession, made()
    counts = written(term_counts(docs, text_col, lang_col, source_col), "div-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("d")).filter(F.col("d") >= least_docs).drop("d")
    kept = written(kept, "div-kept")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_size"))
    known = counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n")
    sizes = known.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("used"))
    # Every occurring group, also one without terms.
    groups = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct()
    groups = groups.join(langs, "lang", "left").join(sizes, ["lang", "source"], "left").na.fill(0, ["kept", "lang_size", "size", "used"])
    groups = groups.withColumn("rare", F.when(F.col("kept") > 0, share(F.lit(0), F.col("size"), F.col("kept"))))
    groups = written(groups, "div-groups")
    rated = known.join(groups, ["lang", "source"])
    rated = rated.select("lang", "source", "term", share(F.col("n"), F.col("size"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_size"), F.col("kept")).alias("q"), "rare")
    rated = written(rated, "div-rated")
    pairs = written(pair_report(rated, groups), "div-pairs")
    over = written(rated.filter("p > q").select("lang", "source", F.col("term").alias("item"), excess(F.col("p"), F.col("q")).alias("value")), "div-terms")
    top = written(select_top(over, ["lang", "source"], k), "div-top")
    freed(spark, began, pairs, top)
    out = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").union(top.select("lang", "source", F.lit("term").alias("part"), "item", "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return out.withColumn("rank", F.row_number().over(order))


def pair_report(rated: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for each ordered pair of groups of a language."""
    a = groups.select("lang", "source", "kept", F.col("rare").alias("p0"), F.col("used").alias("used_a"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("rare").alias("q0"), F.col("used").alias("used_b"))
    pair = a.join(b, "lang").filter("source <> item")
    # Terms of one side alone: as many times as a probability occurs there.
    tally = rated.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    ours = tally.join(b, "lang").filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("times") * excess(F.col("p"), F.col("q0"))).alias("ours"))
    theirs = tally.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "times").join(a, "lang").filter("source <> item")
    theirs = theirs.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * excess(F.col("p0"), F.col("q"))).alias("theirs"))
    # Terms of both sides: what they add to these.
    left = rated.select("lang", "term", "source", "p", F.col("rare").alias("p0"))
    right = rated.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("rare").alias("q0"))
    p, q, p0, q0 = (F.col(c) for c in ("p", "q", "p0", "q0"))
    more = excess(p, q) - excess(p, q0) - excess(p0, q) + excess(p0, q0)
    both = left.join(right, ["lang", "term"]).filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(more).alias("both"))
    key = ["lang", "source", "item"]
    whole = pair.join(ours, key, "left").join(theirs, key, "left").join(both, key, "left").na.fill(0, ["ours", "theirs", "both"])
    neither = (F.col("kept") - F.col("used_a") - F.col("used_b")) * excess(p0, q0)
    value = F.when(F.col("kept") > 0, F.col("ours") + F.col("theirs") + F.col("both") + neither).otherwise(0)
    return whole.select(*key, value.cast("long").alias("value"))


def select_top(rows: DataFrame, group: list[str], k: int) -> DataFrame:
    """The ``k`` rows of each group of largest ``value``, ties by ``item`` in UTF-8 order; items of a group differ.

    ``rows`` is a written table with ``group``, ``item`` and ``value`` (0 to 2**60).
    """
    state = rows.groupBy(*group).agg(F.count("*").alias("c")).select(*group, F.lit(0).cast("long").alias("head"), F.least(F.lit(k).cast("long"), "c").alias("need"), F.col("c").alias("left"))
    state = written(state, "radix-bits")
    for shift in range(BITS - DIGIT, -1, -DIGIT):
        inside = rows.join(state, group).filter(F.shiftright("value", shift + DIGIT) == F.col("head"))
        digits = inside.groupBy(*group, "need", F.shiftright("value", shift).alias("head")).agg(F.count("*").alias("left"))
        state = written(_reached(digits, group, F.desc("head")), "radix-bits")
    limit = state.select(*group, F.col("head").alias("limit"), "need", "left")
    ties = written(rows.join(limit, group).filter("value = limit").select(*group, F.col("item").cast("binary").alias("bytes")), "radix-ties")
    # Where more terms tie than there is room for, their bytes decide.
    state = written(limit.filter("left > need").select(*group, "need", F.lit(b"").alias("head")), "radix-bytes")
    ends = limit.filter("left = need").select(*group, F.lit(None).cast("binary").alias("last"), F.lit(0).alias("width"))
    while not state.isEmpty():
        inside = ties.join(state, group).filter(F.substring("bytes", F.lit(1), F.octet_length("head")) == F.col("head"))
        # What all that are left begin with needs no round of its own.
        span = inside.groupBy(*group, "need").agg(F.min("bytes").alias("lo"), F.max("bytes").alias("hi"))
        longer = F.filter(F.sequence(F.lit(1), F.octet_length("lo") + 1), lambda i: F.substring("lo", i, F.lit(1)) != F.substring("hi", i, F.lit(1)))
        width = F.coalesce(F.get(longer, F.lit(0)), F.octet_length("lo")) - 1 + CHUNK
        heads = ties.join(span.select(*group, "need", width.alias("width"), F.substring("lo", F.lit(1), width - CHUNK).alias("common")), group)
        heads = heads.filter(F.substring("bytes", F.lit(1), F.octet_length("common")) == F.col("common"))
        heads = heads.groupBy(*group, "need", "width", F.substring("bytes", F.lit(1), F.col("width")).alias("head")).agg(F.count("*").alias("left"))
        now = written(_reached(heads, group, F.asc("head"), "width"), "radix-bytes")
        ends = ends.union(now.filter("left = need").select(*group, F.col("head").alias("last"), "width"))
        state = now.filter("left > need").select(*group, "need", "head")
    taken = rows.join(limit.select(*group, "limit"), group).join(ends, group)
    item = F.col("item").cast("binary")
    tied = (F.col("value") == F.col("limit")) & (F.col("last").isNull() | (F.substring(item, F.lit(1), F.col("width")) <= F.col("last")))
    return taken.filter((F.col("value") > F.col("limit")) | tied).select(*group, "item", "value")


def _reached(counted: DataFrame, group: list[str], order: Column, *more: str) -> DataFrame:
    """Of each group's histogram (``head, left`` and the group's ``need``) the bin in which the need is met, and what it has to give."""
    line = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = counted.withColumn("upto", F.sum("left").over(line))
    met = summed.filter((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("left") < F.col("need")))
    return met.select(*group, "head", *more, (F.col("need") - (F.col("upto") - F.col("left"))).alias("need"), "left")


#: DuckDB SQL for ``audit`` over ``documents`` with the default parameters.
SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
w AS (SELECT lang, source, r, unnest(words) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY ALL),
g AS (
  SELECT d.lang, d.source, coalesce(l.v, 0) AS v, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d
  LEFT JOIN l ON d.lang = l.lang LEFT JOIN s ON d.lang = s.lang AND d.source = s.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n + g.v))::HUGEINT AS p,
         (1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n + l.v))::HUGEINT AS q
  FROM g JOIN k ON g.lang = k.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM o QUALIFY part = 'pair' OR rank <= 200
"""

"""Document fingerprints by order MinHash, in built-in functions alone.

A text's k-mers are runs of ``width`` words (fewer at its end), each numbered by
how often it stood before.  The hash of a numbered k-mer gives its rank; its top
bits deal it to one of ``1 << BINS`` bins.  Of each bin the ``PICK`` k-mers of
smallest rank are selected, put back in the order of the text, and hashed as one
tuple.  A fingerprint has one number for each bin that isn't empty, so two texts
agree in a bin if they select the same k-mers there in the same order.  Moved
passages change tuples that a plain MinHash would keep.

All of a row is done by array functions on that row: numbers that pack a k-mer's
hash and place are sorted as plain longs, and one pass finds what each bin
selects.  No k-mer leaves its row.

Edge cases: a null text is empty; a text without words has an empty fingerprint,
which is like only another empty one; fewer k-mers than bins leave bins empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import freed, made, parts, written

#: Bits of the number of bins, and how many k-mers a bin selects.
BINS, PICK = 6, 2
#: Words of a k-mer.
WIDTH = 2
#: Bits of a bin's number in a fingerprint.
VALUE = 16
WORD = r"[^\x20\x09-\x0D]+"


def _at(name: str, i: Column) -> Column:
    return F.get(F.col(name), i)


def fingerprint(df: DataFrame, text_col: str, out: str, width: int = WIDTH) -> DataFrame:
    """Adds the array ``out`` of numbers ``bin << 16 | value``, in order of the bins.

    Each step is a projection of its own, so that no step is worked out twice.
    """
    rest = [F.col(f"`{c}`") for c in df.columns]

    def step(frame: DataFrame, **new: Column) -> DataFrame:
        return frame.select(*rest, *[c.alias(n) for n, c in new.items()])

    words = F.coalesce(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))
    s = step(df, om_w=words)
    mer = F.transform("om_w", lambda w, i: F.xxhash64(w, *[_at("om_w", i + k) for k in range(1, width)]))
    s = step(s, om_h=mer)
    # As many bits as a place takes.
    s = step(s, om_h=F.col("om_h"), om_b=F.length(F.bin(F.size("om_h").cast("long"))))
    place = lambda x: x.bitwiseAND(F.expr("shiftleft(1L, om_b) - 1")).cast("int")
    packed = F.transform("om_h", lambda h, i: F.call_function("shiftleft", F.call_function("shiftrightunsigned", h, F.col("om_b") + 1), F.col("om_b")).bitwiseOR(i.cast("long")))
    s = step(s, om_h=F.col("om_h"), om_b=F.col("om_b"), om_s=F.sort_array(packed))
    kind = lambda x: F.call_function("shiftright", x, F.col("om_b"))
    # Where runs of equal k-mers begin; within a run, places ascend.
    first = F.filter("om_s", lambda x, i: (i == 0) | (kind(x) != kind(F.coalesce(_at("om_s", i - 1), F.lit(0).cast("long")))))
    s = step(s, om_h=F.col("om_h"), om_b=F.col("om_b"), om_s=F.col("om_s"), om_f=first)
    starts = F.when(F.size("om_f") < F.size("om_s"), F.filter(F.sequence(F.lit(0), F.greatest(F.size("om_s") - 1, F.lit(0))), lambda i: (i == 0) | (kind(_at("om_s", i)) != kind(_at("om_s", i - 1)))))
    s = step(s, om_h=F.col("om_h"), om_b=F.col("om_b"), om_s=F.col("om_s"), om_f=starts)

    def ranked(x: Column, before: Column) -> Column:
        g = F.xxhash64(_at("om_h", place(x)), before)
        high = F.call_function("shiftleft", F.call_function("shiftrightunsigned", g, F.col("om_b") + 1), F.col("om_b"))
        return high.bitwiseOR(place(x).cast("long"))

    alone = F.transform("om_s", lambda x: ranked(x, F.lit(0)))
    run = lambda b, r: F.transform(F.slice("om_s", b + 1, F.coalesce(_at("om_f", r + 1), F.size("om_s")) - b), lambda x, j: ranked(x, j))
    numbered = F.when(F.col("om_f").isNull(), alone).otherwise(F.flatten(F.transform("om_f", run)))
    none = F.array().cast("array<bigint>")
    s = step(s, om_h=F.col("om_h"), om_b=F.col("om_b"), om_g=F.sort_array(F.coalesce(numbered, none)))
    bin_of = lambda x: F.call_function("shiftrightunsigned", x, F.lit(63 - BINS))
    chosen = F.filter("om_g", lambda x, i: (i < PICK) | (bin_of(x) != bin_of(F.coalesce(_at("om_g", i - PICK), x))))
    s = step(s, om_h=F.col("om_h"), om_b=F.col("om_b"), om_g=chosen)

    def tuple_of(x: Column, i: Column) -> Column:
        bin_ = bin_of(x)
        mates = F.filter(F.array(*[_at("om_g", i + k) for k in range(PICK)]), lambda y: y.isNotNull() & (bin_of(y) == bin_))
        kmers = F.transform(F.array_sort(F.transform(mates, place)), lambda p: _at("om_h", p))
        low = F.xxhash64(kmers).bitwiseAND(F.lit((1 << VALUE) - 1))
        leads = (i == 0) | (bin_of(_at("om_g", i - 1)) != bin_)
        return F.when(leads, F.call_function("shiftleft", bin_, F.lit(VALUE)).bitwiseOR(low).cast("int"))

    return step(s, **{out: F.filter(F.transform("om_g", tuple_of), lambda v: v.isNotNull())})


def likeness(a: Column, b: Column) -> Column:
    """The share of bins that agree, of those that aren't empty in both; 1 for two empty fingerprints."""
    bins = lambda x: F.transform(x, lambda v: F.shiftright(v, VALUE))
    of = F.size(F.array_union(bins(a), bins(b)))
    return F.when(of == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / of)


def text_form(a: Column) -> Column:
    """A fingerprint as hexadecimal digits, six for each number."""
    return F.array_join(F.transform(a, lambda v: F.lower(F.lpad(F.hex(v), 6, "0"))), "")


def followers(keys: DataFrame) -> DataFrame:
    """For each distinct row of ``keys (id, absent, h, n)``, in descending order of ``id``: the row before it, and that row's ``n``.

    Null ids come last, equal ids by ``h``; the first row follows the last.  Rows
    are dealt by range; only each partition's ends cross to the next.
    """
    spark = keys.sparkSession
    order = [F.col("absent").asc(), F.col("id").desc(), F.col("h").asc()]
    dealt = written(keys.distinct().repartitionByRange(parts(spark), *order).withColumn("part", F.spark_partition_id()), "om-order")
    inside = Window.partitionBy("part").orderBy(*order)
    row = F.struct("id", "absent", "h", "n")
    # One row for each partition; the first partition takes the last one's end.
    ends = dealt.groupBy("part").agg(F.max_by(row, F.struct("absent", -F.col("id"), "h")).alias("end"))
    line = Window.orderBy("part")
    ends = ends.select("part", F.coalesce(F.lag("end").over(line), F.last("end").over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    before = dealt.withColumn("prev", F.lag(row).over(inside)).join(F.broadcast(ends), "part").withColumn("prev", F.coalesce("prev", "end"))
    return before.select("id", "absent", "h", F.col("prev.id").alias("to_id"), F.col("prev.absent").alias("to_absent"), F.col("prev.h").alias("to_h"), F.col("prev.n").alias("to_n"))


def compare(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of each row.

    A row's edited text has its last third (rounded down) replaced by the beginning
    of the next document's text.  Rows are in descending order of their id, nulls
    last, equal ids by a hash of the text; rows of equal id and text count as one
    document, so all of them have the same next one.  A lone document is its own
    next one.

    Texts cross the network once, keyed by document; each sends its first part and
    its fingerprint to the document before it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = [F.coalesce(F.col(id_col).cast("long"), F.lit(0).cast("long")).alias("id"), F.col(id_col).isNull().cast("int").alias("absent"), F.xxhash64(text).alias("h")]
    began = made()
    links = written(followers(docs.select(*key, F.length(text).cast("long").alias("n"))), "om-links")
    freed(docs.sparkSession, began, links)
    keyed = fingerprint(docs.select(*key, text.alias("text")), "text", "fp")
    sent = keyed.join(links, ["id", "absent", "h"]).select(
        F.col("to_id").alias("id"),
        F.col("to_absent").alias("absent"),
        F.col("to_h").alias("h"),
        F.substring("text", F.lit(1), F.floor(F.col("to_n") / 3).cast("int")).alias("lead"),
        F.col("fp").alias("next_fp"),
    )
    # Rows that repeat an id and its text send the same.
    sent = sent.dropDuplicates(["id", "absent", "h"])
    n = F.length("text")
    met = keyed.join(sent, ["id", "absent", "h"]).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), "lead"))
    met = met.select("id", "absent", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "edited", "fp", "next_fp")
    both = fingerprint(met, "edited", "edited_fp")
    return both.select(
        F.when(F.col("absent") == 0, F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        text_form(F.col("fp")).alias("fingerprint"),
        text_form(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )

"""Document quality by hierarchical empirical Bayes.

A linear model gives each document a probability of being good.  Its evidence is
summed by host and by path (here: ``source``, and ``source`` with ``lang``) in
grouped aggregations.  Priors are estimated from the groups themselves: the
global mean, and by moments how many documents the prior is worth.  A host's
mean is shrunk towards the global mean, a path's towards its host's posterior,
so sparse sites hardly move.  A document's own evidence is taken out of its host
and path before it meets them, so it counts once.  Its log odds then shift by a
share of the difference between its path and the global mean; that share is
estimated on the labelled sample, out of fold, with a ridge towards ``TRUST``, and
so is the threshold, on shifted odds: where hardly any good labelled row would go.

Hosts and paths are never gathered: their posteriors are joined back to the
documents' scores, by broadcast only while there are at most ``FEW`` of them.

Edge cases: a null text has the model's constant; null hosts or paths are groups
of their own; without labels of both classes the model is its base rate and all
rows are kept or none; rows with repeated ids are separate; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import SAMPLE, Model, featured, logit, out_of_fold, sample, sigmoid
from .shared import numbered, only, written
from .textops import blocks, buffers
from .toxicity import apply_chain, state

#: What the share of the site's evidence is drawn to, and by how many labelled rows' worth.
TRUST, RIDGE = 0.5, 20.0
FEW = 20_000
#: Limits of what a prior is worth, in documents.
WORTH = (5.0, 5000.0)


def _scorer(broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.__new__(Model)
        model.__dict__.update(broadcast.value)
        for batch in batches:
            raw, offs = buffers(batch.column(4))
            for i, j in blocks(offs):
                (p,) = apply_chain([model], *featured(raw, offs[i : j + 1]))
                yield pa.RecordBatch.from_arrays([*[batch.column(k)[i:j] for k in range(4)], pa.array(p)], ["rid", "doc_id", "host", "path", "p"])

    return run


def _worth(groups: DataFrame, mean: Column) -> float:
    """Documents that a prior of the groups' spread is worth, by moments: p(1-p) / variance between groups - 1."""
    row = groups.filter("n > 1").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("m") - mean, 2)).alias("between"),
        F.sum(F.col("n") * F.col("m") * (1 - F.col("m"))).alias("inside"),
        F.count("*").alias("k"),
    ).first()
    if not row["n"] or row["k"] < 2:
        return WORTH[1]
    within = row["inside"] / row["n"]
    # What the means differ by beyond the noise of their own documents.
    spread = row["between"] / row["n"] - within * row["k"] / row["n"]
    return float(min(max(within / spread - 1 if spread > 1e-9 else WORTH[1], WORTH[0]), WORTH[1]))


def scores(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", row_col: str | None = None) -> DataFrame:
    """``rid, doc_id, p_document, n_host, p_host, n_path, p_path, p_good, keep`` for each row of ``docs``; ``row_col``: the row number of a table that ``numbered`` wrote."""
    spark = docs.sparkSession
    rows = sample(docs, labels, ["quality"], limit, id_col, text_col)
    y = rows.labels["quality"]
    none = np.zeros((len(y), 0))
    model = Model(rows, y, np.ones(len(y), bool), none)
    folded = out_of_fold(rows, y, none)
    shared = spark.sparkContext.broadcast(state(model))
    own = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    scored = written(own.mapInArrow(_scorer(shared), "rid long, doc_id long, host string, path string, p double"), "quality-scores")
    paths = written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "quality-paths")
    total, mass, many = paths.agg(F.sum("n"), F.sum("s"), F.count("*")).first()
    base = F.lit(float(mass / total) if total else 0.5)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    k_host = _worth(hosts.withColumn("m", F.col("s") / F.col("n")), base)
    hosts = hosts.select(F.col("host").alias("_h"), F.col("n").alias("n_host"), F.col("s").alias("s_host"))
    # A host has one row on the right; paths of one host may be many.
    nested = paths.join(hosts, F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    host_mean = (F.col("s_host") + k_host * base) / (F.col("n_host") + k_host)
    k_path = _worth(nested.withColumn("m", F.col("s") / F.col("n")), host_mean)
    nested = nested.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "n_host", "s_host", F.col("n").alias("n_path"), F.col("s").alias("s_path"))
    nested = F.broadcast(nested) if many <= FEW else nested
    odds = lambda c: F.log(F.greatest(F.least(c, F.lit(1 - 1e-9)), F.lit(1e-9)) / (1 - F.greatest(F.least(c, F.lit(1 - 1e-9)), F.lit(1e-9))))
    joined = scored.join(nested, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    # Without the document itself.
    p_host = (F.col("s_host") - F.col("p") + k_host * base) / (F.col("n_host") - 1 + k_host)
    joined = joined.withColumn("p_host", p_host)
    joined = joined.withColumn("p_path", (F.col("s_path") - F.col("p") + k_path * F.col("p_host")) / (F.col("n_path") - 1 + k_path))
    joined = joined.withColumn("_shift", odds(F.col("p_path")) - odds(base))
    share, threshold = _fitted(joined, rows.key, folded, y)
    post = 1 / (1 + F.exp(-(odds(F.col("p")) + share * F.col("_shift"))))
    return joined.select("rid", "doc_id", F.col("p").alias("p_document"), "n_host", "p_host", "n_path", "p_path", post.alias("p_good"), (post >= threshold).alias("keep"))


def _fitted(joined: DataFrame, key: np.ndarray, folded: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The share of the site's evidence, and the threshold, from the sampled rows' out-of-fold odds and their sites (one row for each id)."""
    if not len(key):
        return TRUST, 0.5
    asked = joined.sparkSession.createDataFrame([(int(k),) for k in key], "_id long")
    got = joined.join(F.broadcast(asked), F.col("doc_id") == F.col("_id")).groupBy("_id").agg(F.min("_shift").alias("z")).toPandas()
    z = np.zeros(len(key))
    z[np.searchsorted(key, got["_id"].to_numpy())] = got["z"].to_numpy()
    x, share = logit(folded), TRUST
    for _ in range(30):
        p = sigmoid(x + share * z)
        move = (((p - y) * z).sum() + RIDGE * (share - TRUST)) / ((p * (1 - p) * z * z).sum() + RIDGE)
        share = float(np.clip(share - move, 0, 1))
    good = np.sort(sigmoid(x + share * z)[y > 0])
    return share, float(min(0.5, max(0.05, good[int(0.002 * len(good))]))) if len(good) else 0.5


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, its evidence and posteriors (9 digits), and whether it is kept."""
    out = scores(docs, labels)
    return out.select("doc_id", *[F.round(c, 9).alias(c) for c in ("p_document", "p_host", "p_path", "p_good")], "n_host", "n_path", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that the classifier rejects."""
    whole, name = numbered(docs)
    return only(whole, name, scores(whole, labels, row_col=name, **options).filter("keep").select("rid"))

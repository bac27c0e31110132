"""Toxicity categories by a chain of linear classifiers.

Categories are predicted one after another; the model of each reads the texts'
features and the log odds of all earlier categories.  In training those log odds
come from out-of-fold predictions, so later models see earlier ones as they
behave on unknown texts.  A category's threshold is the one of best F1 among its
out-of-fold predictions, kept within 0.3 and 0.7.

The categories of the query are those that the labels table knows: ``low_quality``
(which tells insults from mere noise) and then ``toxic``.  ``fit_chain`` takes any
number of them.

Edge cases: a null or empty text gets the model's constant; rows with null
labels don't train; without two classes a category has its base rate; ids may be
null or repeat, and columns of other names are not read.  Labels that repeat an id
count as the larger one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import SAMPLE, Model, Rows, featured, logit, out_of_fold, sample
from .textops import blocks, buffers


@dataclass
class Chain:
    names: list[str]
    models: list[Model]
    thresholds: list[float]
    folded: list[np.ndarray]


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    grid = np.arange(0.3, 0.701, 0.02)
    score = [2 * (y * (p >= t)).sum() / max(1.0, y.sum() + (p >= t).sum()) for t in grid]
    # The middle of the best ones.
    top = np.flatnonzero(np.array(score) >= max(score) - 1e-12)
    return float(grid[top[len(top) // 2]])


def fit_chain(rows: Rows, categories: list[tuple[str, object]]) -> Chain:
    """``categories``: a name and its 0/1 labels, or a function of the chain so far that gives them."""
    chain = Chain([], [], [], [])
    for name, labels in categories:
        y = np.asarray(labels(chain) if callable(labels) else labels, np.float64)
        extra = np.stack([logit(p) for p in chain.folded], 1) if chain.folded else np.zeros((len(y), 0))
        p = out_of_fold(rows, y, extra)
        model = Model(rows, y, np.ones(len(y), bool), extra)
        chain.names.append(name)
        chain.models.append(model)
        chain.folded.append(p)
        chain.thresholds.append(best_threshold(p, y))
    return chain


def apply_chain(models: list[Model], h: np.ndarray, of: np.ndarray, dense: np.ndarray) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for model in models:
        extra = np.stack([logit(p) for p in out], 1) if out else np.zeros((len(dense), 0))
        out.append(model.apply(h, of, dense, extra))
    return out


def _scorer(broadcast, fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = []
        for state in broadcast.value:
            m = Model.__new__(Model)
            m.__dict__.update(state)
            models.append(m)
        for batch in batches:
            raw, offs = buffers(batch.column(1))
            for i, j in blocks(offs):
                scores = apply_chain(models, *featured(raw, offs[i : j + 1]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *map(pa.array, scores)], fields)

    return run


def state(model: Model) -> dict:
    """What a model needs to be applied."""
    return {k: v for k, v in model.__dict__.items() if k != "fitted"}


def score(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, a probability ``p_<category>`` and a flag for each category, for each row of ``docs``."""
    rows = sample(docs, labels, ["quality", "toxic"], limit, id_col, text_col)
    chain = fit_chain(rows, [("low_quality", 1 - rows.labels["quality"]), ("toxic", rows.labels["toxic"])])
    shared = docs.sparkSession.sparkContext.broadcast([state(m) for m in chain.models])
    fields = ["doc_id", *[f"p_{n}" for n in chain.names]]
    schema = "doc_id long, " + ", ".join(f"{c} double" for c in fields[1:])
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = own.mapInArrow(_scorer(shared, fields), schema)
    flags = [(F.col(f"p_{n}") >= t).alias(n) for n, t in zip(chain.names, chain.thresholds)]
    return out.select("doc_id", *[F.round(c, 9).alias(c) for c in fields[1:]], *flags)

"""Connected components of an edge table, in rounds of contraction.

In each round every node moves to the first of itself and its neighbours in an
order that the round draws anew (node ids after an exclusive or with a number),
then on along two more such moves; edges follow their ends.  A node comes before a
given neighbour in half of all orders, so half of the nodes are expected to go in
each round whatever the ids are, and rounds grow with the logarithm of the number
of nodes.  Only grouped minima and joins whose large keys Spark can split are used,
so a node with a third of all edges does not make a slow task.  Rounds are written
to the shared folder; the moves of all rounds are composed from the last, smallest
one backwards.  What is left once there are at most ``FEW`` edges is contracted at
once, in one task of a megabyte: rounds over so little cost the driver a dozen jobs
each and end no sooner.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import freed, made, written

#: Edges that one task contracts, at most, whatever the size of the graph.
FEW = 1 << 16


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each of ``n`` items under the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        # The labels themselves move too, so what was joined before stays together.
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of all edges, and the smallest of its component."""
    got = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
    a, b = (np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, np.int64),) * 2
    node, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[joined(len(node), at[: len(a)], at[len(a) :])])], ["node", "to"])


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges (a long, b long)``; the label is the smallest node of its component."""
    spark, began = edges.sparkSession, made()
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    now = written(now, "cc-edges")
    moves: list[DataFrame] = []
    draw = random.Random(1)  # the same orders again when a round is run again
    while left := now.count():
        if left <= FEW:
            moves.append(written(now.select("a", "b").repartition(1).mapInArrow(_contracted, "node long, to long"), "cc-moves"))
            break
        salt = F.lit(draw.getrandbits(62))
        order = lambda c: F.col(c).bitwiseXOR(salt)  # noqa: B023, E731
        both = now.select(order("b").alias("node"), order("a").alias("to")).union(now.select(order("a").alias("node"), order("b").alias("to")))
        one = written(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "cc-moves")
        hop = one.select(F.col("node").alias("to"), F.col("to").alias("next"))
        two = one.join(hop, "to").select("node", F.col("next").alias("to"))
        step = written(two.join(hop, "to").select(order("node").alias("node"), order("next").alias("to")), "cc-moves")
        moves.append(step)
        half = now.join(step.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
        right = half.join(step.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        after = written(right.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).filter("a < b").distinct(), "cc-edges")
        freed(spark, began, after, *moves)
        now = after
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("label")).limit(0)
    out = moves.pop()
    while moves:
        later = out.select(F.col("node").alias("to"), F.col("to").alias("last"))
        step = moves.pop()
        out = written(step.join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to")), "cc-moves")
        freed(spark, began, out, *moves)
    least = out.groupBy("to").agg(F.min("node").alias("label"))
    return out.join(least, "to").select("node", "label")

"""A corpus pipeline: quality, near duplicates, benchmark leaks, secrets, mixture.

Each stage takes the documents that the one before kept, is written as Parquet,
and is read again by the next.  The stages decide as follows.

1. ``quality``: rows that the hierarchical quality classifier rejects go.
2. ``near_duplicates``: of each class of near duplicates (five-word shingles,
   similarity 0.8) the row of the smallest id stays.
3. ``decontaminate``: rows that hold a benchmark window go.
4. ``secrets``: findings are masked in the text; every row stays.
5. ``mixture``: rows that the weighted fair queue takes stay, with ``taken``, the
   words it takes of them (up to twice the row's size).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ocelli.llm import decontaminate, fairqueue, forest, secretscan, sitequality
from ocelli.llm.shared import settled, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sitequality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return forest.keep_first(docs, width=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secretscan.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fairqueue.mix(docs, keep=True)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", benchmark_leaks),
    ("secrets", secrets),
    ("mixture", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, as the last one returns them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: SQL can't express the classifier, the forest or the network; tests hold stages against brute force.
ORACLE_SQL = None

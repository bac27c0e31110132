"""The corpus operators as queries over the documents, pages, labels and benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, fairqueue, forest, ordermin, periodic, pst, secretscan, sitequality, tagpaths, tokencounts, toxicity, webp
from .shared import table


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score(table(spark, sf_dir, "documents"))


def op2_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_column(table(spark, sf_dir, "documents"))


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.report(table(spark, sf_dir, "documents"), 3, 85)


def op4_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.report(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count(table(spark, sf_dir, "documents"), rule="most", kind="sentences")


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitequality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_fair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fairqueue.mix(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagpaths.extract(table(spark, sf_dir, "pages"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.compare(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree": op1_suffix_tree,
    "op2_webp": op2_webp,
    "op3_lsh_forest": op3_lsh_forest,
    "op4_secret_network": op4_secret_network,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity_chain": op6_toxicity_chain,
    "op7_site_quality": op7_site_quality,
    "op8_fair_queue": op8_fair_queue,
    "op9_decontaminate": op9_decontaminate,
    "op10_tag_paths": op10_tag_paths,
    "op11_divergence": op11_divergence,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_order_minhash": op13_order_minhash,
}

ORACLES: dict[str, str] = {
    "op8_fair_queue": fairqueue.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op11_divergence": divergence.SQL,
}

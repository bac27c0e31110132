"""Rows are still the right ones if files are split otherwise from one job to the next."""

import pytest

from ocelli.llm import fairqueue, forest, shared, sitequality

from .conftest import altered, prose
from .test_forest import brute

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def docs(spark, tmp_path):
    """Twelve small files: some to a split by default, each its own split once splits are small."""
    rows = []
    for k in range(60):
        text = prose(k // 2, 60 + k // 2)
        rows.append((k, altered(text, 30) if k % 2 else text, "en", f"s{k % 3}"))
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(12).write.parquet(path)
    yield rows, spark.read.parquet(path)
    spark.conf.unset(SPLIT)


def other_splits(spark):
    spark.conf.set(SPLIT, "1k")


def test_splits_do_change_the_numbers(spark, docs):
    number = lambda: {r[0]: r[1] for r in docs[1].selectExpr("doc_id", "monotonically_increasing_id()").collect()}
    before = number()
    other_splits(spark)
    assert number() != before


def test_kept_copies(spark, docs):
    rows, df = docs
    out = forest.keep_first(df, 5, 80)
    other_splits(spark)
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 60, 2))


def test_verified_texts(spark, docs, monkeypatch):
    rows, df = docs
    first = forest.components

    def later(edges):
        other_splits(spark)
        return first(edges)

    monkeypatch.setattr(forest, "components", later)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in forest.report(df, 3, 85).collect()), key=repr)
    assert got == brute([r[:2] for r in rows], 3, 85)


def test_mixed_rows(spark, docs):
    df = docs[1]
    want = {r.doc_id: r.taken for r in fairqueue.mix(df).collect() if r.taken}
    out = fairqueue.mix(df, keep=True)
    other_splits(spark)
    assert {r.doc_id: r.taken for r in out.collect()} == want


def test_good_rows(spark, docs, monkeypatch):
    df = docs[1]
    plain = sitequality.scores
    # By the row's id instead of the classifier, so that the rows are known.
    monkeypatch.setattr(sitequality, "scores", lambda *a, **k: plain(*a, **k).withColumn("keep", shared.F.col("doc_id") % 3 == 0))
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    out = sitequality.keep_good(df, labels)
    other_splits(spark)
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 60, 3))


def test_scratch_goes_with_its_scope(spark, docs):
    import os

    before = len(shared._MADE)
    with shared.scratch(spark):
        kept = shared.written(docs[1], "some").count()
        path = shared._MADE[-1].removeprefix("file:").replace("///", "/")
        path = "/" + path.lstrip("/")
        assert kept == 60 and os.path.isdir(path)
    assert len(shared._MADE) == before and not os.path.exists(path)
    out = shared.settled(spark, lambda: shared.written(docs[1], "inner").filter("doc_id > 3"), "outer")
    assert len(shared._MADE) == before + 1 and out.count() == 56


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    conf = N(get=lambda *a: None)
    context = lambda master, folder=None: N(master=master, getConf=lambda: conf, getCheckpointDir=lambda: folder)
    with pytest.raises(ValueError):
        shared.shared_folder(N(conf=conf, sparkContext=context("spark://h:7077")))
    with pytest.raises(ValueError):
        shared.shared_folder(N(conf=conf, sparkContext=context("local-cluster[2,1,1024]")))
    assert shared.shared_folder(N(conf=conf, sparkContext=context("yarn", "hdfs:///c/x"))) == "hdfs:///c/x"


def test_operators_keep_only_what_their_result_reads(spark, docs):
    for make, most in ((lambda: forest.report(docs[1], 3, 85), 3), (lambda: fairqueue.mix(docs[1]), 1), (lambda: fairqueue.mix(docs[1], keep=True), 2)):
        before = shared.made()
        out = make()
        assert shared.made() - before <= most
        assert out.count() and out.count()

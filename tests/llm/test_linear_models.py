import numpy as np
import pytest

from ocelli.llm import linear, sitequality, toxicity

from .conftest import prose


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = np.random.default_rng(8)
    rows, labels = [], []
    for k in range(900):
        words = prose(k, int(r.integers(20, 120))).split()
        toxic, junk = r.random() < 0.2, r.random() < (0.6 if k % 9 == 0 else 0.1)
        if toxic:
            for _ in range(3):
                words.insert(int(r.integers(0, len(words))), ("grumbly", "snarkish", "boorish")[r.integers(0, 3)] + str(r.integers(0, 9)))
        if junk:
            words = [w + ("***", "$$$")[r.integers(0, 2)] for w in words]
        rows.append((k, " ".join(words), "en", f"s{k % 9}"))
        if k < 700:
            labels.append((k, int(not junk), int(toxic)))
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4).write.mode("overwrite").parquet(path)
    truth = {k: (bool(set("*$") & set(t)), "grumbly" in t or "snarkish" in t or "boorish" in t) for k, t, _, _ in rows}
    return spark.read.parquet(path), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_chain_on_held_out_rows(corpus):
    docs, labels, truth = corpus
    rows = [r for r in toxicity.score(docs, labels).collect() if r.doc_id >= 700]
    assert len(rows) == 200
    assert np.mean([r.toxic == truth[r.doc_id][1] for r in rows]) > 0.97
    assert np.mean([(r.p_low_quality >= 0.5) == truth[r.doc_id][0] for r in rows]) > 0.97
    assert rows[0].asDict().keys() == {"doc_id", "p_low_quality", "p_toxic", "low_quality", "toxic"}


def test_chain_feeds_out_of_fold_log_odds():
    r = np.random.default_rng(0)
    n = 400
    dense = r.standard_normal((n, len(linear.DENSE)))
    rows = linear.Rows(np.arange(n), np.zeros(n + 1, np.int64), np.zeros(0, np.uint32), dense)
    a = (dense[:, 0] + 0.3 * r.standard_normal(n) > 0) * 1.0
    chain = toxicity.fit_chain(rows, [("a", a), ("b", lambda c: (c.folded[0] > 0.5) * 1.0)])
    assert chain.names == ["a", "b"] and len(chain.models[1].mean) == len(linear.DENSE) + 1
    assert ((chain.folded[1] > 0.5) == (chain.folded[0] > 0.5)).mean() > 0.97


def test_newton_is_at_the_optimum():
    r = np.random.default_rng(3)
    x = r.standard_normal((300, 4))
    y = (x @ [1, -1, 0.5, 0] + r.standard_normal(300) > 0.3) * 1.0
    w = linear.newton(x, y)
    full = np.concatenate((x, np.ones((300, 1))), 1)
    gradient = full.T @ (linear.sigmoid(full @ w) - y) + np.array([1, 1, 1, 1, 1e-3]) * w
    assert np.abs(gradient).max() < 1e-3


def test_applied_as_fitted(corpus):
    docs, labels, _ = corpus
    rows = linear.sample(docs, labels, ["toxic"], 150)
    assert len(rows.key) == 150
    model = linear.Model(rows, rows.labels["toxic"], np.ones(150, bool), np.zeros((150, 0)))
    fitted = dict(zip(rows.key.tolist(), model.fitted))
    import pyarrow as pa

    from ocelli.llm.textops import buffers

    some = docs.filter("doc_id < 700").toArrow()
    raw, offs = buffers(some["text"])
    p = model.apply(*linear.featured(raw, offs), np.zeros((len(offs) - 1, 0)))
    for i, v in zip(some["doc_id"].to_pylist(), p):
        if i in fitted:
            assert abs(fitted[i] - v) < 1e-4
    assert isinstance(some, pa.Table)


def test_quality_on_held_out_rows(corpus):
    docs, labels, truth = corpus
    rows = [r for r in sitequality.report(docs, labels).collect() if r.doc_id >= 700]
    assert np.mean([r.keep != truth[r.doc_id][0] for r in rows]) > 0.97
    bad_host = {r.p_host for r in rows if r.doc_id % 9 == 0}
    assert max(bad_host) < min(r.p_host for r in rows if r.doc_id % 9)


def test_posteriors_match_plain_arithmetic(corpus):
    docs, labels, _ = corpus
    rows = sitequality.scores(docs, labels).collect()
    p = np.array([r.p_document for r in rows])
    host = np.array([r.doc_id % 9 for r in rows])
    base = p.mean()
    n, m = np.bincount(host), np.bincount(host, p) / np.bincount(host)
    within = (n * m * (1 - m)).sum() / n.sum()
    spread = (n * (m - base) ** 2).sum() / n.sum() - within * len(n) / n.sum()
    k = min(max(within / spread - 1, sitequality.WORTH[0]), sitequality.WORTH[1])
    for r in rows[:50]:
        h = r.doc_id % 9
        # Without the row itself; the path is the whole host here.
        own = (n[h] * m[h] - r.p_document) / (n[h] - 1)
        assert abs(r.p_host - (n[h] * m[h] - r.p_document + k * base) / (n[h] - 1 + k)) < 1e-6
        assert min(own, r.p_host) - 1e-6 <= r.p_path <= max(own, r.p_host) + 1e-6


def test_share_of_the_sites_evidence():
    """Its gradient is 0 where the labels follow the site, and it stays what it is drawn to without rows."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    r = np.random.default_rng(5)
    key, folded, z = np.arange(400), r.uniform(0.2, 0.8, 400), r.normal(0, 1, 400)
    y = (r.random(400) < linear.sigmoid(linear.logit(folded) + 0.8 * z)) * 1.0
    joined = spark.createDataFrame([(int(k), float(v)) for k, v in zip(key, z)] + [(900, 9.0)], "doc_id long, _shift double")
    share, threshold = sitequality._fitted(joined, key, folded, y)
    p = linear.sigmoid(linear.logit(folded) + share * z)
    assert abs(((p - y) * z).sum() + sitequality.RIDGE * (share - sitequality.TRUST)) < 1e-6 and 0.5 < share < 1
    assert threshold == min(0.5, max(0.05, np.sort(p[y > 0])[0])) and sitequality._fitted(joined, key[:0], folded[:0], y[:0]) == (sitequality.TRUST, 0.5)


def test_sample_is_bounded(spark, monkeypatch):
    """Rows that repeat an id, labels that repeat one, and long texts don't pass the bounds."""
    monkeypatch.setattr(linear, "ROW_HASHES", 50)
    docs = spark.createDataFrame([(k % 4, " ".join(f"w{k}x{j}" for j in range(400))) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, 0), (2, 1), (3, None)], "doc_id long, quality int")
    rows = linear.sample(docs, labels, ["quality"], 2)
    assert len(rows.key) == 2 and max(np.diff(rows.start)) <= 50
    every = linear.sample(docs, labels, ["quality"], 9)
    assert every.key.tolist() == [0, 1, 2] and every.labels["quality"].tolist() == [1, 0, 1]


def test_odd_rows(odd, none, labels):
    assert toxicity.score(odd, labels).count() == odd.count() and toxicity.score(none, labels).collect() == []
    assert toxicity.score(odd, labels.limit(0)).count() == odd.count()
    out = sitequality.report(odd, labels)
    assert out.count() == odd.count() and sitequality.report(none, labels).collect() == []
    kept = sitequality.keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() in (0, odd.count())

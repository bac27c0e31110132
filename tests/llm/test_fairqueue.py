from collections import defaultdict

import pytest

from ocelli.llm import fairqueue

from .conftest import prose


def sharing(size, weights=(3, 1, 2), share=1.5):
    """Targets by sharing the excess again and again."""
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, full, left = {}, set(), share * sum(size.values())
    while True:
        open_ = [s for s in names if s not in full]
        total = sum(weight[s] for s in open_)
        room = left - sum(2 * size[s] for s in full)
        target = {s: 2.0 * size[s] if s in full else room * weight[s] / total for s in names}
        over = {s for s in open_ if target[s] > 2 * size[s]}
        if not over:
            return target
        full |= over


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = [(k, prose(k, 5 + k * 7 % 60), f"s{0 if k % 3 == 0 else k % 11}") for k in range(600)] + [(600 + k, prose(k, 20), None) for k in range(20)]
    path = str(tmp_path_factory.mktemp("mix"))
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.mode("overwrite").parquet(path)
    return rows, spark.read.parquet(path)


def test_targets_and_what_is_taken(corpus):
    rows, docs = corpus
    got = fairqueue.mix(docs).collect()
    size, taken, named = defaultdict(int), defaultdict(int), {i: s for i, _, s in rows}
    for r in got:
        assert r.size == len(next(t for i, t, _ in rows if i == r.doc_id).split()) and 0 <= r.taken <= 2 * r.size
        size[named[r.doc_id]] += r.size
        taken[named[r.doc_id]] += r.taken
    want = sharing(size)
    for r in got:
        s = named[r.doc_id]
        assert r.source_size == size[s] and abs(r.target - want[s]) < 1e-6
    for s in size:
        assert abs(taken[s] - want[s]) <= 130
    assert sum(taken.values()) == int(1.5 * sum(size.values()))
    assert sorted(map(tuple, got)) == sorted(map(tuple, fairqueue.mix(docs.repartition(7)).collect()))


def test_odd_rows(odd, none, odd_rows):
    got = fairqueue.mix(odd).collect()
    assert len(got) == len(odd_rows) and fairqueue.mix(none).collect() == []
    assert all(r.taken == 0 for r in got if not r.size)
    kept = fairqueue.mix(odd, keep=True)
    assert kept.columns == [*odd.columns, "taken_words"]
    assert kept.groupBy().sum("taken_words").first()[0] == sum(r.taken for r in got)


def test_texts_without_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None), (3, "  ", "a")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in fairqueue.mix(df).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0), (3, 0, 0.0, 0)]

import random

import pytest

from ocelli.llm import components as C


def plain(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {x: root(x) for x in up}


def run(spark, edges, monkeypatch):
    rounds = []
    written = C.written
    monkeypatch.setattr(C, "written", lambda df, name: rounds.append(name) or written(df, name))
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    got = {r.node: r.label for r in C.components(df).collect()}
    monkeypatch.setattr(C, "written", written)
    return got, max(rounds.count("cc-edges") - 1, 0)


@pytest.mark.parametrize("order", ["sorted", "zigzag", "random"])
def test_paths_take_few_rounds(spark, monkeypatch, order):
    n = 1000
    ids = list(range(n))
    if order == "zigzag":
        ids = [x for k in range(n // 2) for x in (k, n - 1 - k)]
    if order == "random":
        random.Random(3).shuffle(ids)
    edges = [(ids[k + 1], ids[k]) for k in range(n - 1)]
    got, rounds = run(spark, edges, monkeypatch)
    assert got == dict.fromkeys(range(n), 0) and rounds <= 15


def test_any_graph(spark, monkeypatch):
    g = random.Random(5)
    edges = [(g.randrange(-50, 400), g.randrange(-50, 400)) for _ in range(260)] + [(1000, k) for k in range(1001, 1200)] + [(7, 7), (9999, 9999)] + [(5000 + i, 5000 + j) for i in range(12) for j in range(i)]
    got, rounds = run(spark, edges, monkeypatch)
    assert got == plain(edges) and rounds <= 10
    assert run(spark, [(3, 3)], monkeypatch) == ({}, 0)


def test_a_small_rest_is_contracted_at_once(spark, monkeypatch):
    """Below the limit no round is run and two tables are written; above it rounds go on until the rest is that small; the labels are the same."""
    g = random.Random(8)
    edges = [(g.randrange(-900, 900), g.randrange(-900, 900)) for _ in range(900)] + [(k + 1, k) for k in range(2000, 2300)] + [(5000, k) for k in range(5001, 5200)]
    for few, least, most in ((1 << 16, 0, 0), (200, 1, 8), (0, 2, 15)):
        monkeypatch.setattr(C, "FEW", few)
        got, rounds = run(spark, edges, monkeypatch)
        assert got == plain(edges) and least <= rounds <= most


@pytest.mark.parametrize("order", ["sorted", "zigzag", "random"])
def test_paths_take_few_rounds_without_that(spark, monkeypatch, order):
    monkeypatch.setattr(C, "FEW", 0)
    test_paths_take_few_rounds(spark, monkeypatch, order)

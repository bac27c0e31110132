import hashlib
import re

import pytest

from ocelli.llm import decontaminate

from .conftest import prose

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=10):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            v = words(x)
            n = min(width, len(v))
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for k in range(len(w) - n + 1) if n else ():
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(spark):
    a, b = prose(70, 25), prose(71, 12)
    rows = [(1, a), (2, b), (10, "short item, HERE"), (11, None), (12, "..."), (3, b), (4, prose(72, 10))]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def leaky(spark, items, odd_rows):
    (_, a), (_, b) = items[0][:2]
    w = a.split()
    rows = [(100, prose(1, 30) + " " + a.upper() + " " + prose(2, 30)), (101, " ".join(w[3:15]) + ". tail"), (102, " ".join(w[:9])), (103, "x Short-item (here) y"), (104, b + " " + b + " short item here"), (105, " ".join(w[5:]) + " " + " ".join(w[:5])), (None, b)]
    rows += [(r[0], r[1]) for r in odd_rows]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=repr)


def test_matches_brute_force(leaky, items):
    assert got(decontaminate.report(leaky[1], items[1])) == brute(leaky[0], items[0])


def test_benchmark_in_blocks(leaky, items, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    assert got(decontaminate.report(leaky[1], items[1])) == brute(leaky[0], items[0])


def test_empty_sides(none, odd, items):
    assert decontaminate.report(none, items[1]).collect() == []
    assert not any(r.contaminated for r in decontaminate.report(odd, items[1].limit(0)).collect())


def test_cleaning(odd, leaky, items):
    bad = {r[0] for r in brute(leaky[0], items[0]) if r[-1]}
    kept = decontaminate.clean(leaky[1], items[1]).collect()
    assert {r.doc_id for r in kept}.isdisjoint(bad - {None}) and len(kept) == sum(not r[-1] for r in brute(leaky[0], items[0]))
    cut = {r.doc_id: r.text for r in decontaminate.clean(leaky[1], items[1], remove="spans").collect()}
    assert cut[103] == "x ) y" and cut[102] == " ".join(items[0][0][1].split()[:9])
    assert not any(r[-1] for r in brute([(i, t) for i, t in cut.items() if i != 105], items[0]))
    assert decontaminate.clean(odd, items[1]).columns == odd.columns

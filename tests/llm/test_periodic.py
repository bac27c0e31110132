import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ocelli.llm import periodic

from .conftest import prose

WORD = r"[^\x20\x09-\x0D]+"


def brute(w, least=24, times=3):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q):
                if not any(all(w[a] == w[a + p] for a in range(i, i + size - p)) for p in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(i, text):
    w = re.findall(WORD, text or "")
    h = zlib.crc32(b"" if i is None else str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def expected(i, text):
    w = planted(i, text)
    runs = brute(w) if len(w) < 3000 else []
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (i, len(runs), *tail, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 5), st.integers(0, 90))
def test_runs_match_the_definition(seed, letters, n):
    r = random.Random(seed)
    w = [r.randrange(letters) for _ in range(n)]
    for _ in range(r.randrange(4)):  # with repeats of every kind, also within each other
        a, q, k = r.randrange(n + 1), r.randrange(1, 12), r.randrange(2, 9)
        w[a:a] = [r.randrange(letters) for _ in range(q)] * k
    assert periodic.runs_of(w) == brute(w)


def test_one_word_and_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    for w in ([0] * 500, b, [0, 0, 1] * 90 + [0, 0] + [0, 0, 1] * 90, []):
        assert periodic.runs_of(w) == brute(w)


def test_long_runs_stay_near_linear():
    w = [k % 3000 for k in range(60_000)]
    assert periodic.runs_of(w) == [(0, 60_000, 3000)]
    assert periodic.runs_of([0] * 60_000) == [(0, 60_000, 1)]


def test_sets_of_many_pieces():
    r = random.Random(1)
    order = list(range(5000))
    r.shuffle(order)
    s = periodic.Ends(order[0])
    for x in order[1:]:
        s.add(x)
    assert list(s) == list(range(5000)) and s.around(0) == (-1, 1) and s.around(4999) == (4998, -1) and s.around(1024) == (1023, 1025)


@pytest.fixture(scope="module")
def texts():
    a, b = prose(80, 9), prose(81, 30)
    return [
        (100, " ".join([a] * 6)),
        (101, b + " " + " ".join([a] * 3) + "\n" + b),
        (102, " ".join(["x"] * 23)),
        (103, " ".join(["x"] * 24)),
        (104, b + " tail " + b + " other " + b),
        (105, " ".join([b] * 3) + " " + " ".join(["y z"] * 20) + " " + b),
        (106, (a + "  \t") * 4 + a[:-1]),
    ] + [(k, prose(k, 70)) for k in range(200, 260)]


def test_query_matches_brute_force(spark, texts, odd_rows):
    rows = texts + [(r[0], r[1]) for r in odd_rows if len((r[1] or "").split()) < 3000]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((expected(*r) for r in rows), key=repr)
    assert got(periodic.report(df)) == want
    assert sum(r[1] > 0 for r in want) > 8


def test_blocks_do_not_matter(spark, texts, monkeypatch):
    df = spark.createDataFrame(texts, "doc_id long, text string")
    whole = got(periodic.find(df))
    from ocelli.llm import textops

    monkeypatch.setattr(textops.blocks, "__defaults__", (100,))
    assert got(periodic.find(df)) == whole


def test_odd_tables(odd, none):
    assert periodic.report(odd).count() == odd.count()
    assert periodic.report(none).collect() == []
    with pytest.raises(ValueError):
        periodic.find(odd, least=10)

import hashlib
import re

import pytest
import xxhash

from ocelli.llm import ordermin

from .conftest import altered, prose

WORD = r"[^\x20\x09-\x0D]+"


MASK = (1 << 64) - 1


def chained(words):
    h = 42
    for w in words:
        h = xxhash.xxh64(w, seed=h).intdigest()
    return h


def numbered(h, count):
    """Spark's hash of a long and then of an int."""
    seed = xxhash.xxh64(h.to_bytes(8, "little"), seed=42).intdigest()
    p1, p2, p3 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    h = (seed + 0x27D4EB2F165667C5 + 4) & MASK
    h ^= count * p1 & MASK
    h = ((h << 23 | h >> 41) & MASK) * p2 + p3 & MASK
    h = (h ^ h >> 33) * p2 & MASK
    h = (h ^ h >> 29) * p3 & MASK
    return h ^ h >> 32


def brute(text, width=2, bins=64, pick=2):
    w = [x.encode() for x in re.findall(WORD, text or "")]
    mers = [chained([*w[i : i + width]]) for i in range(len(w))]
    seen, ranked = {}, []
    for at, m in enumerate(mers):
        k = seen[m] = seen.get(m, -1) + 1
        ranked.append((numbered(m, k), at))
    out = []
    for b in range(bins):
        inside = sorted((g, at) for g, at in ranked if g >> 58 == b)[:pick]
        if inside:
            tup = 42
            for at in sorted(at for _, at in inside):
                tup = xxhash.xxh64(mers[at].to_bytes(8, "little"), seed=tup).intdigest()
            out.append(b << 16 | tup & 0xFFFF)
    return out


def like(a, b):
    of = len({x >> 16 for x in a} | {x >> 16 for x in b})
    return len(set(a) & set(b)) / of if of else 1.0


def expected(rows):
    """As the docstring has it: rows of equal id and text are one document."""
    spark_hash = lambda t: (h := xxhash.xxh64(t.encode(), seed=42).intdigest()) - (h >> 63 << 64)
    rows = [(i, t or "") for i, t in rows]
    line = sorted(set(rows), key=lambda r: (r[0] is None, -(r[0] or 0), spark_hash(r[1])))
    after = {r: line[(k + 1) % len(line)] for k, r in enumerate(line)}
    form = lambda f: "".join(f"{x:06x}" for x in f)
    out = []
    for i, t in rows:
        nxt, n = after[(i, t)][1], len(t)
        edited = t[: n - n // 3] + nxt[: n // 3]
        a, b, c = brute(t), brute(edited), brute(nxt)
        out.append((i, n, hashlib.sha256(edited.encode()).hexdigest(), form(a), form(b), like(a, b), like(a, c)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows(odd_rows):
    base = prose(90, 300)
    half = base.split()
    more = [(300, base), (301, altered(base, 150)), (302, " ".join(half[150:] + half[:150])), (303, "the same word " * 400), (304, "same " * 33), (305, prose(91, 900))]
    return more + [(r[0], r[1]) for r in odd_rows]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_matches_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(ordermin.compare(df)) == expected(rows)


def test_senses_order(spark, rows):
    df = ordermin.fingerprint(spark.createDataFrame(rows[:3], "doc_id long, text string"), "text", "f")
    f = {r.doc_id: r.f for r in df.collect()}
    near, moved = like(f[300], f[301]), like(f[300], f[302])
    sets = {k: {tuple(t.split()[i : i + 2]) for t in [dict(rows)[k]] for i in range(299)} for k in (300, 302)}
    jaccard = len(sets[300] & sets[302]) / len(sets[300] | sets[302])
    assert near > 0.9 and jaccard > 0.9 and 0.3 < moved < 0.75


def test_lone_and_empty(spark, none):
    one = spark.createDataFrame([(5, "abcdef ghi")], "doc_id long, text string")
    r = ordermin.compare(one).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abcdef abc").hexdigest()
    assert ordermin.compare(none).collect() == []


def test_odd_tables_and_plan(odd):
    df = ordermin.compare(odd)
    assert df.count() == odd.count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "MapIn"))


def test_texts_cross_once(spark, odd):
    """Both uses of the keyed texts read one exchange."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxPlanStringLength": "1000000"}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        df = ordermin.compare(odd)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in held:
            spark.conf.unset(k)
    assert "ReusedExchange" in plan.split("Initial Plan")[0]

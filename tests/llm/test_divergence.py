import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from ocelli.llm import divergence

from .conftest import prose

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def brute(rows, least=3, k=200):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        g = (lang or "", source or "")
        groups.add(g)
        terms = re.findall(TERM, lower(text))
        counts[g].update(terms)
        docs[g[0]].update(set(terms))
    kept = {lang: {t for t, c in docs[lang].items() if c >= least} for lang, _ in groups}
    out = []
    for lang, source in groups:
        v = kept[lang]
        share = lambda c, n: 1 + 1_000_000_000 * (c + 1) // (n + len(v))

        def shares(source):
            c = counts[(lang, source)]
            n = sum(c[t] for t in v)
            return {t: share(c[t], n) for t in v}

        p = shares(source)
        pairs = []
        for other in sorted({s for x, s in groups if x == lang} - {source}):
            q = shares(other)
            pairs.append((sum((p[t] - q[t]) ** 2 // q[t] for t in v), other))
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(counts[g])
        n = sum(whole[t] for t in v)
        over = []
        for t in v:
            q = share(whole[t], n)
            if counts[(lang, source)][t] and p[t] > q:
                over.append(((p[t] - q) ** 2 // q, t))
        for part, items, most in (("pair", pairs, len(pairs)), ("term", over, k)):
            items = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, t, x, r + 1) for r, (x, t) in enumerate(items)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.fixture(scope="module")
def rows(odd_rows):
    out = [(r[1], r[2], r[3]) for r in odd_rows]
    for k in range(60):
        out.append((prose(k % 45, 80 + k) + " Été ÉTÉ naïve x_y a9b", ("en", "de", None)[k % 3], (None, "hot", "hot", "b", "c")[k % 5]))
    return out + [("only here", "xx", "s"), ("only here", "xx", "t"), (None, "yy", "s"), ("one one one", "zz", "s")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)


def test_matches_brute_force(spark, rows):
    assert got(divergence.audit(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("k", [1, 7])
def test_ties_are_cut_by_bytes(spark, rows, k):
    assert got(divergence.audit(frame(spark, rows), k=k)) == brute(rows, k=k)


def test_select_top(spark, tmp_path):
    long_ = "x" * 5000
    items = [("g", f"{long_}{i:04d}", 7) for i in range(300)] + [("g", "a", 10**18), ("g", "é", 8), ("g", "", 7), ("g", long_, 7)]
    items += [("h", f"t{i}", i * i % 91 << i % 50) for i in range(500)] + [("one", "z", 0)]
    spark.createDataFrame(items, "g string, item string, value long").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    for k in (1, 4, 90, 1000):
        want = []
        for g in ("g", "h", "one"):
            want += sorted(((g, t, v) for x, t, v in items if x == g), key=lambda r: (-r[2], r[1].encode()))[:k]
        assert sorted(tuple(r) for r in divergence.select_top(rows, ["g"], k).select("g", "item", "value").collect()) == sorted(want)


def test_lowering(spark):
    df = spark.createDataFrame([("AZ az \u00c0\u00c9 \u00df \u0130stanbul \u1e9e \u212a",), ("ASCII Z",)], "t string").select(divergence.lowered(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == ["az az \u00c0\u00c9 \u00df \u0130stanbul \u1e9e \u212a", "ascii z"]


def test_odd_tables_and_sql(spark, odd, none, tmp_path):
    assert divergence.audit(none).collect() == []
    odd.select("doc_id", "text", "lang", "source").write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    want = c.sql(divergence.SQL).fetchall()
    assert got(divergence.audit(odd)) == sorted(want)

"""Policy, merges, caps, scope, trust, targets, sources, streaming."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ocelli.functions import coerce as N
from ocelli.functions import evidence as E
from ocelli.functions import geo as G
from ocelli.functions import status as S
from ocelli.functions import url as U
from ocelli.operators import admit, merge, policy, rank, scope, summarize, targets, trust
from ocelli.operators.policy import Rule
from ocelli.plans.run import CANDIDATE, shaped
from ocelli.sources import registry
from ocelli.sources import rows as R
from ocelli.sources import search
from ocelli.streaming import progress


def column(spark, expr, items, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(items)], f"k int, v {kind}")
    return [r[1] for r in df.select("k", expr).orderBy("k").collect()]


def test_registry():
    text = "# Allowed Sources\n| Name | URL | Type | Enabled |\n|---|:-:|---|---|\n| A | https://a.example | feed | yes |\n| | https://b.example | odd | no |\n\n# Blocked Sources\n| Pattern | Reason |\n|---|---|\n| blocked.example | policy |\n| *.bad.example | |\n"
    r = registry.parse(text)
    assert [(s[0], s[1], s[2], s[4]) for s in r.sources] == [("A", "https://a.example", "feed", True), ("https://b.example", "https://b.example", "page", False)]
    assert r.rules == [Rule("blocked.example", "policy"), Rule("*.bad.example", None)]


def test_registry_of_a_missing_file(spark, tmp_path):
    r = registry.load(spark, str(tmp_path / "none.md"), ["x.example", " "])
    assert r.sources == [] and r.rules == [Rule("x.example", "cli_block_pattern")]
    assert r.frame(spark).count() == 0


@pytest.mark.parametrize(
    ("pattern", "url", "hit"),
    [
        ("blocked.example", "https://blocked.example/x", True),
        ("blocked.example", "https://sub.blocked.example:8080/x", True),
        ("blocked.example", "https://notblocked.example/x", False),
        ("*.bad.example", "https://a.bad.example/", True),
        ("*.bad.example", "https://bad.example/", False),
        ("https://p.example/private*", "https://p.example/private/1", True),
        ("/secret?/", "https://x.example/secret1/a", True),
        ("cam[!0-9].example", "https://camx.example/", True),
        ("cam[!0-9].example", "https://cam1.example/", False),
        ("a+b.example", "https://a+b.example/", True),
    ],
)
def test_block_patterns(spark, pattern, url, hit):
    (got,) = column(spark, policy.block_reason(F.col("v"), [Rule(pattern, "r")]), [url])
    assert (got == "r") is hit


def test_first_rule_wins_and_null_urls_pass(spark):
    rules = [Rule("x*", "one"), Rule("x.example", "two"), Rule("y.example")]
    assert column(spark, policy.block_reason(F.col("v"), rules), ["https://x.example", "https://y.example", None, ""]) == ["one", "blocked_by_pattern:y.example", None, None]


def test_guardrail(spark):
    queries = ["site:a.gov cameras -login -admin", "rtsp://x camera", "inurl:admin login webcam", "admin login camera", "traffic lights", "webcam password"]
    assert column(spark, policy.safe_query(F.col("v")), queries) == [True, False, False, False, False, False]


def test_harvest_merge(spark):
    rows = [
        (1, "HTTPS://MEDIA.EXAMPLE/cam.m3u8#frag", "unknown_media", None, "d1", "s1", {"a": "1"}),
        (2, "https://media.example/cam.m3u8", "hls", "Camera", "d2", "s2", {"a": "9", "b": "2", "c": ""}),
        (3, "https://media.example/cam.m3u8", "stream", "Other", "d3", "s3", None),
    ]
    for order in (rows, rows[::-1]):
        (r,) = merge.merge_harvest_records(spark.createDataFrame(order, "_ord long, url string, media_type string, title string, description string, source_url string, metadata map<string,string>").repartition(3)).collect()
        assert (r._ord, r.url, r.media_type, r.title, r.description, r.source_url) == (1, "https://media.example/cam.m3u8", "hls", "Camera", "d1", "s1")
        assert r.metadata == {"a": "1", "b": "2"} and r.duplicate_sources == ["s2", "s3"]


def plain_fold(rows, is_hls=None):
    """The fold as a loop over dictionaries."""
    over = set(merge.OVERRIDES)
    out = {}
    for r in rows:
        r = dict(r, metadata=dict(r["metadata"]))
        key = r["stream_url"]
        if key not in out:
            out[key] = r
            continue
        e = out[key]
        hls = is_hls or (lambda x: x["stream_url"].endswith(".m3u8") or x["metadata"].get("media_type") == "hls")
        js = lambda x: x["metadata"].get("json_metadata_extracted") == "true"
        better = js(r) and not js(e)
        fill = lambda a, b: {**{k: v for k, v in b.items() if a.get(k) in (None, "")}, **{k: v for k, v in a.items() if v not in (None, "") or k not in b}}
        if hls(r) and not hls(e):
            out[key] = dict(r, _ord=e["_ord"])
        elif r["lat"] is not None and (e["lat"] is None or better):
            out[key] = dict(r, _ord=e["_ord"], metadata=fill(r["metadata"], e["metadata"]))
        else:
            for f in ("title", "location_text"):
                if r[f] and (not e[f] or better):
                    e[f] = r[f]
            e["metadata"] = fill(e["metadata"], r["metadata"])
            if js(r):
                e["metadata"] |= {k: v for k, v in r["metadata"].items() if k in over}
    return out


def test_fold_matches_a_loop(spark):
    g = random.Random(5)
    rows = []
    for k in range(400):
        meta = {m: g.choice(["", f"v{k}"]) for m in g.sample(["camera_id", "x", "y", "camera_type"], 2)}
        if g.random() < 0.4:
            meta["json_metadata_extracted"] = "true"
        if g.random() < 0.3:
            meta["media_type"] = g.choice(["hls", "image_snapshot"])
        rows.append({"_ord": k, "stream_url": f"https://h.example/{g.randrange(40)}.jpg", "title": g.choice([None, f"t{k}"]), "location_text": g.choice([None, f"l{k}"]), "lat": g.choice([None, float(k % 80)]), "lon": 1.0, "metadata": meta})
    for r in rows:
        r["lon"] = None if r["lat"] is None else 1.0
    df = spark.createDataFrame(rows, "_ord long, stream_url string, title string, location_text string, lat double, lon double, metadata map<string,string>").repartition(5)
    got = {r.stream_url: r.asDict() for r in merge.fold_candidates(df).collect()}
    assert got == plain_fold(rows)


def crowd_rows(seed, n, urls):
    g = random.Random(seed)
    rows = []
    for k in range(n):
        meta = {m: g.choice(["", f"v{k}"]) for m in g.sample(["camera_id", "x", "y", "camera_type"], 2)}
        if g.random() < 0.4:
            meta["json_metadata_extracted"] = g.choice(["true", "true", "false", "0", ""])
        if g.random() < 0.4:
            meta["media_type"] = g.choice(["hls", "HLS", "image_snapshot", "rtsp", ""])
        lat = g.choice([None, None, float(k % 80)])
        rows.append({"_ord": k, "stream_url": g.choice(urls), "title": g.choice([None, "", f"t{k}"]), "location_text": g.choice([None, f"l{k}"]), "lat": lat, "lon": None if lat is None else 1.0, "metadata": meta})
    return rows


def declared_hls(r):
    """A declared type goes before the URL's."""
    declared = (r["metadata"].get("media_type") or "").lower()
    return declared == "hls" if declared else ".m3u8" in r["stream_url"]


def test_fold_of_crowds_matches_a_loop(spark):
    """URLs of any number of rows, with and without streams in their names, cut by every partition's edge."""
    schema = "_ord long, stream_url string, title string, location_text string, lat double, lon double, metadata map<string,string>"
    for seed, n, urls in ((1, 500, ["https://h.example/a.jpg"] * 8 + ["https://h.example/b.m3u8", "https://h.example/c.jpg"]), (2, 300, ["https://h.example/live.m3u8"]), (3, 200, [f"https://h.example/{k}.m3u8" for k in range(60)])):
        rows = crowd_rows(seed, n, urls)
        df = spark.createDataFrame(rows, schema).repartition(5)
        want = plain_fold(rows, declared_hls)
        for crowd in (0, 20, 10_000):
            got = {r.stream_url: r.asDict() for r in merge.fold_candidates(df, crowd=crowd).collect()}
            assert got == want, (seed, crowd)


def test_target_merge_keeps_first_and_merges_nothing(spark):
    rows = [(0, 1, "u#first", "t", None), (0, 2, "u#duplicate", "t", "later"), (1, 1, "u", "s", None)]
    out = merge.merge_target_sets(spark.createDataFrame(rows, "set_ord int, _ord long, stream_url string, target_id string, title string")).collect()
    assert sorted((r.stream_url, r.target_id, r.title) for r in out) == [("u", "s", None), ("u#first", "t", None)]


def test_caps_match_a_loop(spark):
    g = random.Random(2)
    rows = [(k, g.random() < 0.5, f"t{g.randrange(3)}") for k in range(300)]
    df = spark.createDataFrame(rows, "k long, c boolean, t string").repartition(4)

    def loop(items):
        n, out = [0, 0], []
        for k, c, _ in items:
            if sum(n) < 50 and n[c] < (30, 25)[c]:
                n[c] += 1
                out.append(k)
        return out

    assert sorted(r.k for r in admit.class_capped(df, F.col("c"), 25, 30, 50, "k").collect()) == loop(rows)
    per = admit.class_capped_per(df, ["t"], F.col("c"), 25, 30, 50, "k")
    assert sorted(r.k for r in per.collect()) == sorted(k for t in ("t0", "t1", "t2") for k in loop([r for r in rows if r[2] == t]))
    assert admit.class_capped(df, F.col("c"), 25, 30, 50, "k", taken=(25, 30)).count() == 0


def test_joint_budgets(spark):
    rows = [("r", k, p, h, f) for k, (p, h, f) in enumerate([("blind:ddg", "a", True), ("blind", "a", True), ("blind", "a", False), ("directory", "b", False), ("directory", "b", False), ("directory", "b", False), ("directory", "c", False)])]
    df = spark.createDataFrame(rows, "run_id string, _ord long, provider string, host string, failed boolean")
    got = [r.skip_reason for r in admit.joint_budgets(df, 5, {"blind": 3, "directory": 2}, 2).orderBy("_ord").collect()]
    assert got == [None, None, "host_browser_budget_exhausted", None, None, "directory_browser_budget_exhausted", "directory_browser_budget_exhausted"]


def plain_budgets(rows, total, by_provider, per_host, failures):
    state, out = {}, {}
    for run, ord_, provider, host, failed in sorted(rows, key=lambda r: r[1]):
        used, fam, hosts, bad = state.setdefault(run, ([0], {}, {}, {}))
        family = (provider or "").split(":")[0]
        if used[0] >= total:
            reason = "global_browser_budget_exhausted"
        elif fam.get(family, 0) >= by_provider.get(family, total):
            reason = f"{family}_browser_budget_exhausted"
        elif hosts.get(host, 0) >= per_host:
            reason = "host_browser_budget_exhausted"
        elif bad.get(host, 0) >= failures:
            reason = "host_browser_cooldown"
        else:
            reason = None
            used[0] += 1
            fam[family] = fam.get(family, 0) + 1
            hosts[host] = hosts.get(host, 0) + 1
            bad[host] = bad.get(host, 0) + bool(failed)
        out[(run, ord_)] = reason
    return out


def test_joint_budgets_match_a_loop(spark):
    for seed, total, by, per_host, failures in ((1, 40, {"blind": 9, "directory": 17}, 4, 2), (2, 500, {"blind": 30, "": 3, "seed": 0}, 6, 1), (3, 7, {"blind": 50}, 1, 3), (4, 0, {}, 2, 2), (5, 30, {"blind": 5}, 0, 2), (6, 25, {"blind": 5, "directory": 5, "seed": 5, "map": 5}, 30, 9)):
        g = random.Random(seed)
        rows = [(g.choice(["a", "b", None]), k, g.choice(["blind:x", "blind:y", "directory", "seed", "map", None]), g.choice([f"h{g.randrange(40)}", "hot", "hot", None]), g.random() < 0.3) for k in range(600)]
        df = spark.createDataFrame(rows, "run_id string, _ord long, provider string, host string, failed boolean").repartition(5)
        got = admit.joint_budgets(df, total, by, per_host, failures)
        assert {(r.run_id, r._ord): r.skip_reason for r in got.collect()} == plain_budgets(rows, total, by, per_host, failures), seed
        assert got.columns == [*df.columns, "admitted", "skip_reason"] and got.filter("admitted = (skip_reason IS NULL)").count() == 600
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_many_rules_give_the_reasons_of_the_expression(spark, monkeypatch):
    g = random.Random(4)
    label = lambda: "".join(g.choice("abc") for _ in range(g.randrange(1, 3)))
    made = lambda: g.choice([f"{label()}.{label()}.org", f"*.{label()}.org", f"*{label()}*.org", f"{label()}.?{label()}.org", f"/{label()}/", f"{label()}/*{label()}", f"https://{label()}.*", f"http://{label()}.{label()}.org/{label()}", "[ab]c.org", "*.[!a].org", f"{label()}/[a-b]x"])
    rules = [Rule(made(), g.choice([None, f"r{k}"])) for k in range(120)]
    urls = [None, "", "not a url"] + [f"{g.choice(['http', 'https', 'HTTPS'])}://{g.choice(['', 'u@'])}{'.'.join(label() for _ in range(g.randrange(1, 4)))}.{g.choice(['org', 'ORG', 'net'])}{g.choice(['', ':80'])}/{label()}/{label()}{g.choice(['', 'x', '/' + label()])}" for _ in range(400)]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    for some in (rules, rules[60:], rules[100:]):
        got = []
        for few in (1000, 0):
            monkeypatch.setattr(policy, "FEW_RULES", few)
            got.append([r.r for r in df.select(policy.block_reason(F.col("url"), some).alias("r")).collect()])
        assert got[0] == got[1] and sum(x is not None for x in got[0]) > 50


def test_ten_thousand_rules(spark):
    rules = [Rule(f"h{k}.example.org") for k in range(9000)] + [Rule(f"*/p{k}/list") for k in range(1000)]
    df = spark.range(20_000).select(F.concat(F.lit("https://x.h"), F.col("id"), F.lit(".example.org/p"), F.col("id") - 15_000, F.lit("/list")).alias("url"))
    got = df.select(policy.block_reason(F.col("url"), rules).alias("r")).groupBy(F.col("r").isNull().alias("open")).count().collect()
    assert {r.open: r["count"] for r in got} == {False: 10_000, True: 10_000}


def test_scope_by_bands_is_that_of_the_polygons(spark):
    g = random.Random(8)

    def ring(cx, cy, r, n):
        return [(cx + r * (0.4 + g.random()) * math.cos(2 * math.pi * k / n), cy + r * (0.4 + g.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]

    flat = [(1.0, 1.0), (5.0, 1.0), (5.0, 1.0)]
    shapes = {"a": [[ring(0, 0, 30, 400), ring(0, 0, 8, 50)], [ring(60, 20, 10, 7)]], "b": [[[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]], [[(1.0, 1.0)]], []], "c": [[flat]], "d": None, "e": []}
    points = lambda v: None if v is None else [[[{"lon": x, "lat": y} for x, y in r] for r in p] for p in v]
    rows = [{"target_id": k, "polygons": points(v), "bbox": None, "bbox_verified": True} for k, v in shapes.items()]
    targets = spark.createDataFrame(rows, f"target_id string, bbox struct<min_lat:double,max_lat:double,min_lon:double,max_lon:double>, polygons {scope.POLYGONS}, bbox_verified boolean")
    spots = [(k, g.choice("abcdez"), g.choice([None, g.uniform(-40, 40), float(g.randrange(-2, 12))]), g.uniform(-40, 75) if k % 3 else float(g.randrange(-2, 12))) for k in range(3000)]
    df = spark.createDataFrame(spots, "_ord long, target_id string, lat double, lon double").withColumns({"scope_status": F.lit("x"), "trust_level": F.lit("untrusted"), "reasons": F.array().cast("array<string>")})
    plain = scope.with_target(df, targets).select("_ord", scope.scope(F.col("lat"), F.col("lon"), F.col("t_bbox"), F.col("t_polygons"), F.col("t_bbox_verified"))["scope_status"])
    got = scope.scoped(df, targets).select("_ord", "scope_status")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    assert got.filter("scope_status = 'in_scope'").count() > 100


def test_scope_of_a_polygon_of_many_points(spark):
    n = 100_000
    targets = spark.range(1).select(F.when(F.col("id") >= 0, "t").alias("target_id"), F.lit(None).cast("struct<min_lat:double,max_lat:double,min_lon:double,max_lon:double>").alias("bbox"), F.lit(True).alias("bbox_verified"), F.array(F.array(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct((20 * F.cos(2 * math.pi * k / n)).alias("lon"), (20 * F.sin(2 * math.pi * k / n)).alias("lat"))))).cast(scope.POLYGONS).alias("polygons"))
    df = spark.range(20_000).select(F.col("id").alias("_ord"), F.when(F.col("id") >= 0, "t").alias("target_id"), (F.rand(1) * 60 - 30).alias("lat"), (F.rand(2) * 60 - 30).alias("lon"), F.lit("").alias("scope_status"), F.lit("").alias("trust_level"), F.array().cast("array<string>").alias("reasons"))
    out = scope.scoped(df, targets)
    far = F.sqrt(F.col("lat") ** 2 + F.col("lon") ** 2)
    wrong = out.filter((F.abs(far - 20) > 0.001) & ((far < 20) != (F.col("scope_status") == "in_scope")))
    assert wrong.count() == 0
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_joint_budgets_of_no_rows(spark):
    df = spark.createDataFrame([], "run_id string, _ord long, provider string, host string, failed boolean")
    assert admit.joint_budgets(df, 5, {"blind": 3}, 2).collect() == []


def test_coercion(spark):
    assert column(spark, N.boolean(F.col("v")), ["In Service", "0", "maybe", None]) == [True, False, None, None]
    assert column(spark, N.first_number(F.col("v")), ["-77.03°", "abc", "", None]) == [-77.03, None, None, None]
    assert column(spark, N.whole_number(F.col("v")), ["1d", "1_000", " 2.5 ", "1e3"]) == [None, None, 2.5, 1000.0]
    assert column(spark, N.epoch_to_iso(F.col("v")), ["1779372180000", "1779372180", "-5", "x"]) == ["2026-05-21T14:03:00Z"] * 2 + [None, None]
    assert column(spark, N.refresh_seconds(F.col("v")), ["15", "30 sec", "2 min", "often"]) == [15.0, 30.0, 120.0, None]
    assert column(spark, N.camera_type(F.col("v")), ["Weather camera", "CCTV", "Airport", "tourist cam", "", "misc"]) == ["weather", "traffic", "airport", "tourism", "camera", "other"]


def test_geography(spark):
    df = spark.createDataFrame([(38.9, -77.0, 40.7, -74.0)], "a double, b double, c double, d double")
    assert abs(df.select(G.haversine_km(*[F.col(c) for c in "abcd"])).first()[0] - 325.1) < 1
    b = G.pad_box(G.box(34.0, 34.0001, -118.0, -117.9999), 1.0)
    h, w = df.select(G.box_height(b), G.box_width(b)).first()
    assert abs(h - 1) < 1e-6 and abs(w - 1) < 1e-6
    assert df.select(G.box_plausible(G.box(32, 42.5, -125, -114), F.lit("state"))).first()[0] == "ok"
    got = df.select(G.box_from_geocoder(F.array(*map(F.lit, ("32", "42", "-125", "-114"))))["max_lat"], G.box_from_geocoder(F.array(*map(F.lit, ("x", "42", "-125", "-114"))))).first()
    assert tuple(got) == (42.0, None)


def test_statuses(spark):
    statuses = ["restricted_http", "decode_failed", "active_live_verified", "", "auth_required_rtsp"]
    assert column(spark, S.category(F.col("v")), statuses) == ["dead", "unknown", "live", "unknown", "unknown"]
    assert column(spark, S.bucket(F.col("v")), statuses) == ["restricted", "dead", "live", "not_validated", "restricted"]
    assert column(spark, S.static_by_headers(F.col("v")), ["max-age=86400", "max-age=60", "immutable", None, "max-age=99999999999999999999"]) == [True, False, True, False, True]
    png, short = bytearray(b"\x89PNG\r\n\x1a\n0000"), bytearray(b"\x89PNG")
    assert column(spark, S.image_bytes(F.col("v")), [png, short, bytearray(b"RIFF0000WEBP"), bytearray(b"<html>....."), None], "binary") == [True, False, True, False, False]


def candidates(spark, rows):
    names = [c.strip().split(" ")[0] for c in CANDIDATE.split(", ")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], CANDIDATE)
    return shaped(df)


def test_validation_and_trust(spark):
    from ocelli.catalogue import target_rows

    rows = [
        {"_ord": 1, "stream_url": "https://a.example/1.m3u8", "scope_status": "in_scope", "lat": 1.0, "lon": 1.0, "target_id": "t0"},
        {"_ord": 2, "stream_url": "https://a.example/2.jpg", "scope_status": "in_scope", "lat": 1.0, "lon": 1.0, "target_id": "t0"},
        {"_ord": 3, "stream_url": "https://a.example/3.m3u8", "scope_status": "review", "lat": 1.0, "lon": 1.0, "target_id": "t0"},
        {"_ord": 4, "stream_url": "https://a.example/4.m3u8", "scope_status": "in_scope", "target_id": "t0"},
        {"_ord": 5, "stream_url": "https://a.example/5.m3u8", "scope_status": "in_scope", "lat": 1.0, "lon": 1.0, "target_id": "t2"},
        {"_ord": 6, "stream_url": "https://a.example/6.m3u8", "scope_status": "in_scope", "lat": 1.0, "lon": 1.0, "target_id": "t0"},
    ]
    ok = {"http_status": 200, "body": "#EXTM3U\na.ts"}
    probes = [
        {"stream_url": "https://a.example/1.m3u8", "sample": 1, **ok},
        {"stream_url": "https://a.example/2.jpg", "sample": 1, "http_status": 200, "content_type": "image/jpeg", "body_sha": "x"},
        {"stream_url": "https://a.example/2.jpg", "sample": 2, "http_status": 200, "content_type": "image/jpeg", "body_sha": "y"},
        {"stream_url": "https://a.example/4.m3u8", "sample": 1, **ok},
        {"stream_url": "https://a.example/5.m3u8", "sample": 1, **ok},
    ]
    df, pr = candidates(spark, rows), spark.createDataFrame(probes, trust.PROBE)
    done = {r._ord: (r.validation_status, r.trust_level) for r in trust.validated(df, pr).collect()}
    assert done == {1: ("active_live_unknown", "trusted"), 2: ("active_image_snapshot_refreshing", "trusted"), 3: (None, "untrusted"), 4: ("active_live_unknown", "trusted"), 5: ("active_live_unknown", "trusted"), 6: ("dead_link", "rejected")}
    out = trust.validated(df, pr)
    good = trust.trusted(out, target_rows(spark))
    assert {r._ord for r in good.collect()} == {1, 2}
    assert {r._ord for r in trust.for_review(out, good).collect()} == {3, 5, 6}
    off = {r.validation_status for r in trust.validated(df, pr, enabled=False).collect()}
    assert off == {"not_validated"}
    full = {r._ord: r.validation_status for r in trust.validated(df, pr.withColumn("segment_status", F.lit(404)), check_segments=True).collect()}
    assert full[1] == "active_playlist_dead_segments"
    assert trust.tallies(out).first().live == 4


def test_advisory_review(spark):
    from ocelli.catalogue import target_rows

    rows = [{"candidate_id": k, "_ord": k, "stream_url": f"u{k}", "scope_status": s, "trust_level": tr, "lat": lat, "lon": lat, "target_id": "t0"} for k, (s, tr, lat) in enumerate([("out_of_scope", "rejected", 1.0), ("review", "untrusted", 1.0), ("unknown", "untrusted", None), ("review", "untrusted", None), ("unknown", "untrusted", None)])]
    answers = [(0, 1, "in_scope", 0.9, "x"), (1, 1, "out_of_scope", 0.9, ""), (1, 2, "in_scope", 0.2, ""), (2, 1, "in_scope", 0.9, ""), (3, 1, "out_of_scope", 0.7, "")]
    out = trust.reviewed(candidates(spark, rows), spark.createDataFrame(answers, "candidate_id long, _ord int, decision string, confidence double, reason string"), target_rows(spark), spark.createDataFrame([(4,)], "candidate_id long"))
    assert {r.candidate_id: r.scope_status for r in out.collect()} == {0: "out_of_scope", 1: "in_scope", 2: "review", 3: "review", 4: "review"}


def test_enrichment_precedence(spark):
    from ocelli.catalogue import target_rows

    rows = [
        {"candidate_id": 1, "_ord": 1, "stream_url": "https://a.example/1.jpg", "metadata": {"latitude": "10.5", "longitude": "20.5"}, "target_id": "t0"},
        {"candidate_id": 2, "_ord": 2, "stream_url": "https://a.example/2.jpg?lat=1.5&lon=2.5", "target_id": "t0"},
        {"candidate_id": 3, "_ord": 3, "stream_url": "https://a.example/mainst.m3u8", "location_text": "Main St at 5th", "target_id": "t0"},
        {"candidate_id": 4, "_ord": 4, "stream_url": "https://a.example/oakave.m3u8", "target_id": "t0"},
        {"candidate_id": 5, "_ord": 5, "stream_url": "https://a.example/elm.m3u8", "lat": 1.0, "lon": 1.0, "coordinate_source": "proximity_text", "target_id": "t0"},
        {"candidate_id": 6, "_ord": 6, "stream_url": "https://a.example/far.m3u8", "location_text": "Far Rd", "target_id": "t0"},
    ]
    geo = [("Main St at 5th, Place 0, Land, Region, Land", 3.0, 4.0, "Main"), ("Oak Ave, Place 0, Land, Region", 5.0, 6.0, "Oak Avenue"), ("Elm, Place 0, Land, Region", 20.0, 20.0, "Elm"), ("Far Rd, Place 0, Land, Region, Land", 80.0, 0.0, "Far")]
    inferred = [(4, 1, "Oak Ave", [], ["oakave"], 0.9, "road"), (4, 2, "Low", [], ["oakave"], 0.1, "road"), (5, 3, "Elm", [], ["elm"], 0.8, "road")]
    out = scope.enriched(candidates(spark, rows), target_rows(spark), spark.createDataFrame(geo, "query string, lat double, lon double, display_name string"), 10, inferred=spark.createDataFrame(inferred, "candidate_id long, _ord int, query string, variants array<string>, evidence array<string>, confidence double, precision string"), inference_limit=10)
    got = {r.candidate_id: (r.lat, r.coordinate_source) for r in out.collect()}
    assert got == {1: (10.5, "candidate_metadata"), 2: (1.5, "candidate_metadata"), 3: (3.0, "candidate_geocoder"), 4: (5.0, "llm_url_location_nominatim"), 5: (1.0, "proximity_text"), 6: (None, None)}
    flags = {r.candidate_id: r for r in out.collect()}
    assert flags[5].conflict_km > 1000 and "candidate_geocode_outside_verified_target_bbox" in flags[6].reasons
    none = scope.enriched(candidates(spark, rows), target_rows(spark), spark.createDataFrame(geo, "query string, lat double, lon double, display_name string"), 0)
    assert {r.candidate_id for r in none.collect() if r.lat is not None} == {1, 2, 5}


def test_scopes(spark):
    from ocelli.catalogue import target_rows

    pts = [(1, "t0", 0.0, 0.0), (2, "t0", 50.0, 0.0), (3, "t1", 40.0, 40.0), (4, "t1", 10.0, 10.0), (5, "t2", 1.0, 1.0), (6, "t0", None, None), (7, "t0", 30.0, 90.0)]
    df = candidates(spark, [{"_ord": k, "stream_url": "u", "target_id": t, "lat": a, "lon": b} for k, t, a, b in pts])
    got = {r._ord: (r.scope_status, r.trust_level) for r in scope.scoped(df, target_rows(spark)).collect()}
    assert got == {1: ("in_scope", "untrusted"), 2: ("out_of_scope", "rejected"), 3: ("in_scope", "untrusted"), 4: ("out_of_scope", "rejected"), 5: ("review", "untrusted"), 6: ("unknown", "untrusted"), 7: ("in_scope", "untrusted")}


def test_evidence(spark):
    rows = [{"_ord": 1, "stream_url": "https://m.example/playlist.m3u8", "lat": 1.0, "lon": 1.0, "metadata": {"json_endpoint_url": "https://m.example/MapServer", "camera_id": "7", "direction": "N"}}, {"_ord": 2, "stream_url": "https://m.example/x"}]
    got = {r._ord: r.evidence for r in E.with_candidate_evidence(candidates(spark, rows)).collect()}
    assert got[1].score >= 75 and got[1].band == "very_strong" and got[1].protocol.protocol_label == "hls"
    assert got[2].score == 0 and got[2].band == "none" and got[2].reasons == []
    labels = column(spark, E.protocol(F.col("v"))["protocol_label"], ["rtsp://x", "https://x/a.mpd", "https://x/whep", "https://x/live", "https://x/a.png", "https://x/y"])
    assert labels == ["rtsp", "dash", "webrtc", "unknown_stream", "image_snapshot", "unknown"]


def test_priority(spark):
    rows = [{"_ord": 1, "stream_url": "https://a/1.jpg", "scope_status": "out_of_scope", "lat": 1.0, "lon": 1.0}, {"_ord": 2, "stream_url": "https://a/2.m3u8"}, {"_ord": 3, "stream_url": "https://a/3.m3u8", "scope_status": "in_scope", "lat": 1.0, "lon": 1.0}, {"_ord": 4, "stream_url": "https://a/4"}, {"_ord": 5, "stream_url": "https://a/5", "discovery_method": "harvest_handoff"}]
    out = rank.prioritized(candidates(spark, rows).withColumn("camera_evidence_score", F.lit(0)))
    assert [(r._ord, r.priority_bucket) for r in out.collect()] == [(3, 0), (2, 3), (5, 4), (1, 5), (4, 6)]
    assert [r.candidate_priority_bucket for r in summarize.buckets(out).collect()] == [b for k, b in enumerate(rank.BUCKETS) if k in (0, 3, 4, 5, 6)]


def test_targets():
    two = targets.intents("traffic cameras from California and West Virginia")
    assert [(t["canonical_target"], t["admin_region"], t["scope_type"], t["camera_type"]) for t in two] == [("California", "California", "state", "traffic"), ("West Virginia", "West Virginia", "state", "traffic")]
    (one,) = targets.intents("weather webcams near Lane County", '```json\n{"targets":[{"canonical_target":"weather_cameras","country":"Land"}]}\n```')
    assert one["canonical_target"] == "Lane County" and one["country"] == "Land" and one["scope_type"] == "county"
    assert targets.geocoder_queries(one)[:2] == ["Lane County", "Lane"]
    assert targets.type_only("traffic_cameras") and not targets.type_only("traffic in Ohio") and targets.json_object("no") is None


def test_resolution(spark):
    rows = [
        ("a", 1, "Ohio, Land", "administrative", 40.0, -82.0, (38.0, 42.0, -85.0, -80.0), "state"),
        ("a", 2, "Ohio Street, Land", "road", 40.0, -82.0, (38.0, 42.0, -85.0, -80.0), "state"),
        ("b", 3, "Monument, Land", "monument", 1.0, 2.0, (1.0, 1.0001, 2.0, 2.0001), "place"),
        ("c", 4, "Point, Land", "x", 1.0, 2.0, None, "place"),
    ]
    df = spark.createDataFrame([(*r, None, "Land", "x", "", "", None) for r in rows], f"target_id string, _ord int, display_name string, result_type string, lat double, lon double, bbox struct<min_lat:double,max_lat:double,min_lon:double,max_lon:double>, scope_type string, admin_region string, country string, place_name string, raw_class string, raw_type string, polygons {scope.POLYGONS}")
    ranked = targets.scored(df)
    assert {r._ord: (r.score, r.rejected) for r in ranked.collect()} == {1: (50.0, False), 2: (50.0, True), 3: (50.0, False), 4: (15.0, False)}
    asked = spark.createDataFrame([(t, None) for t in "abcd"], "target_id string, llm_bbox struct<min_lat:double,max_lat:double,min_lon:double,max_lon:double>")
    got = {r.target_id: (r.geometry_status, r.geometry_source, r.trust_policy, r.bbox_padding_applied) for r in targets.resolved(ranked, asked, validation=True, fast=False).collect()}
    assert got["a"] == ("verified", "nominatim_bbox", "trusted_allowed", False) and got["b"][1:] == ("geocoder_padded", "trusted_allowed", True)
    assert got["c"][:3] == ("unverified_review_only", "generic_point_bbox", "stop") and got["d"][0] == "missing"
    moved = trust.refereed(ranked.withColumns({"query_id": F.lit(1), "index": F.col("_ord")}), spark.createDataFrame([(1, 1, 1, "accept", 1.0), (1, 2, 1, "accept", 1.0)], "query_id int, index int, _ord int, recommendation string, confidence double"))
    assert {r._ord: r.score for r in moved.collect()}[1] == 65.0 and {r._ord: r.score for r in moved.collect()}[2] == 50.0


def test_source_rows(spark):
    from ocelli.catalogue import target_rows

    reg = registry.parse("# Sources\n|name|url|type|\n|-|-|-|\n|S|https://s.example/|site|\n|P|https://p.example/cameras|page|\n|B|https://b.example|page|\n")
    rows = R.entry_rows(reg.frame(spark), target_rows(spark).filter("target_id = 't0'"), "directory", [Rule("b.example")])
    urls = [r.url for r in rows.orderBy("_ord").collect()]
    assert urls[0].startswith("https://s.example/cameras/land/") and urls[-2:] == ["https://s.example/", "https://p.example/cameras"]
    good, bad = R.selected(rows.filter("source_kind = 'page'"), [Rule("p.example", "x")], 3)
    assert good.count() == 0 and bad.first().blocked_reason == "x"
    good, _ = R.selected(rows.filter("source_kind = 'page'"), [], 3)
    assert [r.url for r in good.orderBy("_ord").collect()] == ["https://p.example/cameras", "https://p.example/cameras?page=2", "https://p.example/cameras?page=3"]
    seeds = R.seed_entries(spark, ["https://x.example/a.m3u8", "https://x.example/b"])
    assert [r.source_type for r in seeds.orderBy("entry_ord").collect()] == ["direct_hls", "page"]


def test_queries():
    q = R.harvest_queries("Ohio traffic", 12)
    assert len(q) == 12 and q[0] == "Ohio traffic" and sum("site:.gov" in x for x in q) == 4
    t = R.target_queries("Ohio", "weather", 9, ["dot.example.gov"], 6)
    assert t[0] == "Ohio weather cameras" and not any("site:" in x for x in t[:9]) and any("site:dot.example.gov" in x for x in t)
    assert R.official_queries("traffic", " ") == [] and len(R.official_scoped_queries("tourism", "X", 5)) <= 5


def test_search_pages(spark):
    ddg = '<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2F1">One</a> text</div><a href="/settings">x</a><h2><a href="https://b.example/2#f">Two</a></h2>'
    bing = '<ol id="b_results"><li class="b_algo"><h2><a href="https://c.example/3">Three</a></h2></li></ol><a href="https://www.bing.com/x">no</a>'
    df = spark.createDataFrame([("q", "ddg", ddg), ("q", "bing", bing)], "query string, search_engine string, body string")
    got = {(r.search_engine, r.url, r.title) for r in search.parse_pages(df).collect()}
    assert got == {("ddg", "https://a.example/1", "One"), ("ddg", "https://b.example/2", "Two"), ("bing", "https://c.example/3", "Three")}
    js = spark.createDataFrame([("q", '{"results":[{"url":"https://a.example/1","title":"A","content":"c"},{"url":"https://a.example/1#x"},{"url":"javascript:1"}]}')], "query string, body string")
    both = search.parse_pages(df).unionByName(search.parse_json(js))
    merged = {r.url: r for r in merge.merge_search_rows(both.withColumn("_ord", F.monotonically_increasing_id())).collect()}
    assert merged["https://a.example/1"].source_provider == "blind:multi" and set(merged["https://a.example/1"].search_engines) == {"ddg", "searxng"}
    assert search.diagnostics(both).count() == 3


def test_promoted_hosts(spark):
    from ocelli.catalogue import target_rows

    rows = candidates(spark, [{"_ord": k, "stream_url": f"https://cdn.example/{k}.m3u8", "target_id": "t0"} for k in range(4)])
    known = spark.createDataFrame([("https://cdn.example/cameras",)], "url string")
    out = [r.url for r in R.promoted_hosts(rows, target_rows(spark), known, []).orderBy("_ord").collect()]
    assert out[0] == "https://cdn.example" and "https://cdn.example/cameras" not in out and len(out) > 5


def test_progress_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    lines = [progress.line("validation", target_id="t", processed=k, total=10, live=k) for k in (1, 5, 3)]
    (tmp_path / "log" / "a.txt").write_text("\n".join(["noise", *lines]) + "\n")
    q = progress.latest(progress.events(spark, str(tmp_path / "log"))).writeStream.outputMode("update").format("memory").queryName("progress_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.processed, r.decile) for r in spark.sql("select * from progress_test").collect()] == [(5, 5)]


def test_windowed_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.select("ts", "event_type").write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "ev"))
    q = progress.windowed(stream, "ts", "1 day", "1 day", "event_type").writeStream.outputMode("complete").format("memory").queryName("windows_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from windows_test").first()[0] == events.count()


def test_refreshed_samples(spark):
    rows = [("u", 1, "a", None, "x"), ("u", 2, "a", None, "x"), ("u", 3, "b", None, "x")]
    df = spark.createDataFrame(rows, "stream_url string, sampled_at int, etag string, last_modified string, body_sha string")
    assert [r.refreshed for r in progress.refreshed(df).orderBy("sampled_at").collect()] == [False, True]


def test_a_canonical_url_is_cut_once(spark):
    """Each pattern stands in the plan once, however often its parts are named."""
    plan = spark.createDataFrame([("u",)], "u string").select(U.canonical(F.col("u")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("m3u8") == 1 and plan.count("u002[Ff]") == 1


def test_crowded_urls_are_not_sorted_whole(spark, monkeypatch):
    """What is dealt by ranges are orders and states; few rows of a crowd are read whole."""
    kept = {}

    class Kept(merge.Stage):
        def __call__(self, df, name):
            kept[name] = super().__call__(df, name)
            return kept[name]

        def free(self, keep=0):
            pass

    monkeypatch.setattr(merge, "Stage", Kept)
    df = spark.createDataFrame(crowd_rows(3, 1_000, ["https://h.example/a.jpg", "https://h.example/b.jpg"]), "_ord long, stream_url string, title string, location_text string, lat double, lon double, metadata map<string,string>")
    assert merge.fold_candidates(df, crowd=100).count() == 2
    assert set(kept["fold-states"].columns) == {"_g", "_ord", "_s", "_u", "_part"} and kept["fold-states"].count() == 1_000
    assert kept["fold-read"].count() < 30

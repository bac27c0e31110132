"""Playlists from one sort against lists made one by one, and endpoints in rounds against a walk over the links."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ocelli.operators import sinks
from ocelli.operators.policy import Rule
from ocelli.plans.harvest import HarvestConfig, reached

ROWS = "playlist string, _ord long, stream_url string, title string, location_text string, metadata map<string,string>"
NAMES = ("hls_candidates", "trusted_media", "image_snapshots", "rtsp_candidates")


def files(path):
    """Name and lines of each list; the pieces of a list in the order of their names."""
    out, pieces = {}, {}
    for name in sorted(os.listdir(path)):
        own = sorted(f for f in os.listdir(f"{path}/{name}") if f.startswith("part"))
        pieces[name] = len(own)
        out[name] = [line for f in own for line in open(f"{path}/{name}/{f}").read().splitlines()]
    return out, pieces


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_lists_from_one_sort(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(sinks, "ONE_FILE", most)
    rng = random.Random(3)
    rows = [(rng.choice(["hls_candidates"] * 8 + ["trusted_media", "image_snapshots", "unasked"]), k, f"https://m.example/{k}", rng.choice([f"cam {k}", 'a "b"\n c', "", None]), None, {}) for k in rng.sample(range(10_000), 120)]
    df = spark.createDataFrame(rows, ROWS)
    made = df.withColumn("_ord", F.struct("_ord")) if most == 20 else df
    assert sinks.write_playlists(made, str(tmp_path / "x"), NAMES, "g") == {n: sum(r[0] == n for r in rows) for n in NAMES}
    got, pieces = files(tmp_path / "x")
    want = {}
    for n in NAMES:
        own = sorted(r for r in rows if r[0] == n)
        want[f"{n}.txt"] = [r[2] for r in own]
        if n not in sinks.TEXT_ONLY:
            title = lambda r: " ".join((r[3] or r[2]).replace('"', "'").split())
            want[f"{n}.m3u"] = ["#EXTM3U"] + [v for r in own for v in (f'#EXTINF:-1 tvg-name="{title(r)}" group-title="g",{title(r)}', r[2])]
    assert got == want
    assert (pieces["hls_candidates.m3u"] > 1) == (most == 20) and max(v for k, v in pieces.items() if len(got[k]) <= most) == 1
    sinks.write_playlists(made.limit(0), str(tmp_path / "x"), NAMES)  # again, over the former ones, with nothing
    assert files(tmp_path / "x")[0] == {k: ["#EXTM3U"] if k.endswith("m3u") else [] for k in want}


def test_jobs_do_not_grow_with_the_lists(spark, tmp_path):
    def jobs(names):
        group = f"lists-{len(names)}"
        spark.sparkContext.setJobGroup(group, group)
        rows = spark.createDataFrame([(n, k, f"u{k}", "t", None, {}) for n in names for k in range(3)], ROWS)
        sinks.write_playlists(rows, str(tmp_path / group), names)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(tuple(f"l{k}" for k in range(12))) == jobs(("l0", "l1"))


PAYLOADS = "_ord long, page_url string, payload_url string, content_type string, body string, source_provider string, source_name string"


def payloads(spark, links):
    at = "https://h.example/api/{}".format
    page = lambda to: "<html>" + "".join(f"<a href='/api/{n}'>x</a>" for n in to) + "</html>"
    return spark.createDataFrame([(k, at(n), at(n), "text/html", page(to), None, None) for k, (n, to) in enumerate(links)], PAYLOADS)


def walked(seeds, links, rounds):
    """URL, depth, page that it was found on."""
    seen, new, out = {s.lower() for s in seeds}, {s.lower() for s in seeds}, {}
    for depth in range(1, rounds + 1):
        found = {}
        for n, to in links:
            if n.lower() in new:
                for x in to:
                    if x.lower() not in seen:
                        found.setdefault(x.lower(), (x, depth, n))
        out |= found
        new = set(found)
        seen |= new
    return sorted(out.values())


@pytest.mark.parametrize("rounds", [1, 2, 5])
def test_rounds_against_a_walk(spark, rounds):
    rng = random.Random(rounds)
    links = [(f"n{k}", [rng.choice(["n0", f"n{rng.randrange(60)}", f"N{k + 1}", f"gone{k}"]) for _ in range(3)]) for k in range(50)]
    links.append(("hot", [f"n{k}" for k in range(0, 60, 7)]))
    links.append(links[4])  # a payload twice
    got = reached(spark.createDataFrame([("https://h.example/api/hot",), ("https://H.example/API/n9",), (None,)], "url string"), payloads(spark, links), HarvestConfig(), rounds)
    own = lambda u: u.rsplit("/", 1)[1]
    assert sorted((own(r.endpoint_url), r.depth, own(r.found_on)) for r in got.collect()) == walked(["hot", "n9"], links, rounds)
    fetched = {n.lower() for n, _ in links}
    assert all(r.fetched == (own(r.endpoint_url).lower() in fetched) for r in got.collect())


def test_rounds_end_in_circles_and_at_blocks(spark):
    start = spark.createDataFrame([("https://h.example/api/a",)], "url string")
    links = [("a", ["b", "a"]), ("b", ["a", "c"]), ("c", ["b"])]
    ends = lambda rules: sorted((r.endpoint_url[-1], r.depth) for r in reached(start, payloads(spark, links), HarvestConfig(rules=rules), 50).collect())
    assert ends([]) == [("b", 1), ("c", 2)]
    assert ends([Rule("h.example")]) == []
    none = reached(start.limit(0), payloads(spark, links), HarvestConfig())
    assert none.columns == ["endpoint_url", "depth", "found_on", "fetched"] and none.isEmpty()
    with pytest.raises(ValueError):
        reached(start, payloads(spark, links), HarvestConfig(), 0)

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ocelli.llm import components, forest

from .conftest import altered, prose


def brute(rows, width, percent):
    """Component of each row by comparing all pairs of sets."""
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    low = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        low[root(k)].append((i is None, i))
    return sorted(((i, len(s), min(low[root(k)])[1] if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def test_odd_rows_match_all_pairs(odd, odd_rows):
    for width, percent in ((3, 85), (5, 80)):
        assert got(forest.report(odd, width, percent)) == brute([(r[0], r[1]) for r in odd_rows], width, percent)


def test_empty_table(none):
    assert forest.report(none).collect() == []


@pytest.fixture(scope="module")
def family(spark, tmp_path_factory):
    """A large group of near copies, some far from all others, among unrelated texts."""
    r = np.random.default_rng(4)
    base = prose(1000, 150)
    rows = []
    for k in range(420):
        t = base
        for at in r.choice(150, r.choice([0, 1, 2, 4, 7, 12]), replace=False):
            t = altered(t, int(at), f"w{r.integers(0, 10**6)}")
        rows.append((int(k * 3 + 1), t))
    rows += [(int(k * 3 + 2), prose(2000 + k, int(r.integers(1, 80)))) for k in range(200)]
    path = str(tmp_path_factory.mktemp("family"))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.mode("overwrite").parquet(path)
    return rows, spark.read.parquet(path)


def test_large_groups_match_all_pairs(family):
    rows, docs = family
    assert got(forest.report(docs, 3, 85)) == brute(rows, 3, 85)


def test_one_row_of_each_class_stays(family, odd):
    rows, docs = family
    kept = sorted(r.doc_id for r in forest.keep_first(docs, 5, 80).collect())
    assert kept == sorted({c for _, _, c in brute(rows, 5, 80)})
    out = forest.keep_first(odd)
    assert out.columns == odd.columns
    texts = [r.text for r in out.collect()]
    assert sum(t == "one" for t in texts) == 1 and texts.count(None) == 1


def test_signatures_estimate_similarity():
    r = np.random.default_rng(2)
    pool = r.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    sig = forest.signatures(np.concatenate((a, b)), np.array([2000, 2000]))
    assert abs((sig[0] == sig[1]).mean() - 1500 / 2500) < 0.15


def test_components(spark):
    edges = [(5, 6), (6, 7), (1, 2), (9, 9), (2, 3), (7, 8), (8, 4)] + [(100 + k, 101 + k) for k in range(60)]
    rows = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    label = {r.node: r.label for r in rows}
    assert len(rows) == len(label)
    assert {label[k] for k in (4, 5, 6, 7, 8)} == {4} and {label[k] for k in (1, 2, 3)} == {1}
    assert {label[k] for k in range(100, 161)} == {100}


def crowd_rows(n, pendants, chain, seed=6):
    """Near copies of one text, texts that hang on only one of them, and a chain that leads away from it, shuffled."""
    r = np.random.default_rng(seed)
    base, rows = prose(5000, 200).split(), []

    def changed(words, k):
        out = list(words)
        for at in r.choice(len(out), k, replace=False):
            out[at] = f"x{r.integers(0, 10**9)}"
        return out

    for _ in range(n):
        rows.append(changed(base, int(r.choice([1, 2, 3, 5]))))
    for _ in range(pendants):
        rows.append(changed(rows[int(r.integers(0, n))], int(r.choice([3, 4, 5]))))
    at = rows[0]
    for _ in range(chain):
        at = changed(at, 4)
        rows.append(at)
    order = r.permutation(len(rows))
    return [(int(7 * k + 3), " ".join(rows[i])) for k, i in enumerate(order)]


def by_matrix(rows, width, percent):
    """As ``brute``, by a matrix of the shingles that rows share."""
    sets = [{" ".join(w[k : k + width]) for k in range(len(w) - width + 1)} for w in (t.split() for _, t in rows)]
    count = defaultdict(int)
    for s in sets:
        for x in s:
            count[x] += 1
    place = {x: k for k, x in enumerate(x for x, c in count.items() if c > 1)}
    m = np.zeros((len(rows), len(place)), np.float32)
    for k, s in enumerate(sets):
        m[k, [place[x] for x in s if x in place]] = 1
    size = np.array([len(s) for s in sets])
    common = m @ m.T
    a, b = np.nonzero(100 * common >= percent * (size[:, None] + size - common))
    low = np.array([i for i, _ in rows])
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        if (new == low).all():
            return sorted(((i, len(s), int(c)) for (i, _), s, c in zip(rows, sets, low)), key=repr)
        low = new


def test_block_keys_and_bounds():
    label = np.zeros((5000, forest.LABEL), np.uint8)
    label[:, 4] = np.random.default_rng(1).integers(0, 40, 5000)
    label = label[np.argsort(label[:, 4], kind="stable")]
    pieces = list(forest._packed(label, np.arange(5000), 3))
    assert max(map(len, pieces)) <= forest.BLOCK_NODES and set(np.concatenate(pieces)) == set(range(5000))
    keys = {int(forest._block_key(5, np.int32(t), k)) for t in range(forest.TREES) for k in range(200)}
    assert len(keys) == forest.TREES * 200  # trees don't share blocks


@pytest.mark.parametrize("n,pendants,chain", [(1200, 500, 300), (0 + 200, 900, 100)])
def test_crowds_lose_no_link(spark, tmp_path, n, pendants, chain):
    rows = crowd_rows(n, pendants, chain)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/d")
    assert got(forest.report(spark.read.parquet(f"{tmp_path}/d"), 3, 85)) == by_matrix(rows, 3, 85)


def test_only_regions_that_a_task_cuts_stay_open():
    """Batches are cut between regions, so they open none; a task's first and last region may go on elsewhere."""
    r = np.random.default_rng(7)
    n, depth = 600, 2
    label = np.sort(r.integers(0, 40, n)).astype(np.uint8)
    rows = [bytes([x, 0, *r.integers(0, 256, forest.LABEL - 2)]) for x in label]
    sigs = [bytes(r.integers(0, 256, forest.COMPONENTS).astype(np.uint8)) for _ in range(n)]
    for size in (7, 50, 600):
        batches = [pa.RecordBatch.from_arrays([pa.array([0] * len(rows[i : i + size]), pa.int32()), pa.array(rows[i : i + size], pa.binary()), pa.array(range(i, min(n, i + size)), pa.int64()), pa.array(sigs[i : i + size], pa.binary())], ["tree", "label", "node", "sig"]) for i in range(0, n, size)]
        found = [x for b in forest._grower(forest.COMPONENTS, depth)(iter(batches)) for x in b.to_pylist() if x["kind"] == 1]
        assert {x["node"] for x in found} == set(np.flatnonzero((label == label[0]) | (label == label[-1])))

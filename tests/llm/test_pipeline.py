import pytest

import corpus_pipeline
from ocelli.llm import queries

from .conftest import altered, prose
from .test_forest import brute as brute_classes


def test_stages_on_the_driver_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "mixture"]
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == [*docs.columns, "taken"]
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert ids and len(ids) == len(set(ids)) and set(ids) <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert not [t for (t,) in out.select("text").collect() if "AKIA" in t or "password=" in t]


def test_all_queries_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


BRUTE = "doc_id long, text string, lang string, source string, n_chars long, taken long"


def stages_by_hand(spark, sf_dir, docs):
    """Rows after each of the stages that have a plain definition, from their definitions: one of each class, no window, secrets masked."""
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = docs.sparkSession.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
        out[name] = [r.asDict() for r in docs.collect()]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with nulls in every column, empty and long texts, repeats, copies, leaks and secrets; columns with clashing names."""
    top = str(tmp_path_factory.mktemp("tables"))
    leak = prose(77, 14)
    rows = [(k, prose(k, 40 + k % 9), "en", f"s{k % 3}", 9, 1) for k in range(40)]
    rows += [(100 + k, altered(rows[k][1], 20), "de", "s1", 9, None) for k in range(5)]
    rows += [(200, prose(300, 20) + " " + leak + " " + prose(301, 20), "en", "s0", 9, 1), (201, "token=abcdefgh12345 and " + prose(302, 30), "en", None, 9, 1)]
    rows += [(300, None, None, None, None, None), (301, "", "en", "s0", 0, 0), (None, prose(303, 30), "en", "s0", 9, 1), (5, rows[5][1], "en", "s2", 9, 1), (302, prose(304, 9000), "fr", "s2", 9, 1)]
    spark.createDataFrame(rows, BRUTE).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([("b1", leak), ("b2", None), ("b3", "")], "item_id string, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(None, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top, rows, leak


def test_stages_match_their_definitions(spark, folder):
    top, rows, leak = folder
    docs = spark.read.parquet(f"{top}/documents.parquet")
    out = stages_by_hand(spark, top, docs)
    ids = lambda name: sorted((r["doc_id"] for r in out[name]), key=repr)
    # All labels are good, so no row is rejected.
    assert ids("quality") == sorted((r[0] for r in rows), key=repr)
    first = brute_classes([(r["doc_id"], r["text"]) for r in out["quality"]], 5, 80)
    expected = sorted([c for i, n, c in first if n and i == c and (i != 5)] + [5] + [i for i, n, _ in first if not n], key=repr)
    assert ids("near_duplicates") == expected
    clean = [r for r in out["near_duplicates"] if leak not in (r["text"] or "")]
    assert ids("decontaminate") == sorted((r["doc_id"] for r in clean), key=repr) and 200 not in ids("decontaminate")
    assert ids("secrets") == ids("decontaminate")
    masked = {r["doc_id"]: r["text"] for r in out["secrets"]}
    plain = {r["doc_id"]: r["text"] for r in out["decontaminate"]}
    assert masked[201].startswith("[SECRET] and") and {k: v for k, v in masked.items() if k != 201} == {k: v for k, v in plain.items() if k != 201}
    # The mixture takes half as many words again as there are, up to twice a row's size, under a name that doesn't clash.
    size = {k: len((v or "").split()) for k, v in masked.items()}
    taken = {r["doc_id"]: r["taken_words"] for r in out["mixture"]}
    assert all(0 < v <= 2 * size[k] for k, v in taken.items()) and abs(sum(taken.values()) - 1.5 * sum(size.values())) <= 1
    assert [*out["mixture"][0]] == [*docs.columns, "taken_words"]


def test_empty_tables(spark, folder, tmp_path):
    top = folder[0]
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{top}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

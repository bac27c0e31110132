import numpy as np
import pytest

from ocelli.llm import tokencounts as T


@pytest.fixture(scope="module")
def encoder():
    with open(T.VOCABULARY, "rb") as f:
        return T.Encoder(f.read())


@pytest.mark.parametrize("text", ["plain text here", "naïve — 日本語 \U0001f600 ok", "a\nb\n\nc", "x" * 3000])
def test_spans_cover_the_text(encoder, text):
    begin, end, size = encoder.spans(text)
    assert size == len(text) and begin[0] == 0 and end[-1] == len(text)
    assert (begin < end).all() and (begin[1:] <= end[:-1]).all()
    ids = encoder.encoding.encode_ordinary(text)
    for i, a, b in zip(ids, begin, end):
        assert text[a:b].encode().find(encoder.encoding.decode_single_token_bytes(i)) >= 0


def brute(begin, end, first, last, rule):
    out = np.zeros(len(first))
    for a, b in zip(begin, end):
        own = np.array([sum(s <= c < e for c in range(a, b)) for s, e in zip(first, last)], float)
        if rule == "first":
            out[np.flatnonzero((first <= a) & (a < last))[0]] += 1
        elif rule == "most":
            out[int(np.argmax(own))] += 1
        else:
            out += own / own.sum()
    return out


@pytest.mark.parametrize("rule", ["first", "most", "share"])
@pytest.mark.parametrize("seed", range(6))
def test_allocation_matches_brute_force(rule, seed):
    r = np.random.default_rng(seed)
    edges = np.unique(np.concatenate(([0, 60], r.integers(1, 60, 14))))
    cuts = np.unique(np.concatenate(([0, 60], r.integers(1, 60, 9))))
    got, crossing = T.allocate(edges[:-1], edges[1:], cuts[:-1], cuts[1:], rule)
    assert np.allclose(got, brute(edges[:-1], edges[1:], cuts[:-1], cuts[1:], rule))
    assert crossing == sum(np.searchsorted(cuts, a, "right") < np.searchsorted(cuts, b - 1, "right") for a, b in zip(edges[:-1], edges[1:]))


def test_column(odd, odd_rows, none, encoder):
    for kind in ("lines", "sentences"):
        rows = T.count(odd, kind=kind).collect()
        assert len(rows) == len(odd_rows)
        for r in rows:
            assert sum(r.section_tokens) == r.n_tokens and len(r.section_ends) == r.n_sections
    by_id = {r.doc_id: r for r in rows}
    text = next(x[1] for x in odd_rows if x[0] == 15)
    assert by_id[15].n_tokens == len(encoder.encoding.encode_ordinary(text)) and by_id[15].n_chars == len(text)
    assert T.count(none).collect() == []


def test_given_ranges(spark):
    text = "Head line body text goes on"
    df = spark.createDataFrame([(1, text, [(0, 9), (10, 14)]), (2, text, None), (3, None, [(0, 5)]), (4, text, [(5, 5), (0, 200)])], "doc_id long, text string, r array<struct<s:int,e:int>>")
    rows = {r.doc_id: r for r in T.count(df, rule="share", ranges_col="r").collect()}
    assert abs(sum(rows[1].section_tokens) - (rows[1].n_tokens - 3 - 0.2)) < 1e-9 or sum(rows[1].section_tokens) < rows[1].n_tokens
    assert rows[2].n_sections == 0 and rows[3].section_tokens == [0.0]
    assert rows[4].section_tokens == [0.0, float(rows[4].n_tokens)]


def test_unknown_rule(odd):
    with pytest.raises(ValueError):
        T.count(odd, rule="last")

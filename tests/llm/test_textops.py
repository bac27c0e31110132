import re

import numpy as np
import pyarrow as pa

from ocelli.llm import textops as T

TEXTS = ["", None, "A b\tC", " lead", "trail ", "x", "\n\n", "a  b   c d e", "ÀB c d \x1f e"]


def test_words_match_the_definition():
    raw, offs = T.buffers(pa.array(TEXTS))
    h, doc, per = T.words(T.canonical(raw, offs, T.BLANKS))
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in TEXTS]
    assert per.tolist() == [len(w) for w in want]
    assert (h == T.hash_words([x for w in want for x in w])).all()
    assert doc.tolist() == [k for k, w in enumerate(want) for _ in w]


def test_words_of_a_slice_and_of_an_empty_array():
    raw, offs = T.buffers(pa.array(TEXTS)[2:4])
    assert T.words(T.canonical(raw, offs, T.BLANKS))[2].tolist() == [3, 1]
    raw, offs = T.buffers(pa.array([], pa.string()))
    assert list(T.blocks(offs)) == []


def test_shingle_sets_match_sets_of_tuples():
    r = np.random.default_rng(1)
    texts = [" ".join(r.choice(list("abc"), n)) for n in (0, 1, 2, 3, 4, 9, 30, 200)]
    raw, offs = T.buffers(pa.array(texts))
    h, _, per = T.words(T.canonical(raw, offs, T.BLANKS))
    for width in (3, 5):
        _, size = T.shingle_sets(h, per, width)
        for t, n in zip(texts, size):
            w = t.split()
            want = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
            assert n == len(want)


def test_alnum_words():
    text = "Don't STOP-me_now 42x é—ß"
    raw, offs = T.buffers(pa.array([text]))
    seq = T.canonical(raw, offs, T.ALNUM)
    assert bytes(seq[:-1]).decode().split(" ")[:-1] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))

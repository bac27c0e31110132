"""Token counts by section from one encoding of the whole document.

A document is encoded once, as a whole; byte lengths of its tokens give each
token a character span.  Spans are interval-joined with the sections of the same
document (two sorted lists, so by binary search), and a token that crosses a
boundary is allocated by an explicit rule:

- ``first``: to the section that holds its first character;
- ``most``: to the section that holds most of its characters, the earlier of equals;
- ``share``: to each in proportion to its characters.

Sections are lines or sentences, which cover the text, so that their counts add up
to the document's tokens; or a column of ``(start, end)`` character ranges, where
characters outside of all ranges have tokens of their own that no range counts.

Edge cases: a null or empty text has no tokens and no lines; ranges may be empty
or null; ids may be null or repeat.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how texts are cut before pairs are merged.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Encoder:
    def __init__(self, data: bytes, pattern: str = PATTERN) -> None:
        import tiktoken

        own = ranks(data)
        self.encoding = tiktoken.Encoding("ocelli", pat_str=pattern, mergeable_ranks=own, special_tokens={})
        self.length = np.zeros(max(own.values()) + 1, np.int64)
        for token, i in own.items():
            self.length[i] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """First character and end of each token (a token of part of a character covers it), and the characters."""
        raw = np.frombuffer(text.encode(), np.uint8)
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.length[ids])
        if len(raw) == len(text):
            return ends - self.length[ids], ends, len(text)
        char = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to each byte
        starts = ends - self.length[ids]
        return char[starts] - 1, char[ends - 1], len(text)


#: Where a section ends.
BREAKS = {"lines": re.compile(r"\n"), "sentences": re.compile(r"\n|[.!?]+(?:\x20|(?=\n))")}


def sections(text: str, kind: str = "lines") -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the lines or sentences, each with what ends it."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = [m.end() for m in BREAKS[kind].finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    ends = np.array(ends, np.int64)
    return np.concatenate(([0], ends[:-1])), ends


def allocate(begin: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str = "most") -> tuple[np.ndarray, int]:
    """Tokens of each section, and crossing tokens; sections ``first`` to ``last`` are sorted and cover all."""
    out = np.zeros(len(first))
    if not len(begin):
        return out, 0
    a = np.searchsorted(first, begin, "right") - 1
    b = np.maximum(a, np.searchsorted(first, end - 1, "right") - 1)
    whole = a == b
    out += np.bincount(a[whole], minlength=len(first))
    two = np.flatnonzero(b == a + 1)
    left, right = last[a[two]] - begin[two], end[two] - first[b[two]]
    share = left / np.maximum(1, left + right) if rule == "share" else np.ones(len(two)) if rule == "first" else (left >= right) * 1.0
    out += np.bincount(a[two], share, len(first)) + np.bincount(b[two], 1 - share, len(first))
    for i in np.flatnonzero(b > a + 1):
        over = np.arange(a[i], b[i] + 1)
        part = np.minimum(end[i], last[over]) - np.maximum(begin[i], first[over])
        if rule == "first":
            out[a[i]] += 1
        elif rule == "most":
            out[over[int(np.argmax(part))]] += 1
        else:
            out[over] += part / part.sum()
    return out, int((~whole).sum())


def covering(ranges: list, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted pieces that cover 0 to ``size``, and the range each is of (-1: none); where ranges overlap, the earlier one holds."""
    own = [(max(0, int(r[0])), min(size, int(r[1])), k) for k, r in enumerate(ranges) if r is not None and r[0] is not None and r[1] is not None]
    edges = sorted({0, size, *(x for a, b, _ in own if a < b for x in (a, b))})
    first, last, of = [], [], []
    for a, b in zip(edges, edges[1:]):
        first.append(a)
        last.append(b)
        of.append(min((k for s, e, k in own if s <= a and b <= e), default=-1))
    return np.array(first, np.int64), np.array(last, np.int64), np.array(of, np.int64)


def _counter(vocabulary, pattern: str, rule: str, kind: str, given: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                rows = []
                ranges = part.column(2).to_pylist() if given else None
                for k, text in enumerate(part.column(1).to_pylist()):
                    text = text or ""
                    begin, end, size = encoder.spans(text) if text else (np.zeros(0, np.int64),) * 2 + (0,)
                    if given:
                        own = [tuple(r.values()) if r else None for r in ranges[k] or []]
                        first, last, of = covering(own, size)
                        pieces, crossing = allocate(begin, end, first, last, rule)
                        tokens = np.bincount(of[of >= 0], pieces[of >= 0], len(own))
                        stops = [r[1] if r else None for r in own]
                    else:
                        first, last = sections(text, kind)
                        tokens, crossing = allocate(begin, end, first, last, rule)
                        stops = last.tolist()
                    rows.append((size, len(begin), len(tokens), crossing, stops, tokens.tolist()))
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], _FIELDS)

    return run


_SCHEMA = "doc_id long, n_chars long, n_tokens long, n_sections long, n_crossing long, section_ends array<long>, section_tokens array<double>"
_FIELDS = [x.split()[0] for x in _SCHEMA.split(", ")]


def count(docs: DataFrame, rule: str = "most", kind: str = "lines", vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text", ranges_col: str | None = None) -> DataFrame:
    """Columns of ``_SCHEMA`` for each row of ``docs``.

    The vocabulary file is read here and broadcast: its size is that of a public
    tokenizer, whatever the corpus.
    """
    if rule not in ("first", "most", "share") or kind not in BREAKS:
        raise ValueError(f"no such rule or sections: {rule}, {kind}")
    with open(vocabulary, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    own = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    if ranges_col:
        own.append(F.col(ranges_col).alias("ranges"))
    return docs.select(*own).mapInArrow(_counter(data, pattern, rule, kind, bool(ranges_col)), _SCHEMA)

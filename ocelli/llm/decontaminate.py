"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Both sides are lower-cased (A-Z) and cut into words.  A benchmark item gives one
window for each run of ``width`` consecutive words, or its whole sequence if it
is shorter.  Windows go into a hash table that is broadcast in blocks of at most
``BLOCK_WORDS`` item words: a benchmark beyond one block is scanned in several
passes over the training texts, so nothing that is broadcast grows with it.
Texts are scanned in whole; a window found by its hash is compared word by word
with the item's bytes before it counts.

Edge cases: a null or empty text has no words and no hits; an item without
words has no window; items may repeat and share windows (each counts); an empty
benchmark leaves every document clean; an empty table gives an empty result.  Rows
may repeat.  ``report`` reads the id and the text alone, and in ``clean`` all columns
travel under names of their own, so no name can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textops import ALNUM, END, SPACE, blocks, buffers, canonical, hash_words, rolling, words

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_WORDS = 2_000_000


class Windows:
    """The windows of some benchmark items."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.vocab: set[bytes] = set()
        self.found: dict[bytes, list] = defaultdict(list)
        self.words = 0

    def add(self, item, text: str | None) -> None:
        raw, offs = buffers(pa.array([text or ""]))
        seq = canonical(raw, offs, ALNUM)
        own = bytes(seq[:-1]).split(b" ")[:-1]
        if not own:
            return
        size = min(self.width, len(own))
        self.words += len(own)
        self.vocab.update(own)
        for k in range(len(own) - size + 1):
            items = self.found[b" ".join(own[k : k + size])]
            if not items or items[-1] != item:
                items.append(item)

    def table(self) -> dict:
        """Arrays to broadcast: word hashes, and for each window length its hashes, bytes and items."""
        by_length: dict[int, list[bytes]] = defaultdict(list)
        for w in self.found:
            by_length[w.count(b" ") + 1].append(w)
        lengths = {}
        for n, ws in by_length.items():
            h = np.array([rolling(hash_words(w.split(b" ")), n)[0] for w in ws], np.uint64)
            order = np.argsort(h)
            lengths[n] = (h[order], [ws[i] for i in order], [self.found[ws[i]] for i in order])
        return {"vocab": np.sort(hash_words(sorted(self.vocab))), "lengths": lengths}


def window_blocks(benchmark: DataFrame, width: int, item_col: str, text_col: str) -> Iterator[dict]:
    held = Windows(width)
    for item, text in benchmark.select(item_col, text_col).toLocalIterator():
        held.add(item, text)
        if held.words >= BLOCK_WORDS:
            yield held.table()
            held = Windows(width)
    yield held.table()


def scan(seq: np.ndarray, tables: dict) -> tuple[np.ndarray, list[tuple[int, int, list]], np.ndarray]:
    """Words per document of a canonical block; verified hits as (first word, words, items); hit words as a mask."""
    h, doc, per = words(seq)
    mask = np.zeros(len(h), bool)
    hits: list[tuple[int, int, list]] = []
    vocab = tables["vocab"]
    if not len(h) or not len(vocab):
        return per, hits, mask
    at = np.searchsorted(vocab, h)
    known = vocab[np.minimum(at, len(vocab) - 1)] == h
    place = np.arange(len(h))
    first = np.concatenate(([0], np.cumsum(per)))[:-1][doc]
    broken = np.maximum.accumulate(np.where(known, first, place + 1))
    run = place + 1 - broken  # known words in a row up to here, within the document
    stops = np.flatnonzero(seq == SPACE)
    for n, (hashes, texts, items) in tables["lengths"].items():
        last = np.flatnonzero(run >= n)
        if not len(last):
            continue
        begin = last - n + 1
        value = np.zeros(len(begin), np.uint64)
        # The same rolling hash as for items, only where all words are known.
        width = np.arange(n)
        for i in range(0, len(begin), 100_000):
            part = h[begin[i : i + 100_000, None] + width]
            value[i : i + 100_000] = _roll(part)
        where = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
        for b, w in zip(begin[hashes[where] == value], where[hashes[where] == value]):
            stop = stops[b + n - 1]
            text = texts[w]
            if stop >= len(text) and seq[stop - len(text) : stop].tobytes() == text:
                mask[b : b + n] = True
                hits.append((int(b), n, items[w]))
    return per, hits, mask


def _roll(part: np.ndarray) -> np.ndarray:
    n = part.shape[1]
    flat = np.ascontiguousarray(part).reshape(-1)
    return rolling(flat, n)[::n] if len(flat) else np.zeros(0, np.uint64)


def _scanner(tables):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_text")
            raw, offs = buffers(batch.column(at))
            n_words, spans, items = [], [], []
            old = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
            had = batch.column(batch.schema.get_field_index("_items")).to_pylist()
            for i, j in blocks(offs):
                seq = canonical(raw, offs[i : j + 1], ALNUM)
                per, hits, mask = scan(seq, tables.value)
                n_words.append(per)
                first = np.concatenate(([0], np.cumsum(per)))
                found: dict[int, set] = defaultdict(set)
                for b, _, its in hits:
                    found[int(np.searchsorted(first, b, "right")) - 1].update(its)
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                own: dict[int, list] = defaultdict(list)
                for b, e in edge.reshape(-1, 2):
                    # A run of hit words may go on in the next document.
                    d = int(np.searchsorted(first, b, "right")) - 1
                    while b < e:
                        stop = min(e, first[d + 1])
                        if stop > b:
                            own[d].append((int(b - first[d]), int(stop - first[d])))
                        b, d = stop, d + 1
                for d in range(j - i):
                    spans.append(_union((old[i + d] or []) + [x for s in own.get(d, ()) for x in s]))
                    items.append(sorted(set(had[i + d] or ()) | found.get(d, set())))
            cols = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            cols["_words"] = pa.array(np.concatenate(n_words) if n_words else [], pa.int64())
            cols["_spans"] = pa.array(spans, pa.list_(pa.int64()))
            cols["_items"] = pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return run


def _union(flat: list[int]) -> list[int]:
    """Joined spans of begin, end, begin, end, ..."""
    out: list[int] = []
    for b, e in sorted(zip(flat[::2], flat[1::2])):
        if out and b <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [b, e]
    return out


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, columns: tuple[str, ...] = ("doc_id",), text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Columns of ``docs`` with ``_text``, ``_words`` (its words), ``_spans`` (hit words: begin, end, ...) and ``_items`` (as strings, sorted)."""
    spark = docs.sparkSession
    out = docs.select(*[F.col(c) for c in columns], F.col(text_col).alias("_text")).withColumns({"_words": F.lit(0).cast("long"), "_spans": F.array().cast("array<long>"), "_items": F.array().cast("array<string>")})
    schema = out.schema
    for f in schema.fields:
        f.nullable = True
    source = benchmark.withColumn("_item", F.coalesce(F.col(item_col).cast("string"), F.lit("")))
    for k, block in enumerate(window_blocks(source, width, "_item", item_text)):
        if k:
            out = written(out, "decontaminate")
        out = out.mapInArrow(_scanner(spark.sparkContext.broadcast(block)), schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for each row of ``docs``."""
    found = hits(docs, benchmark, width).drop("_text")
    spans = F.aggregate("_spans", F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("g")), lambda a, x: F.struct((a["s"] + a["g"] * x).alias("s"), (-a["g"]).alias("g")))["s"]
    return found.select(
        "doc_id",
        F.col("_words").alias("n_words"),
        spans.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"),
    )


def _cut(text: str, spans: list[int]) -> str:
    ends = [m.span() for m in re.finditer(WORD, text.translate({c: c + 32 for c in range(65, 91)}))]
    out, at = [], 0
    for b, e in zip(spans[::2], spans[1::2]):
        out.append(text[at : ends[b][0]])
        at = ends[e - 1][1]
    return "".join(out) + text[at:]


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, remove: str = "documents", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents (``remove='documents'``) or with the hit words cut out (``'spans'``)."""
    others = [c for c in docs.columns if c != text_col]
    # Columns travel under names of their own, so none can clash with the operator's.
    plain = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(others)], F.col(text_col).alias("t"))
    found = hits(plain, benchmark, width, tuple(f"c{k}" for k in range(len(others))), "t")
    if remove == "documents":
        found = found.filter(F.size("_spans") == 0)
    else:

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                k = b.schema.get_field_index("_text")
                spans = b.column(b.schema.get_field_index("_spans")).to_pylist()
                texts = [_cut(t, s) if t and s else t for t, s in zip(b.column(k).to_pylist(), spans)]
                yield b.set_column(k, b.schema.field(k), pa.array(texts, b.schema.field(k).type))

        found = found.mapInArrow(cut, found.schema)
    back = {f"c{k}": c for k, c in enumerate(others)} | {"_text": text_col}
    return found.select(*[F.col({v: k for k, v in back.items()}[c]).alias(c) for c in docs.columns])


#: DuckDB SQL for ``report`` over ``documents`` and ``benchmark`` with the default parameters.
SQL = r"""
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, ns WHERE len(w) >= n)),
h AS (SELECT r, k, dw.n, item FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
c AS (SELECT r, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM h) GROUP BY r),
i AS (SELECT r, count(*)::BIGINT AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN i ON d.r = i.r
"""

"""Vectorised text kernels shared by the corpus operators.

Every kernel works on the Arrow buffers of a string column: one ``uint8`` array
for the bytes of many documents and one offset array.  Nothing here loops over
words in Python, and work is cut into blocks of about ``BLOCK`` bytes, so memory
is bounded by the longest single document rather than by the batch.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one block holds, unless one document alone is longer.
BLOCK = 1 << 20
#: End-of-document symbol of the canonical form; it never occurs inside a word.
END = 10
SPACE = 32

_MULT = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


#: A random 64-bit value for each byte; the base of the polynomial word hash.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * _MULT)


def lower_space_table(separators: np.ndarray) -> np.ndarray:
    """A 256-entry byte map: A-Z to a-z, every separator to a space."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[separators] = SPACE
    return table


#: Words are ``[^\x20\x09-\x0D]+``.
BLANKS = lower_space_table(np.array([32, 9, 10, 11, 12, 13]))
#: Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALNUM = lower_space_table(np.array([b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)]))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    first = int(offsets[0])
    size = int(offsets[-1]) - first
    raw = np.frombuffer(data, np.uint8, count=size, offset=first) if size else np.zeros(0, np.uint8)
    return raw, offsets - first


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(n, max(i + 1, j), i + 50_000)
        yield i, j
        i = j


def canonical(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Words of each document, each followed by one space, then ``END``.

    ``data`` and ``offsets`` are those of one block (``offsets[0]`` may be any
    value).  A document without words is a lone ``END``.
    """
    body = table[data[offsets[0] : offsets[-1]]]
    ends = (offsets[1:] - offsets[0]).repeat(2)
    marks = np.tile(np.array([SPACE, END], np.uint8), len(offsets) - 1)
    seq = np.insert(body, ends, marks)
    is_end = np.zeros(len(seq), bool)
    is_end[offsets[1:] - offsets[0] + 2 * np.arange(len(offsets) - 1) + 1] = True
    gap = (seq == SPACE) & ~is_end
    after = np.empty(len(seq), bool)
    after[0] = True
    after[1:] = gap[:-1] | is_end[:-1]
    return seq[~(gap & after)]


def words(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a canonical sequence: hash and document of each word, words per document."""
    n = len(seq)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.flatnonzero(seq == SPACE)
    stops = np.flatnonzero(seq == END)
    per_doc = np.diff(np.searchsorted(ends, stops), prepend=0)
    doc = np.repeat(np.arange(len(stops)), per_doc)
    if not len(ends):
        return np.zeros(0, np.uint64), doc, per_doc
    is_gap = (seq == SPACE) | (seq == END)
    starts = np.flatnonzero(~is_gap & np.concatenate(([True], is_gap[:-1])))
    return hash_spans(seq, starts, ends), doc, per_doc


def process_cache() -> dict:
    """A dictionary that lasts as long as this Python process.

    Functions that reach an executor by value bring globals of their own, which
    live for one task and, being cyclic, are freed late.  What is large and the
    same for all tasks belongs here.
    """
    return sys.modules.setdefault("_ocelli_process", types.ModuleType("_ocelli_process")).__dict__


def _powers(n: int) -> tuple[np.ndarray, ...]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    cache = process_cache()
    if len(cache.get("powers", ((),))[0]) < n:
        size = 1 << max(21, int(n).bit_length())
        base = int(_MULT)
        found = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, np.uint64(b), np.uint64)
            a[0] = 1
            found.append(np.multiply.accumulate(a, out=a))
        cache["powers"] = tuple(found)
    return cache["powers"]


def hash_spans(seq: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``seq[start:end]``: a polynomial with random byte values, by prefix sums."""
    up, down = _powers(len(seq) + 1)
    total = np.empty(len(seq) + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE_VALUE[seq] * up[: len(seq)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hash_words(items: list[bytes]) -> np.ndarray:
    """The same hashes for separate words (already lower-cased)."""
    seq = np.frombuffer(b" ".join(items) + b" ", np.uint8)
    if not items:
        return np.zeros(0, np.uint64)
    size = np.array([len(x) for x in items], np.int64)
    ends = np.cumsum(size + 1) - 1
    return hash_spans(seq, ends - size, ends)


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (``len(h) - width + 1`` values)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out *= _MULT
        out += h[k : k + n]
        out ^= out >> np.uint64(29)
    return mix64(out)


def shingle_sets(h: np.ndarray, per_doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document of a block, one after the other, and their number.

    A document of fewer than ``width`` words has its whole sequence as the only
    shingle; one without words has none.
    """
    first = np.concatenate(([0], np.cumsum(per_doc)))[:-1]
    count = np.where(per_doc >= width, per_doc - width + 1, 0)
    at = np.repeat(first - np.concatenate(([0], np.cumsum(count)))[:-1], count) + np.arange(int(count.sum()))
    value = rolling(h, width)[at] if len(at) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(per_doc)), count)
    short = np.flatnonzero((per_doc > 0) & (per_doc < width))
    if len(short):
        own = []
        for d in short:
            x = np.uint64(per_doc[d])
            piece = h[first[d] : first[d] + per_doc[d]]
            own.append(rolling(np.concatenate((piece, np.full(1, x, np.uint64))), len(piece) + 1)[0])
        value = np.concatenate((value, np.array(own, np.uint64)))
        doc = np.concatenate((doc, short))
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.bincount(doc[new], minlength=len(per_doc))


def group_sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at)


def run_lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ``keys`` in order and how often each occurs."""
    keys = np.sort(keys)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys)))


def id_remainder(ids: list, mod: int) -> np.ndarray:
    """crc32 of each id as text, modulo ``mod``; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % mod for i in ids], np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

r"""Periodic runs of words: stretches that repeat themselves at least ``TIMES`` times.

A run of period q is a maximal stretch in which words q apart are equal.  Runs are
found by a suffix automaton over a text's words.  States are taken from the longest
to the shortest, and each gives its ordered set of end positions to the state that
its suffix link names, the smaller set going into the larger.  Two end positions
that become neighbours in a state at a distance q of no more than the state's length
mark a square of period q; extended to both sides it is a run, and q is its smallest
period, as nearer positions would otherwise stand between the two.

A run has at least 9 words more than two periods, so each window of 9 words in it
stands there twice.  Texts are first scanned, in blocks and by numpy, for stretches of
windows that recur near by; the automaton is built for those alone, over the words
themselves and not over hashes.  Its memory grows with the longest such stretch of one
text (about 400 bytes a word), its time almost in proportion.

Edge cases: a null text is empty; a text without words has no run and an empty
collapsed text; rows that repeat an id are separate; a null id counts as the empty
text where the query takes its crc32.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textops import END, SPACE, blocks, buffers, canonical, hash_spans, mix64, rolling

#: A run has so many words, and so many periods, at least.
LEAST, TIMES = 24, 3
#: Within a run each window of so many words recurs: min over q of max(24, 3 q) - 2 q + 1.
WINDOW = 9
#: End positions of one piece of an ordered set.
PIECE = 512
RUN = "array<struct<start:long,length:long,period:long>>"
SCHEMA = f"doc_id long, n_words long, runs {RUN}, collapsed string"
WORD = r"[^\x20\x09-\x0D]+"
#: Words keep their case; every separator becomes a space.
AS_WRITTEN = np.arange(256, dtype=np.uint8)
AS_WRITTEN[9:14] = SPACE


class Ends:
    """An ordered set of end positions in pieces, so that adding one moves few others."""

    __slots__ = ("pieces", "size")

    def __init__(self, first: int) -> None:
        self.pieces, self.size = [[first]], 1

    def _piece(self, x: int) -> int:
        return 0 if len(self.pieces) == 1 else max(0, bisect_right(self.pieces, x, key=lambda p: p[0]) - 1)

    def add(self, x: int) -> None:
        k = self._piece(x)
        piece = self.pieces[k]
        insort(piece, x)
        self.size += 1
        if len(piece) > 2 * PIECE:
            self.pieces[k : k + 1] = [piece[:PIECE], piece[PIECE:]]

    def around(self, x: int) -> tuple[int, int]:
        """The neighbours of a member, -1 where there is none."""
        k = self._piece(x)
        piece = self.pieces[k]
        i = bisect_left(piece, x)
        before = piece[i - 1] if i else self.pieces[k - 1][-1] if k else -1
        after = piece[i + 1] if i + 1 < len(piece) else self.pieces[k + 1][0] if k + 1 < len(self.pieces) else -1
        return before, after

    def __iter__(self) -> Iterator[int]:
        for piece in self.pieces:
            yield from piece


def automaton(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and own end position (-1 for a split state) of each state of the suffix automaton; state 0 is the empty word."""
    length, link, end, step = [0], [-1], [-1], [{}]
    last = 0
    for at, c in enumerate(symbols):
        new = len(length)
        length.append(at + 1)
        link.append(0)
        end.append(at)
        step.append({})
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                step.append(step[q].copy())
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return length, link, end


def runs_of(symbols: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of each run of ``symbols`` with its smallest period, by start, then period."""
    n = len(symbols)
    length, link, end = automaton(symbols)
    # What a seed repeats is a run without one period: shorter states have none to give.
    short = min(max(least, times * q) - q for q in range(1, least + 1))
    sets: dict[int, Ends] = {}
    fresh: dict[int, list[int]] = {}
    found: dict[int, list[tuple[int, int]]] = {}

    def seeded(at: int, q: int) -> None:
        """The run of period ``q`` that holds the words ``at - q`` and ``at``."""
        known = found.setdefault(q, [])
        k = bisect_right(known, (at - q, n)) - 1
        if k >= 0 and at <= known[k][1]:
            return
        lo, hi = at, at
        while lo > q and symbols[lo - 1] == symbols[lo - 1 - q]:
            lo -= 1
        while hi + 1 < n and symbols[hi + 1] == symbols[hi + 1 - q]:
            hi += 1
        insort(known, (lo - q, hi))

    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        size = length[state]
        if size < short:
            break
        own = sets.pop(state, None)
        if end[state] >= 0:
            if own is None:
                own = Ends(end[state])
            else:
                own.add(end[state])
                fresh.setdefault(state, []).append(end[state])
        for x in fresh.pop(state, ()):
            before, after = own.around(x)
            if before >= 0 and (times - 1) * (x - before) <= size and size + x - before >= least:
                seeded(x, x - before)
            if after >= 0 and (times - 1) * (after - x) <= size and size + after - x >= least:
                seeded(after, after - x)
        up = link[state]
        if length[up] < short:
            continue
        other = sets.get(up)
        if other is None:
            sets[up] = own
            continue
        if other.size < own.size:  # the smaller set moves, and all of it is new there
            own, other = other, own
            sets[up] = other
            fresh[up] = []
        moved = list(own)
        for x in moved:
            other.add(x)
        fresh.setdefault(up, []).extend(moved)
    out = [(lo, hi - lo + 1, q) for q, all_ in found.items() for lo, hi in all_ if hi - lo + 1 >= max(least, times * q)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(h: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the stretches of a block that can hold a run; ``h`` and ``doc`` are each word's hash and document."""
    n = len(h) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    key = rolling(h, WINDOW)[at] ^ mix64(doc[at].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    key, place = key[order], at[order]
    twin = np.flatnonzero(key[1:] == key[:-1])
    far = np.full(n, np.iinfo(np.int64).max)
    gap = place[twin + 1] - place[twin]
    np.minimum.at(far, place[twin], gap)
    np.minimum.at(far, place[twin + 1], gap)
    good = np.flatnonzero(far < np.iinfo(np.int64).max)
    while len(good):
        cut = np.flatnonzero(np.diff(good) > 1) + 1
        first = np.concatenate(([0], cut))
        stop = np.append(cut, len(good))
        size = good[stop - 1] - good[first] + WINDOW
        fits = np.repeat(np.where(size >= least, size // times, 0), stop - first)
        stay = far[good] <= fits
        if stay.all():
            return good[first], good[stop - 1] + WINDOW
        good = good[stay]
    return none, none


def _texts(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(flat.tobytes())).cast(pa.string())


def _block(data: np.ndarray, offsets: np.ndarray, least: int, times: int) -> tuple[np.ndarray, list[list[tuple]], pa.Array]:
    """Words of each document of a block, its runs, and its collapsed text."""
    seq = canonical(data, offsets, AS_WRITTEN)
    docs = len(offsets) - 1
    gap = (seq == SPACE) | (seq == END)
    ends = np.flatnonzero(seq == SPACE)
    stops = np.flatnonzero(seq == END)
    per_doc = np.diff(np.searchsorted(ends, stops), prepend=0)
    doc = np.repeat(np.arange(docs), per_doc)
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    begins = np.concatenate(([0], np.cumsum(per_doc)))
    runs: list[list[tuple]] = [[] for _ in range(docs)]
    drop = np.zeros(len(ends) + 1, np.int64)
    if len(ends):
        for a, b in zip(*stretches(hash_spans(seq, starts, ends), doc, least, times)):
            a, b = int(a), int(b)
            number: dict[bytes, int] = {}
            symbols = [number.setdefault(w, len(number)) for w in seq[starts[a] : ends[b - 1]].tobytes().split(b" ")]
            d = int(doc[a])
            for start, length, q in runs_of(symbols, least, times):
                runs[d].append((a + start - int(begins[d]), length, q))
                drop[a + start + q] += 1
                drop[a + start + length] -= 1
    stays = seq != END
    gone = np.flatnonzero(np.cumsum(drop)[: len(ends)] > 0)
    if len(gone):
        mark = np.zeros(len(seq) + 1, np.int32)
        mark[starts[gone]] += 1
        mark[ends[gone] + 1] -= 1
        stays &= np.cumsum(mark[:-1]) == 0
    # The space after a document's last word goes too.
    size = np.add.reduceat(stays, np.concatenate(([0], stops[:-1] + 1))) if docs else np.zeros(0, np.int64)
    kept = np.flatnonzero(stays)
    last = np.cumsum(size)[size > 0] - 1
    flat = np.delete(seq[kept], last)
    return per_doc, [sorted(r, key=lambda x: (x[0], x[2])) for r in runs], _texts(flat, size - (size > 0))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each row.

    ``runs`` has start, length and period of each run, by start, then period;
    ``collapsed`` is the text without the words that repeat a run's first period,
    joined by one space.  ``least`` is at least 24 and ``times`` at least 3.
    """
    if least < LEAST or times < TIMES:
        raise ValueError("windows of 9 words find runs of at least 24 words and 3 periods")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, offsets) = batch.column(0), buffers(batch.column(1))
            for i, j in blocks(offsets):
                words, runs, texts = _block(data, offsets[i : j + 1], least, times)
                rows = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], kind)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(words, pa.int64()), rows, texts], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, SCHEMA)


def planted(id_col: Column, text: Column) -> Column:
    """The text that the query looks at: of ids whose crc32 is divisible by 10, the words from one on repeat."""
    h = F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    # One element, so that the words are taken once.
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")), F.lit(0))
    return F.when(h % 10 == 0, changed).otherwise(text)


def report(docs: DataFrame) -> DataFrame:
    """The query's columns: number of runs, the run of most periods, and digests of all runs and of the collapsed text."""
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = find(seen)
    # Exact comparison of length / period; the first of equal ones stays.
    more = lambda a, b: a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"])
    best = F.aggregate("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, b: F.when(more(a, b), b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    return found.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")).cast("binary"), 256).alias("collapsed_sha256"),
    )

"""Linear models over hashed affixes of words and a few figures of a text.

Features of a text are the distinct 32-bit hashes of its words, of their first 4,
5 and 6 bytes, and of their trailing signs; beside them stand ``DENSE`` figures.
Models are logistic, ridge-penalised and fitted by Newton steps over the features
that tell the classes apart best.  They are fitted on a bounded sample of
labelled rows (``SAMPLE``) and applied to all rows where the text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import BLANKS, END, SPACE, blocks, buffers, canonical, hash_spans, shingle_sets

#: Labelled rows that a model is fitted on, at most; chosen by the hash of their id.
SAMPLE = 6000
#: Features of one sampled row that reach the driver, at most.
ROW_HASHES = 1 << 13
#: Hashed features of one model, at most.
SELECTED = 320
DENSE = ("log_words", "word_length", "upper", "digits", "signs", "bars", "repeated")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:48] = _SIGN[58:65] = _SIGN[91:97] = _SIGN[123:127] = True


def featured(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a block of texts: hashes and the text of each (repeats included), and the dense figures."""
    seq = canonical(raw, offs, BLANKS)
    n = len(offs) - 1
    gap = (seq == SPACE) | (seq == END)
    ends = np.flatnonzero(seq == SPACE)
    starts = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    stops = np.flatnonzero(seq == END)
    per = np.diff(np.searchsorted(ends, stops), prepend=0)
    doc = np.repeat(np.arange(n), per)
    size = ends - starts
    whole = hash_spans(seq, starts, ends)
    hashes, of = [whole], [doc]
    for k in (4, 5, 6):
        long = size > k
        hashes.append(hash_spans(seq, starts[long], starts[long] + k) ^ np.uint64(k << 40))
        of.append(doc[long])
    # The run of signs that a word ends in.
    sign = _SIGN[seq]
    place = np.arange(len(seq))
    plain = np.maximum.accumulate(np.where(sign, -1, place))
    tail = np.maximum(plain[ends - 1] + 1, starts) if len(ends) else ends
    has = tail < ends
    hashes.append(hash_spans(seq, tail[has], ends[has]) ^ np.uint64(9 << 40))
    of.append(doc[has])
    body = raw[offs[0] : offs[-1]]
    cut = offs - offs[0]

    def counted(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[cut[1:]] - total[cut[:-1]]

    letters, chars = counted(_LETTER[body]), np.maximum(1, np.diff(cut))
    _, distinct = shingle_sets(whole, per, 3)
    dense = np.stack(
        [
            np.log1p(per),
            np.bincount(doc, size, n) / np.maximum(1, per),
            counted((body >= 65) & (body <= 90)) / np.maximum(1, letters),
            counted((body >= 48) & (body <= 57)) / chars,
            counted(_SIGN[body]) / chars,
            counted(body == 124) / chars,
            1 - distinct / np.maximum(1, per - 2),
        ],
        1,
    )
    return (np.concatenate(hashes) >> np.uint64(32)).astype(np.uint32), np.concatenate(of), dense


@dataclass
class Rows:
    """Features of sampled rows."""

    key: np.ndarray  # id of each row
    start: np.ndarray  # where its hashes begin; one more at the end
    hashes: np.ndarray
    dense: np.ndarray
    labels: dict[str, np.ndarray] = field(default_factory=dict)


def _sampler(labels: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column(1))
            for i, j in blocks(offs):
                h, of, dense = featured(raw, offs[i : j + 1])
                both = np.unique((of.astype(np.uint64) << np.uint64(32)) | h)
                cut = np.searchsorted(both >> np.uint64(32), np.arange(j - i + 1))
                blobs = [both[a : min(b, a + ROW_HASHES)].astype(np.uint32).tobytes() for a, b in zip(cut, cut[1:])]
                figures = [row.tobytes() for row in dense]
                own = [batch.column(2 + k)[i:j] for k in range(len(labels))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(blobs, pa.binary()), pa.array(figures, pa.binary()), *own], ["id", "hashes", "dense", *labels])

    return run


def sample(docs: DataFrame, labels: DataFrame, names: list[str], limit: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Rows:
    """Features of at most ``limit`` labelled rows; rows with a null id or label are not labelled, and of rows that share an id the smallest text counts."""
    own = labels.select(F.col(id_col).cast("long").alias("_id"), *[F.col(c).cast("int").alias(f"_l{k}") for k, c in enumerate(names)]).dropna()
    own = own.groupBy("_id").agg(*[F.max(f"_l{k}").alias(f"_l{k}") for k in range(len(names))])
    few = own.orderBy(F.md5(F.col("_id").cast("string")), *own.columns).limit(limit)
    # No more than ``limit`` short rows are broadcast.
    both = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(few), "_id")
    cols = [f"_l{k}" for k in range(len(names))]
    schema = "id long, hashes binary, dense binary, " + ", ".join(f"{c} int" for c in cols)
    both = both.groupBy("_id", *cols).agg(F.min("_text").alias("_text"))
    got = both.select("_id", "_text", *cols).mapInArrow(_sampler(cols), schema).toArrow().sort_by("id")
    blobs = got.column("hashes").to_pylist()
    return Rows(
        got.column("id").to_numpy(),
        np.cumsum([0] + [len(b) // 4 for b in blobs]),
        np.frombuffer(b"".join(blobs), np.uint32),
        np.frombuffer(b"".join(got.column("dense").to_pylist()), np.float64).reshape(len(blobs), len(DENSE)),
        {name: got.column(c).to_numpy().astype(np.float64) for name, c in zip(names, cols)},
    )


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def newton(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights of a logistic model; the last is the constant, which isn't penalised."""
    x = np.concatenate((x, np.ones((len(x), 1), x.dtype)), 1)
    w = np.zeros(x.shape[1])
    fine = np.full(x.shape[1], ridge)
    fine[-1] = 1e-3
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (p - y) + fine * w
        hessian = (x * (p * (1 - p) + 1e-6)[:, None].astype(x.dtype)).T @ x + np.diag(fine)
        move = np.linalg.solve(hessian.astype(np.float64), gradient)
        w -= move
        if np.abs(move).max() < 1e-4:
            break
    return w


class Model:
    """One logistic model: ``hashes`` (sorted), means and scales of the dense figures, weights."""

    def __init__(self, rows: Rows, y: np.ndarray, use: np.ndarray, extra: np.ndarray, ridge: float = 1.0) -> None:
        self.hashes = self._select(rows, y, use)
        figures = np.concatenate((rows.dense, extra), 1)
        own = figures[use] if use.any() else np.zeros((1, figures.shape[1]))
        self.mean, self.scale = own.mean(0), own.std(0) + 1e-6
        x = np.concatenate((self._hits(rows), (figures - self.mean) / self.scale), 1).astype(np.float32)
        self.weights = newton(x[use], y[use], ridge) if 0 < y[use].sum() < use.sum() else self._constant(x.shape[1], y[use])
        self.fitted = sigmoid(np.concatenate((x, np.ones((len(x), 1))), 1) @ self.weights)

    @staticmethod
    def _constant(n: int, y: np.ndarray) -> np.ndarray:
        w = np.zeros(n + 1)
        w[-1] = logit(np.array([(y.sum() + 0.5) / (len(y) + 1)]))[0]
        return w

    @staticmethod
    def _select(rows: Rows, y: np.ndarray, use: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(use)), np.diff(rows.start))
        h, row = rows.hashes[use[row]], row[use[row]]
        least = 8 if use.sum() >= 1000 else 3
        # Rare hashes go first, by a coarse count that never is too low.
        coarse = np.bincount(h >> np.uint32(10), minlength=1 << 22)
        keep = coarse[h >> np.uint32(10)] >= least
        h, row = h[keep], row[keep]
        value, at = np.unique(h, return_inverse=True)
        n1, n0 = max(1.0, y[use].sum()), max(1.0, (1 - y[use]).sum())
        one = np.bincount(at, y[row], len(value))
        both = np.bincount(at, minlength=len(value))
        share = (both + 1) / (n1 + n0 + 2)
        z = (one / n1 - (both - one) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
        good = np.flatnonzero((both >= least) & (np.abs(z) >= 4))
        good = good[np.argsort(-np.abs(z[good]), kind="stable")][:SELECTED]
        return np.sort(value[good])

    def _hits(self, rows: Rows) -> np.ndarray:
        x = np.zeros((len(rows.start) - 1, len(self.hashes)), np.float32)
        if len(self.hashes):
            row = np.repeat(np.arange(len(x)), np.diff(rows.start))
            at = np.minimum(np.searchsorted(self.hashes, rows.hashes), len(self.hashes) - 1)
            hit = self.hashes[at] == rows.hashes
            x[row[hit], at[hit]] = 1
        return x

    def apply(self, h: np.ndarray, of: np.ndarray, dense: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Probabilities of a block of texts."""
        figures = (np.concatenate((dense, extra), 1) - self.mean) / self.scale
        k = len(self.hashes)
        out = figures @ self.weights[k:-1] + self.weights[-1]
        if k:
            coarse = np.zeros(1 << 16, bool)
            coarse[self.hashes >> np.uint32(16)] = True
            some = np.flatnonzero(coarse[h >> np.uint32(16)])
            at = np.minimum(np.searchsorted(self.hashes, h[some]), k - 1)
            hit = self.hashes[at] == h[some]
            pair = np.unique(of[some][hit].astype(np.int64) * k + at[hit])
            out = out + np.bincount(pair // k, self.weights[pair % k], len(dense))
        return sigmoid(out)


def out_of_fold(rows: Rows, y: np.ndarray, extra: np.ndarray, folds: int = 5) -> np.ndarray:
    """Probability of each row from a model that didn't see its fold."""
    fold = (rows.key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(folds)
    out = np.zeros(len(y))
    for k in range(folds):
        here = fold == k
        if here.any():
            use = ~here if (~here).any() else here
            out[here] = Model(rows, y, use, extra).fitted[here]
    return out

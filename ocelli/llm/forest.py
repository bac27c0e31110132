"""Near-duplicate detection with an LSH forest.

1. Every text becomes the set of its word shingles, a MinHash signature of
   ``COMPONENTS`` one-byte values, and a 128-bit hash of the set.  Texts with
   equal sets are one node from here on.
2. ``TREES`` orders of the signature's values give ``TREES`` labels a node.  All
   (tree, label) pairs are range-sorted.  Nodes with a common prefix of at least
   ``least_depth`` values form a region; each is compared, by signature, with
   its longest-common-prefix neighbours and with its region.  A region beyond
   ``REGION`` nodes goes deeper, value by value, until it fits.
3. Nodes whose signatures agree in nearly as many values as the threshold asks
   for (five standard deviations below it) are candidates; connected candidates
   form a cluster.  A cluster of at most ``BLOCK_NODES`` is verified as one
   block.  A larger one is verified in the blocks that its regions give in the
   first ``BLOCK_TREES`` trees, so no task holds more than a block and pairs are
   never emitted.
4. In a block, intersections of the full sets are counted exactly, and pairs at
   or over the threshold are links.  Components of the links are classes so far.
5. Where a region was cut (beyond ``REGION``, or by the edge of a task's share) or
   a cluster didn't fit a block, some pairs haven't met.  Such regions and
   clusters, joined where they share a node, are crowds.  Most of a crowd is one
   class by now.  Every member outside of its largest class (a straggler) is
   compared with all members by full sets, in packs of at most ``PACK`` nodes, so
   in a crowd no link between classes is lost, whatever its size.

What is left to chance are pairs in small regions that fail the signature test
(about 3 in 10 million at the threshold) and pairs without a common prefix in any
tree (2 in 10 million at 85 %, 1 in 100,000 at 80 %).  The work of a crowd is its
stragglers times its members.

Edge cases: a text with fewer words than a shingle is one shingle; a null text
or one without words has no shingles, is linked with nothing and is kept.  Rows
that repeat an id or a text are separate rows of one class; of rows that tie for
the smallest id, one is kept by ``keep_first``.  Null ids sort last.  An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, joined
from .shared import freed, made, numbered, only, parts, written
from .textops import BLANKS, blocks, buffers, canonical, mix64, shingle_sets, signed, words

COMPONENTS = 128
TREES = 16
LABEL = 12
REGION = 1024
NEAR = 12
BLOCK_NODES = 160
#: Trees whose regions give the blocks of clusters that are larger.
BLOCK_TREES = 6
#: Nodes and shingles (unless one node alone has more) of a pack of a crowd.
PACK = 512
PACK_SHINGLES = 1 << 18
#: Rows of one region that a task holds at a time.
HELD = 1 << 16

_RANDOM = mix64(np.arange(1, 2 * COMPONENTS + 1, dtype=np.uint64) << np.uint64(20))
FACTORS = (_RANDOM[:COMPONENTS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
OFFSETS = (_RANDOM[COMPONENTS:] >> np.uint64(32)).astype(np.uint32)
#: The signature values that each tree reads, in its order.
ORDERS = np.argsort(mix64(np.arange(TREES * COMPONENTS, dtype=np.uint64) + np.uint64(77)).reshape(TREES, COMPONENTS), axis=1)[:, :LABEL]


def signatures(sets: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One-byte MinHash values of concatenated sets (rows without a shingle: zeros)."""
    out = np.zeros((len(size), COMPONENTS), np.uint8)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    first = (np.cumsum(size) - size)[full]
    h = (sets >> np.uint64(32)).astype(np.uint32)
    for k in range(COMPONENTS):
        least = np.minimum.reduceat(h * FACTORS[k] + OFFSETS[k], first)
        out[full, k] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
    return out


_SIGNED = "rid long, doc_id long, n_shingles long, s1 long, s2 long, sig binary"


def _signer(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column(2))
            for i, j in blocks(offs):
                h, _, per = words(canonical(raw, offs[i : j + 1], BLANKS))
                sets, size = shingle_sets(h, per, width)
                stop = np.cumsum(size)
                sums = []
                for salt in (0, 0x5851F42D4C957F2D):
                    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix64(sets ^ np.uint64(salt)))))
                    sums.append(pa.array(signed(total[stop] - total[stop - size])))
                sig = signatures(sets, size)
                packed = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((np.arange(len(size) + 1, dtype=np.int32) * COMPONENTS).tobytes()), pa.py_buffer(sig.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(size.astype(np.int64)), *sums, packed], [x.split()[0] for x in _SIGNED.split(", ")])

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    raw, offs = buffers(column)
    return raw.reshape(len(offs) - 1, width)


def _planter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node once for each tree, with its label there."""
    for batch in batches:
        sig = _matrix(batch.column(1), COMPONENTS)
        n = len(sig)
        offs = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * LABEL).tobytes())
        for t in range(TREES):
            label = np.ascontiguousarray(sig[:, ORDERS[t]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.Array.from_buffers(pa.binary(), n, [None, offs, pa.py_buffer(label.tobytes())]), batch.column(0), batch.column(1)], ["tree", "label", "node", "sig"])


def _dense(label: np.ndarray, sig: np.ndarray, rows: np.ndarray, depth: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of alike signatures within a region, which goes deeper while it is too large."""
    if len(rows) > REGION and depth < LABEL:
        cut = np.flatnonzero(np.diff(label[rows, depth])) + 1
        for part in np.split(rows, cut):
            yield from _dense(label, sig, part, depth + 1, least)
        return
    for i in range(0, len(rows), REGION):
        part = rows[i : i + REGION]
        own = sig[part]
        for k in range(len(part) - 1):
            alike = np.flatnonzero(np.count_nonzero(own[k + 1 :] == own[k], axis=1) >= least)
            if len(alike):
                yield np.full(len(alike), part[k]), part[k + 1 + alike]


def _packed(label: np.ndarray, rows: np.ndarray, depth: int) -> Iterator[np.ndarray]:
    """Blocks of at most ``BLOCK_NODES`` rows: deeper regions, small neighbours together; at full depth overlapping pieces."""
    if len(rows) <= BLOCK_NODES:
        yield rows
        return
    if depth == LABEL:
        for i in range(0, len(rows) - BLOCK_NODES // 2, BLOCK_NODES // 2):
            yield rows[i : i + BLOCK_NODES]
        return
    held: list[np.ndarray] = []
    size = 0
    for part in np.split(rows, np.flatnonzero(np.diff(label[rows, depth])) + 1):
        if size + len(part) > BLOCK_NODES and held:
            yield np.concatenate(held)
            held, size = [], 0
        if len(part) > BLOCK_NODES:
            yield from _packed(label, part, depth + 1)
        else:
            held.append(part)
            size += len(part)
    if held:
        yield np.concatenate(held)


def _block_key(low: int, tree: int, k: int) -> np.uint64:
    key = np.array([low, (int(tree) << 40) | k], np.int64).view(np.uint64)
    return mix64(mix64(key[:1]) + key[1:])[0]


def _grower(least: int, least_depth: int):
    """(kind, centre, node, block).  Kind 0: nodes of a cluster of candidates, and a block of it (null: none from this tree); kind 1: nodes of a region that was cut, named by ``centre``; ``block`` tells its pieces apart."""

    def regions(tree: np.ndarray, label: np.ndarray, node: np.ndarray, sig: np.ndarray, piece: int, begins: bool, ends: bool):
        n = len(node)
        new = np.ones(n, bool)
        new[1:] = (tree[1:] != tree[:-1]) | (label[1:, :least_depth] != label[:-1, :least_depth]).any(1)
        region = np.cumsum(new)
        a, b = [], []
        for k in range(1, NEAR + 1):
            i = np.flatnonzero(region[k:] == region[:-k])
            if not len(i):
                break
            i = i[np.count_nonzero(sig[i] == sig[i + k], axis=1) >= least]
            a.append(i)
            b.append(i + k)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        for f, m in zip(first[size > NEAR + 1], size[size > NEAR + 1]):
            for x, y in _dense(label, sig, np.arange(f, f + m), least_depth, least):
                a.append(x)
                b.append(y)
        # Regions that were not compared in whole here, or that may go on in another task or piece.
        open_ = size > REGION
        open_[0] |= begins
        open_[-1] |= ends
        for f, m in zip(first[open_], size[open_]):
            own = -1 - int.from_bytes(bytes([tree[f], *label[f, :least_depth]]), "big")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, 1, np.int32)), pa.array(np.full(m, own)), pa.array(node[f : f + m]), pa.array(np.full(m, piece))], _FOUND)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        if not len(a):
            return
        comp = joined(n, a, b)
        rows = np.unique(np.concatenate((a, b)))
        rows = rows[np.argsort(comp[rows], kind="stable")]
        centre, member, block, blank = [], [], [], []
        for part in np.split(rows, np.flatnonzero(np.diff(comp[rows])) + 1):
            low = node[part].min()
            pieces = _packed(label, part, least_depth) if tree[part[0]] < BLOCK_TREES else [part]
            for k, rows_ in enumerate(pieces):
                centre.append(np.full(len(rows_), low))
                member.append(node[rows_])
                block.append(np.full(len(rows_), _block_key(low, tree[part[0]], k)))
                blank.append(np.full(len(rows_), tree[part[0]] >= BLOCK_TREES))
        out = [np.concatenate(x) for x in (centre, member, block, blank)]
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(out[0]), np.int32)), pa.array(out[0]), pa.array(out[1]), pa.array(signed(out[2]), mask=out[3])], _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, piece = None, (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        cut = True  # whether the first region may have begun before
        for batch in batches:
            now = (batch.column(0).to_numpy(), _matrix(batch.column(1), LABEL), batch.column(2).to_numpy(), _matrix(batch.column(3), COMPONENTS))
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now))
            if not len(now[0]):
                continue
            # The last region may go on in the next batch.
            last = (now[0] == now[0][-1]) & (now[1][:, :least_depth] == now[1][-1, :least_depth]).all(1)
            at = int(np.argmax(last)) if last.sum() < HELD else len(last)
            if at:
                ends = at == len(last)
                yield from regions(*(x[:at] for x in now), piece, cut, ends)
                piece, cut = piece + 1, ends
            held = tuple(x[at:] for x in now)
        if held is not None and len(held[0]):
            yield from regions(*held, piece, cut, True)

    return run


_FOUND = ["kind", "centre", "node", "block"]


def _verifier(width: int, percent: int):
    def links(sets: list[np.ndarray], node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(s) for s in sets])
        m = len(sets)
        value, at = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(m), size)
        shared = np.bincount(at, minlength=len(value)) > 1
        place = np.cumsum(shared) - 1
        keep = shared[at]
        row, col = row[keep], place[at[keep]]
        common = np.zeros((m, m))
        wide = max(1024, (1 << 22) // m)
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        for c in range(0, int(shared.sum()), wide):
            i, j = np.searchsorted(col, (c, c + wide))
            x = np.zeros((m, wide), np.float32)
            x[row[i:j], col[i:j] - c] = 1
            common += x @ x.T
        union = size[:, None] + size[None, :] - common
        a, b = np.nonzero(np.triu(100 * common >= percent * union, 1))
        comp = joined(m, a, b)
        low = np.full(m, np.iinfo(np.int64).max)
        np.minimum.at(low, comp, node)
        moved = low[comp] != node
        return low[comp][moved], node[moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sets, nodes = None, [], []

        def done():
            if len(nodes) > 1:
                a, b = links(sets, np.array(nodes))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            block, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            raw, offs = buffers(batch.column(2))
            for i, j in blocks(offs):
                h, _, per = words(canonical(raw, offs[i : j + 1], BLANKS))
                value, size = shingle_sets(h, per, width)
                for k, s in enumerate(np.split(value, np.cumsum(size)[:-1])):
                    if block[i + k] != key:
                        yield from done()
                        key, sets, nodes = block[i + k], [], []
                    if nodes and nodes[-1] == node[i + k]:
                        continue
                    sets.append(s)
                    nodes.append(int(node[i + k]))
        yield from done()

    return run


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list, np.ndarray]]:
    """The other columns of each row, as Python values, and the shingles of its last one."""
    for batch in batches:
        raw, offs = buffers(batch.column(batch.num_columns - 1))
        own = [batch.column(k).to_pylist() for k in range(batch.num_columns - 1)]
        for i, j in blocks(offs):
            h, _, per = words(canonical(raw, offs[i : j + 1], BLANKS))
            value, size = shingle_sets(h, per, width)
            for k, s in enumerate(np.split(value, np.cumsum(size)[:-1])):
                yield [c[i + k] for c in own], s


def _packer(width: int):
    """Packs of a crowd's members, and of its stragglers, from rows sorted by crowd and number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        held: dict[bool, list] = {False: [], True: []}
        crowd = None

        def done(odd: bool):
            nonlocal where
            rows, held[odd] = held[odd], []
            if rows:
                where += 1
                size = [len(s) for _, _, s in rows]
                blob = b"".join((np.array([len(rows)], np.int64).tobytes(), *(np.array(x, np.int64).tobytes() for x in ([n for n, _, _ in rows], [c for _, c, _ in rows], size)), *(s.tobytes() for _, _, s in rows)))
                yield pa.RecordBatch.from_arrays([pa.array([crowd], pa.int64()), pa.array([odd]), pa.array([where]), pa.array([min(size)]), pa.array([max(size)]), pa.array([blob], pa.binary())], _PACKS)

        for (c, node, label, odd), s in _sets(batches, width):
            if c != crowd:
                yield from done(False)
                yield from done(True)
                crowd = c
            for kind in (False, True)[: 1 + odd]:
                if held[kind] and (len(held[kind]) >= PACK or sum(len(x) for _, _, x in held[kind]) + len(s) > PACK_SHINGLES):
                    yield from done(kind)
                held[kind].append((node, label, s))
        yield from done(False)
        yield from done(True)

    return run


_PACKS = ["crowd", "odd", "pack", "low", "high", "blob"]


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, classes, sizes and concatenated sets."""
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    node, label, size = np.frombuffer(blob, np.int64, 3 * n, 8).reshape(3, n)
    return node, label, size, np.frombuffer(blob, np.uint64, int(size.sum()), 8 + 24 * n)


def common_counts(a: tuple, b: tuple, wide: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each set of ``a`` with each of ``b`` (sizes, concatenated sets)."""
    (size_a, sets_a), (size_b, sets_b) = a, b
    shared = np.intersect1d(np.unique(sets_a), np.unique(sets_b), assume_unique=True)
    out = np.zeros((len(size_a), len(size_b)), np.float32)
    if not len(shared):
        return out
    sides = []
    for size, sets in ((size_a, sets_a), (size_b, sets_b)):
        col = np.minimum(np.searchsorted(shared, sets), len(shared) - 1)
        hit = shared[col] == sets
        row, col = np.repeat(np.arange(len(size)), size)[hit], col[hit]
        order = np.argsort(col, kind="stable")
        sides.append((row[order], col[order], len(size)))
    for c in range(0, len(shared), wide):
        x = []
        for row, col, n in sides:
            i, j = np.searchsorted(col, (c, c + wide))
            m = np.zeros((n, min(wide, len(shared) - c)), np.float32)
            m[row[i:j], col[i:j] - c] = 1
            x.append(m)
        out += x[0] @ x[1].T
    return out


def _comparer(percent: int):
    """Links between classes: (class, class) for pairs of a straggler and a member at or over the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for odd, all_ in zip(batch.column(0), batch.column(1)):
                node, label, size, sets = _unpacked(odd.as_py())
                node2, label2, size2, sets2 = _unpacked(all_.as_py())
                common = common_counts((size, sets), (size2, sets2))
                i, j = np.nonzero(100 * common >= percent * (size[:, None] + size2[None, :] - common))
                pair = np.stack((np.minimum(label[i], label2[j]), np.maximum(label[i], label2[j])), 1)
                pair = np.unique(pair[pair[:, 0] != pair[:, 1]], axis=0)
                a.append(pair[:, 0])
                b.append(pair[:, 1])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _completed(spark, label: DataFrame, crowd: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """``node, label`` after the stragglers of all crowds (``node, crowd``) have been compared with their members."""
    inside = crowd.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    inside = written(inside.join(nodes.select("node", "n_shingles"), "node"), "forest-crowds")
    sizes = inside.groupBy("crowd", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("crowd").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"), F.count("*").alias("classes")).filter("classes > 1")
    main = written(main, "forest-main")
    if main.isEmpty():
        return label
    members = inside.join(main.select("crowd", "main"), "crowd").select("crowd", "node", "label", (F.col("label") != F.col("main")).alias("odd"), "n_shingles")
    shipped = texts.select(F.col("rid").alias("node"), "text").join(members, "node").select("crowd", "node", "label", "odd", "n_shingles", "text")
    order = shipped.repartitionByRange(parts(spark), "crowd", "n_shingles", "node").sortWithinPartitions("crowd", "n_shingles", "node").drop("n_shingles")
    packs = written(order.mapInArrow(_packer(width), "crowd long, odd boolean, pack long, low long, high long, blob binary"), "forest-packs")
    salts = parts(spark)
    all_, odd = packs.filter("not odd"), packs.filter("odd")
    left = odd.select("crowd", F.col("pack").alias("p"), F.col("low").alias("l"), F.col("high").alias("h"))
    # Sets whose sizes differ by more than the threshold allows can't be linked.
    near = (F.col("low") * percent <= F.col("h") * 100) & (F.col("l") * percent <= F.col("high") * 100)
    pairs = all_.select("crowd", "pack", "low", "high").join(left, "crowd").filter(near).select("pack", "p", F.pmod(F.xxhash64("pack"), F.lit(salts)).alias("salt"))
    whole = pairs.join(all_.select("pack", F.col("blob").alias("blob2")), "pack")
    # A pack of stragglers may meet all packs of its crowd, so it is salted, with a copy for each salt of its pairs.
    dealt = odd.select(F.col("pack").alias("p"), "blob").join(pairs.select("p", "salt").distinct(), "p")
    met = whole.join(dealt, ["p", "salt"]).select("blob", "blob2")
    more = written(components(met.mapInArrow(_comparer(percent), "a long, b long")), "forest-more")
    known = label.select("node", F.col("label").alias("old")).join(more.select(F.col("node").alias("old"), F.col("label").alias("new")), "old", "left").select("node", F.coalesce("new", "old").alias("label"))
    # Stragglers without any link before are classes of themselves.
    alone = more.join(label.select("node"), "node", "left_anti").select("node", "label")
    return written(known.unionByName(alone), "forest-labels")


def classes(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``rid, doc_id, n_shingles, component_id, first`` for each row of ``docs``.

    ``component_id``: the smallest id of the class of near duplicates (``percent``
    of the union in common); ``first``: whether the row is the one to keep.
    ``row_col``: the row number of a table that ``numbered`` wrote; without it, ids and
    texts are written with one.
    """
    spark = docs.sparkSession
    if row_col is None:
        docs, row_col = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
        id_col, text_col = "doc_id", "text"
    began = made()
    texts = docs.select(F.col(row_col).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(texts.mapInArrow(_signer(width), _SIGNED), "forest-rows")
    low = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "rid")
    sets = rows.filter("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("rid").alias("node"), F.min(low).alias("low"), F.min("sig").alias("sig"))
    nodes = written(sets, "forest-nodes")
    share = percent / 100
    least = math.floor(COMPONENTS * share - 5 * math.sqrt(COMPONENTS * share * (1 - share)))
    planted = nodes.select("node", "sig").mapInArrow(_planter, "tree int, label binary, node long, sig binary")
    order = planted.repartitionByRange(parts(spark), "tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    found = written(order.mapInArrow(_grower(least, 3), "kind int, centre long, node long, block long"), "forest-regions")
    begun = made()
    cluster = written(components(found.filter("kind = 0").select(F.col("centre").alias("a"), F.col("node").alias("b"))), "forest-clusters")
    freed(spark, begun, cluster)
    sizes = cluster.groupBy("label").agg(F.count("*").alias("members"))
    placed = written(cluster.join(sizes, "label").select("node", "label", (F.col("members") > BLOCK_NODES).alias("large")), "forest-placed")
    small = placed.filter("not large").select("node", F.xxhash64("label").alias("block"))
    large = found.filter("block is not null and kind = 0").select("node", "block").join(placed.filter("large").select("node"), "node").distinct()
    blocked = small.unionByName(large.select("node", "block"))
    shipped = texts.select(F.col("rid").alias("node"), "text").join(blocked, "node").select("block", "node", "text")
    dealt = shipped.repartition(parts(spark), "block").sortWithinPartitions("block", "node")
    links = dealt.mapInArrow(_verifier(width, percent), "a long, b long")
    begun = made()
    label = written(components(links), "forest-labels")
    freed(spark, begun, label)
    # Regions at the edge of a task's share may turn out whole; then their stragglers are few.
    open_ = found.filter("kind = 1").select(F.col("centre").alias("a"), F.col("node").alias("b"))
    open_ = open_.unionByName(placed.filter("large").select(F.col("label").alias("a"), F.col("node").alias("b")))
    label = _completed(spark, label, components(open_).filter("node >= 0").withColumnRenamed("label", "crowd"), nodes, texts, width, percent)
    whole = nodes.select("s1", "s2", "n_shingles", "node", "low").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    whole = written(whole, "forest-whole")
    freed(spark, began, rows, whole)
    lowest = whole.groupBy("label").agg(F.min("low").alias("head"))
    named = whole.join(lowest, "label").select("s1", "s2", "n_shingles", "head")
    out = rows.drop("sig").join(named, ["s1", "s2", "n_shingles"], "left")
    return out.select(
        "rid",
        "doc_id",
        "n_shingles",
        F.when(F.col("head").isNotNull(), F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        (F.col("head").isNull() | (F.col("head.rid") == F.col("rid"))).alias("first"),
    )


def report(docs: DataFrame, width: int = 3, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs``."""
    return classes(docs, width, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class."""
    whole, name = numbered(docs)
    return only(whole, name, classes(whole, width, percent, id_col, text_col, name).filter("first").select("rid"))

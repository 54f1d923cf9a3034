"""Similarity join of documents on their sets of word shingles (Jaccard).

Documents with equal sets form one class, and classes are compared.  Shingles are hashed into groups; a
class's group counts are its point, and the sum of coordinate minima of two points bounds their overlap
from above.  With all shingles in one order, rare before frequent, two sets of similarity t share one of
their first n - ceil(t n) + 1: such a shingle makes a block, rare ones one for each run of sizes that allow links,
and all blocks with the same pivot class make a cluster, so that every pair to find stands in a cluster.

Each cluster is an R-tree over the points of its classes.  Leaves are packed in the order of tiles (size,
then coarse counts) within a bound of classes and bytes.  First the classes of a leaf meet each other and the
cluster's pivot: pairs that the bound leaves are verified on the whole sets.  Then, in clusters of several
leaves whose classes are not all connected yet, the tree is searched from the root: pairs of nodes whose
boxes and sizes allow a link are opened, down to pairs of leaves, whose classes meet as before.  A group of
classes gives links enough for its components, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, dealt_table, lean, release, shuffle_partitions
from .components import components
from .hashing import doc_shingles, mix64
from .url_filter import _level

#: The similarity is NUM / DEN or more.
NUM, DEN = 75, 100
MOST_HEAVY = 200_000
#: A leaf has so many classes and bytes of sets at most (or one class); an inner node so many children.
LEAF, LEAF_BYTES, FANOUT = 256, 8_000_000, 8
#: Groups of a box, at most.
BOX = 64
#: Blocks of rare shingles are made in so many passes: the shuffle files of one stand on disk at a time.
PASSES = 4
#: Sizes of similar sets are so many steps apart at most; a rare shingle is listed as KEY_BITS of it and STEP_BITS with its set's step.
STEPS, STEP_BITS, KEY_BITS = 4, 8, 40


def _least_sizes() -> np.ndarray:
    """The least size of every step: whatever is similar to a size under the least of a step is under the least STEPS further on."""
    least = [0, 12, 13, 14, 15]
    while len(least) < 1 << STEP_BITS:
        least.append(DEN * (least[-STEPS] - 1) // NUM + 1)
    return np.array(least)


LEAST_SIZES = _least_sizes()


def listed(light: np.ndarray, n: int) -> np.ndarray:
    """Rare shingles of a set of n as they are listed; those that share their KEY_BITS share a block, which adds to it only."""
    step = int(np.searchsorted(LEAST_SIZES, n, side="right")) - 1
    return (light >> np.uint64(64 - KEY_BITS) << np.uint64(STEP_BITS) | np.uint64(step)).view(np.int64)


def _heavy(k: int, often: int):
    def count(batches):
        for batch in batches:
            sets = list(doc_shingles(batch.column("text"), k))
            every = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.zeros(0, int)
            times = np.diff(np.r_[first, len(every)])
            keep = times >= often
            yield pa.RecordBatch.from_arrays([pa.array(every[first[keep]].view(np.int64)), pa.array(times[keep])], names=["s", "times"])

    return count


def heavy_shingles(docs: DataFrame, k: int = 5, often: int = 8) -> np.ndarray:
    """Frequent shingles from the least to the most frequent, MOST_HEAVY at most.

    It only sets the order of shingles and which blocks count as large, so leaving some out costs time,
    not results.
    """
    found = docs.select("text").mapInArrow(lean(_heavy(k, often)), "s long, times long")
    top = found.groupBy("s").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "s").limit(MOST_HEAVY)
    return np.array([r.s for r in top.collect()][::-1], dtype=np.int64).view(np.uint64)


def node_of(own: np.ndarray) -> int:
    """A class's number: a 64-bit sum over its shingles, mixed again; equal sets have equal numbers."""
    return int(mix64(np.array([mix64(own).sum() + np.uint64(len(own))], np.uint64)).view(np.int64)[0])


def _pieces(batch, rows: int = 512):
    """A batch in parts, so that what is made of it stays small."""
    for first in range(0, batch.num_rows, rows):
        yield batch.slice(first, rows)


def _prefixes(k: int, heavy: np.ndarray):
    order = np.argsort(heavy)
    known = heavy[order]

    def make(batches):
        seen: set[int] = set()  # classes of this task: once is enough for their shingles
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            sizes, nodes, tiles, points, rare, often = [], [], [], [], [], []
            for own in doc_shingles(batch.column("text"), k):
                n = len(own)
                node = node_of(own) if n else None
                length = n - -(-NUM * n // DEN) + 1 if n and node not in seen else 0
                seen.add(node)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    is_heavy = known[at] == own
                    light, dense = own[~is_heavy][:length], own[is_heavy][np.argsort(order[at[is_heavy]])]
                else:
                    light, dense = own[:length], own[:0]
                sizes.append(n)
                nodes.append(node)
                tiles.append(tile(own))
                points.append(packed(point(own)))
                rare.append(listed(light, n))
                often.append(dense[: length - len(light)].view(np.int64))
            lists = [pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(x) for x in part])].astype(np.int32), pa.array(np.concatenate(part))) for part in (rare, often)]
            ids = [batch.column("doc_id").cast(pa.int64()), batch.column("row")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(tiles, pa.int64()), pa.array(points, pa.binary()), *lists], names=["doc_id", "row", "n", "node", "tile", "point", "rare", "often"])

    return make


def groups(n: int) -> int:
    """Number of groups: a power of two of about a quarter to half the size, so that points can be folded to fewer groups."""
    return 1 << max(4, min(12, int(n // 4).bit_length()))


def point(own: np.ndarray) -> np.ndarray:
    g = groups(len(own))
    counts = np.bincount((own & np.uint64(g - 1)).astype(np.int64), minlength=g)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32)


def packed(counts: np.ndarray) -> bytes:
    """A point as read_point takes it: two counts to a byte where all are under 16."""
    half = len(counts) // 2
    return (counts[:half] | counts[half:] << 4).astype(np.uint8).tobytes() if counts.max() < 16 else counts.tobytes()


def tile(own: np.ndarray) -> int:
    """Order of packing: the size in steps of a similar pair's greatest difference, then the counts of eight groups
    in quarters of their spread."""
    n = len(own)
    if not n:
        return 0
    counts = np.bincount((own & np.uint64(7)).astype(np.int64), minlength=8)
    quarter = np.searchsorted((-0.67, 0.0, 0.67), (counts - n / 8) / np.sqrt(n * 7 / 64), side="right")
    return (int(np.log(n) / np.log(DEN / NUM)) << 16) | int((quarter << np.arange(0, 16, 2)).sum())


def read_point(data: bytes, n: int) -> np.ndarray:
    g, own = groups(n), np.frombuffer(data, np.uint8)
    return np.r_[own & 15, own >> 4] if len(own) == g // 2 else own if len(own) == g else np.frombuffer(data, np.uint32)


def folded(p: np.ndarray, g: int) -> np.ndarray:
    """The counts in g groups of the same hash."""
    return p.reshape(-1, g).sum(axis=0, dtype=np.int64) if len(p) > g else p.astype(np.int64)


def _sets(k: int):
    def make(batches):
        seen: set[int] = set()  # classes of this task
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            own = {}
            for members in doc_shingles(batch.column("text"), k):
                node = node_of(members) if len(members) else None
                if node is not None and node not in seen:
                    seen.add(node)
                    own[node] = members
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([m.tobytes() for m in own.values()], pa.binary())], names=["node", "members"])

    return make


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed minima of every point of a (rows) with every point of b: no overlap is greater."""
    out = np.zeros((len(a), len(b)), np.int64)
    step = max(1, (1 << 22) // max(1, len(b) * a.shape[1]))
    for i in range(0, len(a), step):
        out[i : i + step] = np.minimum(a[i : i + step, None, :], b[None, :, :]).sum(axis=2, dtype=np.int64)
    return out


def needed(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Overlap from which two sets of these sizes are similar."""
    return -(-NUM * (na + nb) // (NUM + DEN))


def _candidates(n: np.ndarray, points: list[np.ndarray], leaf: np.ndarray) -> np.ndarray:
    """Pairs (i < j) of rows of two leaves (or of one, 0) whose sizes and points allow a link."""
    g = min(64, *(len(p) for p in points))
    at = np.array([folded(p, g) for p in points])
    at = at.astype(np.uint16) if at.max() < 1 << 16 else at
    one, other = (np.flatnonzero(leaf == 0), np.flatnonzero(leaf == 1)) if leaf.any() else (np.arange(len(n)), np.arange(len(n)))
    if not len(one) or not len(other):
        return np.zeros((0, 2), int)
    # The boxes of the leaves: beyond their greatest coordinates no pair of points can reach.
    if np.minimum(at[one].max(axis=0), at[other].max(axis=0)).sum(dtype=np.int64) < needed(n[one].min(), n[other].min()):
        return np.zeros((0, 2), int)
    na, nb = n[one][:, None], n[other][None, :]
    fits = (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)) & (bound(at[one], at[other]) >= needed(na, nb))
    i, j = np.nonzero(fits)
    pairs = np.column_stack([one[i], other[j]])
    return _finer(n, points, pairs if leaf.any() else pairs[pairs[:, 0] < pairs[:, 1]])


def _finer(n: np.ndarray, points: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """The pairs that the bound still leaves with as many groups as both points have."""
    kept, known = [], {}
    ends = np.flatnonzero(np.r_[pairs[1:, 0] != pairs[:-1, 0], True]) + 1 if len(pairs) else []
    first = 0
    for end in ends:
        i, others = pairs[first, 0], pairs[first:end, 1]
        sizes = np.array([len(points[j]) for j in others])
        for size in np.unique(sizes):  # one or two: partners differ by a third at most
            some, g = others[sizes == size], min(int(size), len(points[i]))
            for x in (i, *some):
                if (x, g) not in known:
                    known[x, g] = folded(points[x], g).astype(np.uint32)
            overlap = np.minimum(known[i, g], np.array([known[j, g] for j in some])).sum(axis=1, dtype=np.int64)
            good = some[overlap >= needed(n[i], n[some])]
            kept.append(np.column_stack([np.full(len(good), i), good]))
        first = end
    return np.concatenate(kept) if kept else np.zeros((0, 2), int)


def _verified(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """The similar pairs among pairs, from exact overlaps; shingles are taken some thousands at a time."""
    rows = np.unique(pairs)
    every = np.concatenate([sets[r] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    number = np.cumsum(np.r_[False, every[1:] != every[:-1]]) if len(every) else np.zeros(0, int)
    common = np.bincount(number)[number] > 1
    number, owner = np.unique(number[common], return_inverse=True)[1], owner[common]
    overlap, step = np.zeros((len(rows), len(rows))), 8192
    for first in range(0, int(number.max()) + 1 if len(number) else 0, step):
        lo, hi = np.searchsorted(number, (first, first + step))
        has = np.zeros((len(rows), step), np.float32)
        has[owner[lo:hi], number[lo:hi] - first] = 1
        overlap += has @ has.T
    at = np.searchsorted(rows, pairs)
    size = np.array([len(s) for s in sets])
    return pairs[overlap[at[:, 0], at[:, 1]] >= needed(size[pairs[:, 0]], size[pairs[:, 1]])]


def _parts(pairs: np.ndarray, count: int) -> np.ndarray:
    """For each of count rows the least row that pairs connect it with."""
    part = np.arange(count)
    while True:
        new = part.copy()
        np.minimum.at(new, pairs[:, 0], part[pairs[:, 1]])
        np.minimum.at(new, pairs[:, 1], part[pairs[:, 0]])
        new = new[new]
        if (new == part).all():
            return part
        part = new


def _spanning(pairs: np.ndarray, count: int) -> np.ndarray:
    """Pairs that connect all that pairs connects: fewer than count."""
    part = _parts(pairs, count)
    rest = np.flatnonzero(part != np.arange(count))
    return np.column_stack([part[rest], rest])


def _by_group(batches, keys: tuple[str, ...]):
    """(key, rows) of each run of equal keys in a sorted partition; a group is two leaves at most."""
    held: list[pa.RecordBatch] = []
    last = None
    together = lambda: held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.array([batch.column(k).to_numpy() for k in keys])
        ends = np.r_[np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1, batch.num_rows].tolist()
        for first, end in zip([0, *ends], ends):
            key = tuple(at[:, first].tolist())
            if key != last and held:
                yield last, together()
                held = []
            last = key
            held.append(batch.slice(first, end - first))
    if held:
        yield last, together()


def _bytes_of(column: pa.Array) -> list[memoryview]:
    """The values of a binary column, not copied."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1].tolist()
    data = memoryview(column.buffers()[2]) if column.buffers()[2] else memoryview(b"")
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def _pack(leaf_size: int):
    """Adds leaf to rows sorted by p and tile: runs of one p within the bounds, numbered throughout the table."""

    def pack(batches):
        from pyspark import TaskContext

        leaf, last, rows, size = TaskContext.get().partitionId() << 32, None, 0, 0
        for batch in batches:
            leaves = []
            for p, n in zip(*(batch.column(c).to_pylist() for c in ("p", "n"))):
                if p != last or rows == leaf_size or size + 8 * n > LEAF_BYTES:
                    leaf, last, rows, size = leaf + 1, p, 0, 0
                rows, size = rows + 1, size + 8 * n
                leaves.append(leaf)
            yield batch.append_column("leaf", pa.array(leaves, pa.int64()))

    return pack


def _boxes(batches):
    """Of each leaf: its least and greatest size, the greatest counts of its points, and its label where it has but one."""
    for (p, leaf), rows in _by_group(batches, ("p", "leaf")):
        n, label = rows.column("n").to_numpy(), rows.column("label").to_numpy()
        points = [read_point(x, m) for x, m in zip(_bytes_of(rows.column("point")), n)]
        g = min(BOX, *(len(x) for x in points))
        box = np.max([folded(x, g) for x in points], axis=0).astype(np.uint32)
        one = int(label[0]) if (label == label[0]).all() else None
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((p, pa.int64()), (leaf, pa.int64()), (int(n.min()), pa.int64()), (int(n.max()), pa.int64()), (box.tobytes(), pa.binary()), (one, pa.int64()))], names=["p", "leaf", "lo", "hi", "box", "label"])


class Tree:
    """The boxes of a cluster's leaves, in order, and those of their inner nodes."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, boxes: list[np.ndarray], label: list[int | None]):
        g = min(len(b) for b in boxes)
        pure = np.array([x is not None for x in label])
        level = (lo, hi, np.array([folded(b, g) for b in boxes]), pure, np.array([x or 0 for x in label], np.int64))
        self.levels, self.opened = [level], 0
        while len(level[0]) > 1:
            at = np.arange(0, len(level[0]), FANOUT)
            lo, hi, box, pure, label = level
            same = np.logical_and.reduceat(pure, at) & (np.minimum.reduceat(label, at) == np.maximum.reduceat(label, at))
            level = (np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(box, at, axis=0), same, label[at])
            self.levels.append(level)

    def search(self):
        """Pairs (i <= j) of leaves whose boxes allow a link between classes of different labels, some at a time."""
        yield from self._below(len(self.levels) - 1, np.zeros((1, 2), np.int64))

    def _below(self, depth: int, pairs: np.ndarray):
        pairs = pairs[self._may(depth, pairs)]
        self.opened += len(pairs)
        if not depth or not len(pairs):
            yield pairs
            return
        step, size = np.arange(FANOUT), len(self.levels[depth - 1][0])
        for first in range(0, len(pairs), 256):
            i, j = (pairs[first : first + 256] * FANOUT).T
            i, j = np.broadcast_arrays((i[:, None] + step)[:, :, None], (j[:, None] + step)[:, None, :])
            below = np.column_stack([i.ravel(), j.ravel()])
            yield from self._below(depth - 1, below[(below[:, 0] <= below[:, 1]) & (below[:, 1] < size)])

    def _may(self, depth: int, pairs: np.ndarray) -> np.ndarray:
        lo, hi, box, pure, label = self.levels[depth]
        i, j = pairs.T
        fits = (DEN * hi[i] >= NUM * lo[j]) & (DEN * hi[j] >= NUM * lo[i]) & ~(pure[i] & pure[j] & (label[i] == label[j]))
        at = np.flatnonzero(fits)
        fits[at] = np.minimum(box[i[at]], box[j[at]]).sum(axis=1) >= needed(lo[i[at]], lo[j[at]])
        return fits


def _open_leaves(batches):
    """(p, i, j) of pairs of leaves that the search of each cluster's tree ends in."""
    for (p,), rows in _by_group(batches, ("p",)):
        tree = Tree(rows.column("lo").to_numpy(), rows.column("hi").to_numpy(), [np.frombuffer(x, np.uint32) for x in _bytes_of(rows.column("box"))], rows.column("label").to_pylist())
        leaf = rows.column("leaf").to_numpy()
        for pairs in tree.search():
            ends = [leaf[pairs[:, k]] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), p), pa.int64()), *map(pa.array, ends)], names=["p", "i", "j"])


FOUND = "p long, i long, j long, part long, node long, leaf long"


def _found(place: tuple[int, int, int], pairs: np.ndarray, node: np.ndarray, leaf: np.ndarray) -> pa.RecordBatch:
    """Memberships FOUND of the ends of pairs.  Partners of partners have one part; pairs between parts are none."""
    used = np.unique(pairs)
    part = _parts(pairs, len(node))[used]
    return pa.RecordBatch.from_arrays([*(pa.array(np.full(len(used), x), pa.int64()) for x in place), *(pa.array(x, pa.int64()) for x in (part, node[used], leaf[used]))], names=["p", "i", "j", "part", "node", "leaf"])


def _search(batches):
    """FOUND of classes of two leaves, or of one, with a partner of another label that the bound leaves."""
    for place, rows in _by_group(batches, ("p", "i", "j")):
        n, leaf, node, label = (rows.column(c).to_numpy() for c in ("n", "leaf", "node", "label"))
        pairs = _candidates(n, [read_point(x, m) for x, m in zip(_bytes_of(rows.column("point")), n)], leaf)
        pairs = pairs[label[pairs[:, 0]] != label[pairs[:, 1]]]
        if len(pairs):
            yield _found(place, pairs, node, leaf)


def _search_small(batches):
    """FOUND of clusters that are leaves themselves; where their sets have more bytes than a leaf, of all pairs of their parts."""
    for (p,), rows in _by_group(batches, ("p",)):
        if rows.num_rows < 2:
            continue
        n, node = rows.column("n").to_numpy(), rows.column("node").to_numpy()
        points = [read_point(x, m) for x, m in zip(_bytes_of(rows.column("point")), n)]
        own = (np.cumsum(8 * n) - 1) // LEAF_BYTES
        for i in np.unique(own).tolist():
            for j in np.unique(own[own >= i]).tolist():
                at = np.flatnonzero((own == i) | (own == j))
                leaf = (own[at] == j).astype(np.int64) if i < j else np.zeros(len(at), np.int64)
                pairs = _candidates(n[at], [points[k] for k in at], leaf)
                if len(pairs):
                    yield _found((p, i, j), pairs, node[at], leaf)


def _links(batches):
    """Links (a, b) of labels that connect the similar classes of each group."""
    for _, rows in _by_group(batches, ("p", "i", "j", "part")):
        if rows.num_rows < 2:
            continue
        sets, leaf = [np.frombuffer(x, np.uint64) for x in _bytes_of(rows.column("members"))], rows.column("leaf").to_numpy()
        labels, label = np.unique(rows.column("label").to_numpy(), return_inverse=True)
        pairs = _candidates(np.array([len(s) for s in sets]), [point(s) for s in sets], leaf)
        pairs = pairs[label[pairs[:, 0]] != label[pairs[:, 1]]]
        if len(pairs):
            pairs = labels[_spanning(label[_verified(sets, pairs)], len(labels))]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _fetched(docs: DataFrame, rows: DataFrame, wanted: DataFrame, k: int) -> tuple[DataFrame, Callable[[], None]]:
    """Sets of the wanted classes (key), dealt out by class, and what removes them.

    rows (row, node): one document of each class is enough, known by its place in docs.  Should docs list its rows
    differently by now, classes are missing among the sets, and all documents are read.
    """
    one = rows.filter("node is not null").groupBy("node").agg(F.min("row").alias("key"))  # combined before the shuffle
    one = cut(one.join(wanted.withColumnRenamed("key", "node"), "node"))
    n = one.count()
    placed = docs.select("text", F.monotonically_increasing_id().alias("row"))
    # Filters of bounded size keep most other documents and classes out; the join is exact.
    sieve = lambda keys: _level(keys, max(8, min(n, 1 << 23)), 7, 8, 1 << 26)
    for some in (placed.filter(sieve(one.select("key")).passes(F.col("row"))), placed):
        sets = some.select("text").mapInArrow(lean(_sets(k)), "node long, members binary").filter(sieve(wanted).passes(F.col("node")))
        sets = sets.repartition(shuffle_partitions(docs.sparkSession), "node").dropDuplicates(["node"])
        table, drop = dealt_table(sets.join(wanted.withColumnRenamed("key", "node"), "node", "left_semi"), "node", "sets")
        if table.count() == n:
            break
        drop()
    else:
        raise ValueError("docs lists other texts than when it was read first")
    return table, drop


def _in_rare_blocks(feats: DataFrame, which: int) -> DataFrame:
    """(p, node) of the blocks of those rare shingles that this pass takes: runs of two classes or more without a gap in size."""
    key = F.shiftright("s", STEP_BITS)
    rare = feats.select("node", F.explode("rare").alias("s")).filter(key % PASSES == which).repartition(key)
    among = W.partitionBy("key")
    rare = rare.withColumn("key", key).withColumns({"lo": F.min("node").over(among), "hi": F.max("node").over(among)}).filter("lo < hi")
    rare = rare.select("key", F.col("s").bitwiseAND(F.lit((1 << STEP_BITS) - 1)).cast("int").alias("step"), "node").distinct()
    by_size = among.orderBy("step")
    gap = F.col("step") - F.lag("step", 1, -1).over(by_size) > STEPS
    rare = rare.withColumn("gap", gap.cast("int")).withColumn("run", F.sum("gap").over(by_size))
    in_block = W.partitionBy("key", "run")
    least = F.min(F.struct(F.xxhash64("node").alias("h"), "node")).over(in_block)["node"]
    return rare.select("node", least.alias("p"), F.count(F.lit(1)).over(in_block).alias("size")).filter("size > 1").select("p", "node")


def _clusters(feats: DataFrame) -> DataFrame:
    """(p, node): the classes of all blocks of two or more whose pivot is p, p itself among them."""
    # Frequent shingles: copies of a class repeat its postings, so distinct is partly done before the shuffle, and
    # the join on a block that holds much of the corpus can be split.
    often = cut(feats.filter(F.size("often") > 0).select("node", F.explode("often").alias("s")).distinct())
    pivots = cut(often.groupBy("s").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("p")))
    every = often.join(pivots, "s").select("p", "node")
    for which in range(PASSES):
        every = every.union(cut(_in_rare_blocks(feats, which)))
        release(feats.sparkSession)
    return every.distinct()


def _packed(members: DataFrame, leaf_size: int, *first: str) -> DataFrame:
    """members with their leaf: by p, then by first, then by tile."""
    keys = ["p", *first, "tile", "node"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema) + ", leaf long"
    return cut(members.repartitionByRange(shuffle_partitions(members.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(_pack(leaf_size), schema))


def _home(found: DataFrame) -> DataFrame:
    """Every class in one leaf only, that of its least pivot with a partner in it, and each such leaf's pivot.

    Near copies share most of their pivots, so they mostly meet there, and the pivot joins the leaves of a
    cluster.  What is missed is left to the second pass.
    """
    least = F.min(F.struct(F.xxhash64("p").alias("h"), "p", "i")).alias("at")
    leaves = found.filter("i = j").groupBy("node").agg(least).select("at.p", "at.i", "node")
    both = leaves.union(leaves.select("p", "i", F.col("p").alias("node"))).distinct()
    return both.selectExpr("p", "i", "i as j", "0L as part", "node", "0L as leaf", "node as label")


def _label_of(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _open(rows: DataFrame, *group: str) -> DataFrame:
    """The groups whose classes have several labels: combined before the shuffle."""
    return rows.groupBy(*group).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select(*group)


def _merged(labels: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """labels (node, label) after links (a, b) between labels, or between classes that have none."""
    if links.isEmpty():
        return labels
    joined = components(links)
    if labels is None:
        return joined
    far = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left").select("node", F.coalesce("far", "label").alias("label"))
    return cut(far.union(joined.join(labels, "node", "left_anti").select("node", "label")))


def _together(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with each pair of leaves in one partition, sorted."""
    places = ("p", "i", "j")
    return rows.repartition(shuffle_partitions(rows.sparkSession), *places).sortWithinPartitions(*places, *keys)


def _searched(rows: DataFrame) -> DataFrame:
    return _together(rows).mapInArrow(lean(_search), FOUND)


def _linked(found: DataFrame, sets: DataFrame) -> DataFrame:
    return cut(_together(found.join(sets, "node"), "part").mapInArrow(lean(_links), "a long, b long"))


def _met(docs: DataFrame, k: int, leaf_size: int) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Features per document, FOUND of the classes that meet in a leaf, and the leaves of large clusters if there are any."""
    n_parts = shuffle_partitions(docs.sparkSession)
    slim = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    feats = cut(slim.mapInArrow(lean(_prefixes(k, heavy_shingles(slim, k))), "doc_id long, row long, n long, node long, tile long, point binary, rare array<long>, often array<long>"))
    clusters = cut(_clusters(feats))
    slim = cut(feats.select("doc_id", "row", "n", "node"))
    release(docs.sparkSession)
    # Dealt out once for both joins; the shingles of feats are done with.
    points, drop = dealt_table(feats.filter("n > 0").select("node", "n", "tile", "point").dropDuplicates(["node"]), "node", "points")
    del feats
    release(docs.sparkSession)
    try:
        # Stored, so that the join on a large cluster is dealt out anew and can be split.
        sizes = cut(clusters.groupBy("p").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
        of_size = lambda which: clusters.join(sizes.filter(which).select("p"), "p").join(points, "node").select("p", "node", "n", "tile", "point")
        found = of_size(f"size <= {leaf_size}").repartition(n_parts, "p").sortWithinPartitions("p", "tile", "node").mapInArrow(lean(_search_small), FOUND)
        leaves = None
        if not sizes.filter(f"size > {leaf_size}").isEmpty():
            leaves = _packed(of_size(f"size > {leaf_size}"), leaf_size)
            pivots = leaves.select("p", "leaf").distinct().join(leaves.filter("p = node").select("p", "node", "n", "point", F.col("leaf").alias("own")), "p").filter("leaf <> own").drop("own")
            rows = leaves.select("p", "leaf", "node", "n", "point").unionByName(pivots)
            found = found.union(_searched(rows.selectExpr("p", "leaf as i", "leaf as j", "node", "n", "point", "0L as leaf", "node as label")))
        return slim, cut(found), leaves
    finally:
        drop()


def _met_in_trees(leaves: DataFrame, labels: DataFrame | None, leaf_size: int) -> DataFrame | None:
    """FOUND of the classes of large clusters with several labels that the search of their trees brings together."""
    n_parts = shuffle_partitions(leaves.sparkSession)
    known = _label_of(leaves.drop("leaf"), labels)
    # Classes of a cluster's greatest label stand together, so that leaves of that label alone need not meet.
    counts = known.groupBy("p", "label").agg(F.count(F.lit(1)).alias("_n"))
    greatest = counts.groupBy("p").agg(F.max(F.struct("_n", "label"))["label"].alias("_most"), F.count(F.lit(1)).alias("_labels"))
    greatest = cut(greatest.filter("_labels > 1").select("p", "_most"))
    if greatest.isEmpty():
        return None
    known = known.join(greatest, "p").withColumn("apart", (F.col("label") != F.col("_most")).cast("int")).drop("_most")
    leaves = _packed(known, leaf_size, "apart")
    boxes = leaves.repartition(n_parts, "p", "leaf").sortWithinPartitions("p", "leaf").mapInArrow(_boxes, "p long, leaf long, lo long, hi long, box binary, label long")
    pairs = cut(boxes.repartition(n_parts, "p").sortWithinPartitions("p", "leaf").mapInArrow(_open_leaves, "p long, i long, j long"))
    ends = pairs.selectExpr("*", "i as at", "0L as side").union(pairs.filter("i < j").selectExpr("*", "j as at", "1L as side"))
    rows = ends.withColumnRenamed("at", "leaf").join(leaves.select("p", "leaf", "node", "n", "point", "label"), ["p", "leaf"])
    return cut(_searched(rows.drop("leaf").withColumnRenamed("side", "leaf")))


def similar_classes(docs: DataFrame, k: int = 5, leaf_size: int = LEAF) -> tuple[DataFrame, DataFrame | None]:
    """(features per document, labels of linked classes).

    Each pass ends in what it has stored; its shuffle files and earlier cuts are given back before the next one.
    """
    spark = docs.sparkSession
    places = ("p", "i", "j", "part")
    slim, found, leaves = _met(docs, k, leaf_size)
    release(spark)
    labels = None
    if not found.isEmpty():
        sets, drop = _fetched(docs, slim, cut(found.select(F.col("node").alias("key")).distinct()), k)
        release(spark)
        try:
            labels = _merged(None, _linked(_home(found), sets))
            release(spark)
            known = _label_of(found, labels)
            labels = _merged(labels, _linked(known.join(cut(_open(known, *places)), list(places), "left_semi"), sets))
            del known
        finally:
            drop()
    if leaves is None:
        return slim, labels
    # Large clusters with several labels: their trees.
    del found
    release(spark)
    found = _met_in_trees(leaves, labels, leaf_size)
    if found is None or found.isEmpty():
        return slim, labels
    del leaves
    release(spark)
    sets, drop = _fetched(docs, slim, cut(found.select(F.col("node").alias("key")).distinct()), k)
    release(spark)
    try:
        return slim, _merged(labels, _linked(_label_of(found, labels), sets))
    finally:
        drop()


def _labelled(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, row, n, label) of every row of docs; label is null where a text has no word."""
    feats, labels = similar_classes(docs, k)
    if labels is None:
        return feats.withColumnRenamed("node", "label")
    return feats.join(labels, "node", "left").select("doc_id", "row", "n", F.coalesce("label", "node").alias("label"))


def ngram_join(docs: DataFrame, k: int = 5) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable by links).

    Cases: null and empty texts, and texts without a word, have an empty set and no link; a text of fewer
    than k words is one shingle; a text of any length is taken whole; repeated rows and texts are all returned;
    a tie in similarity (exactly 0.75) is a link; a null doc_id is never a component_id unless its component
    has no other.  An empty table gives an empty result.  Other columns are not read, whatever their names.
    """
    out = cut(_labelled(docs, k))
    release(docs.sparkSession)
    # Stored, so that the join on a large component is dealt out anew and can be split.
    least = cut(out.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least")))
    # Texts without words have no label; they are kept from meeting in one task of the join.
    linked = out.filter("label is not null").join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    alone = out.filter("label is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def one_of_each(docs: DataFrame, k: int = 5) -> DataFrame:
    """The rows of docs, with all columns, but one row of each component: that with the least doc_id.

    Texts without words are no copies of each other and all stay.  docs must list its rows alike each time it is
    read, as stored tables do: rows are known by their place in it.  A change is noticed and fails where it
    changes a row's doc_id.  Other cases as in ngram_join.
    """
    name, other = "_row", "_id"
    while {name, other} & set(docs.columns):
        name, other = f"_{name}", f"_{other}"
    out = cut(_labelled(docs, k))
    release(docs.sparkSession)
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    stays = out.filter("label is not null").groupBy("label").agg(F.min(first).alias("first")).select(F.col("first.row").alias(name), F.col("first.doc_id").alias(other))
    stays = stays.union(out.filter("label is null").select(F.col("row").alias(name), F.col("doc_id").alias(other)))
    kept = docs.withColumn(name, F.monotonically_increasing_id()).join(stays, name)
    moved = F.raise_error(F.lit("docs listed its rows differently when it was read again"))
    return kept.filter(F.when(F.col("doc_id").cast("long").eqNullSafe(F.col(other)), F.lit(True)).otherwise(moved.cast("boolean"))).drop(name, other)

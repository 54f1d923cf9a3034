"""The tree of a cluster: no pair of leaves that may hold a link is left out, and what is stored comes back."""

import numpy as np
import pytest

from imprintmatch.llm import ngram_join as J


def random_sets(rnd, k, n):
    """Families of near copies of several sizes."""
    out = []
    while len(out) < k:
        base = rnd.choice(1 << 50, rnd.integers(8, n), replace=False).astype(np.uint64)
        for _ in range(rnd.integers(1, 12)):
            keep = rnd.random(len(base)) > rnd.choice([0.0, 0.05, 0.2])
            out.append(np.union1d(base[keep], rnd.choice(1 << 50, 3).astype(np.uint64)))
    return out[:k]


@pytest.mark.parametrize("leaf_size", [1, 3, 16])
def test_tree_leaves_no_similar_pair_out(leaf_size):
    rnd = np.random.default_rng(leaf_size)
    sets = sorted(random_sets(rnd, 300, 200), key=J.tile)
    label = rnd.integers(0, 5, len(sets))
    leaf = np.arange(len(sets)) // leaf_size
    lo, hi, boxes, one = [], [], [], []
    for i in range(leaf[-1] + 1):
        own = [sets[k] for k in np.flatnonzero(leaf == i)]
        g = min(J.BOX, *(J.groups(len(s)) for s in own)) if len(own) > 1 else min(J.BOX, J.groups(len(own[0])))
        lo.append(min(map(len, own)))
        hi.append(max(map(len, own)))
        boxes.append(np.max([J.folded(J.point(s), g) for s in own], axis=0))
        labels = set(label[leaf == i].tolist())
        one.append(labels.pop() if len(labels) == 1 else None)
    tree = J.Tree(np.array(lo), np.array(hi), boxes, one)
    reached = {tuple(p) for pairs in tree.search() for p in pairs.tolist()}
    assert len(reached) <= (leaf[-1] + 1) * (leaf[-1] + 2) // 2
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if label[a] != label[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                assert (leaf[a], leaf[b]) in reached
    if leaf_size == 1:
        assert len(reached) < len(sets) ** 2 / 4  # sizes and boxes do cut


def test_leaves_of_one_label_do_not_meet():
    box = [np.full(16, 4)] * 30
    size = np.full(30, 64)
    tree = J.Tree(size, size, box, [7] * 29 + [8])
    assert {tuple(p) for pairs in tree.search() for p in pairs.tolist()} == {(i, 29) for i in range(29)}


def test_points_come_back():
    rnd = np.random.default_rng(2)
    for n in (1, 5, 40, 1000, 30000):
        own = np.unique(rnd.integers(0, 1 << 60, n).astype(np.uint64))
        for s in (own, own << np.uint64(14)):  # all in one group
            assert (J.read_point(J.packed(J.point(s)), len(s)) == J.point(s)).all()


def test_many_similar_and_odd_texts(spark, make_docs, monkeypatch):
    """A cluster of many leaves, of which not all belong together, and sets beyond a leaf's bytes."""
    from test_joins import brute_components

    monkeypatch.setattr(J, "LEAF_BYTES", 2000)
    rnd = np.random.default_rng(4)
    shared = [f"s{i}" for i in range(30)]
    texts = [" ".join(shared + [f"a{rnd.integers(0, 8)}" for _ in range(6)]) for _ in range(60)]
    texts += [" ".join(shared[:12] + [f"b{g}x{i}" for i in range(40)] + [f"c{rnd.integers(0, 3)}"]) for g in range(10) for _ in range(3)]
    want = brute_components(list(enumerate(texts)))
    for leaf_size in (4, 256):
        feats, labels = J.similar_classes(make_docs(texts), 5, leaf_size)
        out = feats.join(labels, "node", "left").selectExpr("doc_id", "n", "coalesce(label, node) as l").collect()
        least = {}
        for r in out:
            least[r.l] = min(least.get(r.l, r.doc_id), r.doc_id)
        assert sorted(((r.doc_id, r.n, least[r.l]) for r in out), key=repr) == want


def test_sets_are_found_where_rows_moved(spark, make_docs):
    """Rows are known by their place; where they have another one by now all documents are read."""
    from pyspark.sql import functions as F

    def numbered(batches):
        import pyarrow as pa

        from imprintmatch.llm import ngram_join as join
        from imprintmatch.llm.hashing import doc_shingles

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([join.node_of(s) for s in doc_shingles(b.column("text"))], pa.int64())], names=["row", "node"])

    docs = make_docs([f"text number {i} of many, of which each is alone" for i in range(50)])
    rows = docs.select("text", F.monotonically_increasing_id().alias("row")).mapInArrow(numbered, "row long, node long").cache()
    wanted = rows.filter("row % 3 = 0").select(F.col("node").alias("key"))
    want = {r.key for r in wanted.collect()}
    for moved in (docs, docs.orderBy(F.desc("doc_id")).coalesce(1)):
        table, drop = J._fetched(moved, rows, wanted, 5)
        assert {r.node for r in table.collect()} == want
        drop()
    with pytest.raises(ValueError):
        J._fetched(docs.filter("doc_id > 10"), rows, wanted, 5)

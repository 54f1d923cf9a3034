"""N-gram join, exact dedup and decontamination against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from imprintmatch.llm.components import components
from imprintmatch.llm.decontam import clean_documents, find_leaks, split_item
from imprintmatch.llm.exact_dedup import content_sort
from imprintmatch.llm.hashing import doc_shingles
from imprintmatch.llm.ngram_join import bound, folded, ngram_join, one_of_each, point, read_point


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def set_of(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [set_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                    parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def family(rnd, base, n, changes):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, changes)):
            w[rnd.randrange(len(w))] = f"x{rnd.random()}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("klmnop") + str(rnd.randrange(30))
    out = [None, "", " \n ", "one", "One", "a b c d", "A B C D", "a b c d e", "é ü", "x" * 5000]
    line = [word() for _ in range(40)]
    for size, n, changes in ((60, 40, 3), (200, 25, 12), (25, 30, 2), (120, 60, 7)):
        out += family(rnd, [word() for _ in range(size)], n, changes)
    out += [" ".join(line + [word() for _ in range(rnd.choice((5, 12, 40, 200)))]) for _ in range(60)]
    out += [" ".join(word() for _ in range(rnd.randrange(1, 80))) for _ in range(60)]
    out += out[20:40]
    return out


def test_join_equals_brute_force(spark, make_docs, texts):
    rows = list(enumerate(texts))
    got = sorted((tuple(r) for r in ngram_join(make_docs(texts)).collect()), key=repr)
    assert got == brute_components(rows)


def test_join_with_small_leaves(spark, make_docs, texts):
    from imprintmatch.llm import ngram_join as module

    want = brute_components(list(enumerate(texts)))
    for leaf_size in (2, 7):
        feats, labels = module.similar_classes(make_docs(texts), 5, leaf_size)
        out = feats.join(labels, "node", "left").select("doc_id", "n", F.coalesce("label", "node").alias("l")).collect()
        least = defaultdict(list)
        for r in out:
            least[r.l].append(r.doc_id)
        got = sorted(((r.doc_id, r.n, r.doc_id if r.l is None else min(least[r.l])) for r in out), key=repr)
        assert got == want


def test_join_odd_rows(spark, make_docs):
    docs = make_docs(["a b c d e f", "a b c d e f", "A b c d e f", "q"], ids=[5, 5, None, None]).withColumn("node", F.lit(1)).withColumn("row", F.lit("x"))
    assert sorted((tuple(r) for r in ngram_join(docs).collect()), key=repr) == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 1, None)], key=repr)
    assert ngram_join(docs.limit(0)).collect() == []
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=repr) == [(5, "a b c d e f"), (None, "q")]


def test_bound_is_an_upper_bound():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        a = rnd.choice(1 << 40, rnd.integers(1, 300), replace=False).astype(np.uint64)
        b = np.union1d(rnd.choice(a, max(1, len(a) // 2), replace=False), rnd.choice(1 << 40, 20).astype(np.uint64))
        g = min(len(point(a)), len(point(b)))
        assert bound(folded(point(a), g)[None], folded(point(b), g)[None])[0, 0] >= len(np.intersect1d(a, b))
        assert (read_point(point(b).tobytes(), len(b)) == point(b)).all()
    same = np.full(700, 16, np.uint64)
    assert (read_point(point(same).tobytes(), 700) == point(same)).all() and point(same).max() == 700


def test_shingles_of_long_and_odd_texts():
    texts = ["w " * 30000 + "end", "a" * 700_000 + " b", "", None, "a b"]
    got = [len(s) for s in doc_shingles(pa.array(texts))]
    assert got == [len(set_of(t)) for t in texts]


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 50)] + [(rnd.randrange(500, 600), rnd.randrange(500, 600)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_content_sort(spark, make_docs, keep):
    rnd = random.Random(4)
    texts = [None, "", "é", "e"] + ["hot"] * 300 + [rnd.choice(["a", "b", "aa", "a" * 70, "a" * 71, "A"]) for _ in range(150)] + ["y" * 100_000] * 2
    got = content_sort(make_docs(texts).withColumn("_text", F.lit(1)), keep=keep).collect()
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[t or ""].append(i)
    pick = max if keep == "largest" else min
    want = {i: (pick(groups[t or ""]), len(groups[t or ""]), i == pick(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in enumerate(texts)}
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want
    assert len(got) == len(texts)


def test_content_sort_odd_rows(spark, make_docs):
    docs = make_docs(["a", "a", "a", "b", "b"], ids=[1, 1, None, None, None])
    got = content_sort(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got if r.doc_id is not None) == [(1, 1, 3), (1, 1, 3)]
    assert sum(r.kept for r in got) == 2
    assert content_sort(docs.limit(0)).collect() == []


ITEMS = [
    (1, "What is the tallest hill beyond the old river town of Brandl? The tallest hill is called Kestrel Mount by all."),
    (2, "name three rare metals found under the lake\nosmium rhenium and hafnium were all found there"),
    (3, "single"),
    (4, None),
    (5, ""),
    (6, "plain words without any stop at all just going on and on for a while longer here"),
]


def test_leaks(spark, make_docs):
    rnd = random.Random(9)
    filler = lambda n: " ".join(rnd.choice(["the", "hill", "of", "and", "lake", "w%d" % rnd.randrange(400)]) for _ in range(n))
    leak = {i: t for i, t in ITEMS if t}
    texts = [filler(300) + " " + leak[1] + " " + filler(5), leak[2].upper().replace(" ", "  "), filler(3000) + "\n" + leak[6] + "\n" + filler(2000), filler(500), None, "", leak[1].split("?")[0], leak[6] + " " + leak[2]]
    texts += [filler(200) for _ in range(40)]
    docs = make_docs(texts)
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_leaks(docs, benchmark).collect()}
    assert got == {(0, 1), (1, 2), (2, 6), (7, 6), (7, 2)}
    clean = clean_documents(docs, benchmark)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {0, 1, 2, 7}
    assert find_leaks(docs.limit(0), benchmark).collect() == []
    assert find_leaks(docs, benchmark.limit(0)).collect() == []
    assert clean_documents(docs, benchmark.filter("item_id > 3 and item_id < 6")).count() == len(texts)


def test_items_are_split():
    assert split_item(ITEMS[0][1]) == ("What is the tallest hill beyond the old river town of Brandl?", "The tallest hill is called Kestrel Mount by all.")
    assert split_item(ITEMS[1][1])[1].startswith("osmium")
    assert split_item("one two three") == ("one two", "three")

"""Line dedup against a plain version, its filters against sets, and the store's steps against building it at once."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest

from imprintmatch.llm import lines as L

WORDS = [f"line number {k} of the text" for k in range(40)]
TEXTS = [
    "\n".join([WORDS[0], "short", WORDS[1], WORDS[1]]), "\n".join(["  " + WORDS[0].upper() + "\t", "short", "own words only"]), None, "", "\n", f"{WORDS[1]}\n\n{WORDS[2]}\n",
    "ÄÖÜ is not lower-cased here\nnot lower", "äöü is not lower-cased here", "exactly 10\nonly nine", "exactly 10\nonly nine", "\r\n".join(WORDS[:5]), "x" * 50_000 + "\n" + WORDS[3], "\n".join(WORDS),
]


def plain(rows):
    def key(line):
        bare = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))
        return bare if len(bare) >= 10 else None

    least = {}
    for doc_id, text in rows:
        for k in map(key, (text or "").split("\n")):
            if doc_id is not None:
                least[k] = min(least.get(k, doc_id), doc_id)
    for doc_id, text in rows:
        split = (text or "").split("\n")
        kept = [x for x in split if key(x) is None or least.get(key(x), doc_id) == doc_id]
        yield doc_id, len(split), len(split) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()


def order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("most", [L.MOST_BROADCAST, -1])
def test_lines_equal_the_plain_version(make_docs, monkeypatch, most):
    monkeypatch.setattr(L, "MOST_BROADCAST", most)
    ids = [7, 3, 3, 8, None, 1, 2, 10, 12, 11, 20, 21, None]
    docs = make_docs(TEXTS, ids).selectExpr("*", "'x' as keys", "1 as line", "2 as `print`", "3 as step", "4 as lines", "5 as key")
    docs = docs.unionByName(docs.filter("doc_id = 7 or doc_id = 20"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert order(L.line_digest(docs).collect()) == order(plain(rows))
    assert L.line_digest(docs.limit(0)).count() == 0


def test_store_takes_in_and_gives_back(spark, make_docs):
    parts = {n: make_docs(["\n".join(WORDS[k % 40] if k % 3 else f"{n} has line {k}" for k in range(n, n + 30)) for _ in range(3)], range(10 * n, 10 * n + 3)) for n in range(4)}

    def lost(store):
        return {(r.doc_id, bytes(r.print)): sorted(r.lines) for r in store.dropped().collect()}

    def once(*names):
        store = L.LineStore(spark, shards=3)
        for n in names[:1]:
            both = parts[n]
            for m in names[1:]:
                both = both.unionByName(parts[m])
            store.insert(both)
        return store

    store = L.LineStore(spark, shards=3)
    store.insert(parts[1])
    store.insert(parts[0])
    assert lost(store) == lost(once(0, 1))
    store.insert(parts[2])
    store.insert(parts[3])
    assert lost(store) == lost(once(0, 1, 2, 3))
    store.remove(parts[0])
    assert lost(store) == lost(once(1, 2, 3))
    assert order(store.counts().collect()) == order(once(1, 2, 3).counts().collect())
    store.remove(parts[2])
    store.insert(parts[0])
    store.insert(parts[2])
    assert lost(store) == lost(once(0, 1, 2, 3))
    filters = store.filters().agg({"used": "sum"}).first()[0]
    assert filters == once(0, 1, 2, 3).filters().agg({"used": "sum"}).first()[0]
    store.remove(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    assert store.counts().count() == 0 and store.filters().agg({"used": "sum"}).first()[0] == 0


def test_cuckoo_filter_finds_all_and_drops_what_it_was_given():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
    filled = L.Cuckoo(8192)
    assert filled.add(keys[:12_000]) and filled.add(keys[12_000:])
    assert filled.has(keys).all() and filled.used == 20_000 == np.count_nonzero(filled.slots)
    others = rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)
    assert filled.has(others).mean() < 0.001
    filled.drop(keys[:15_000])
    assert filled.has(keys[15_000:]).all() and filled.has(keys[:15_000]).mean() < 0.001
    assert np.count_nonzero(filled.slots) == filled.used == 5_000
    full = L.Cuckoo(16)
    assert not full.add(keys[:60])
    assert L._built(keys).has(keys).all()

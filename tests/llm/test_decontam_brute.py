"""Decontamination against exhaustive BM25 and overlap, and its odd rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from imprintmatch.llm import decontam as D


def words(text):
    return re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7F])+", (text or ""))


def lower(ws):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws]


def brute(docs, items):
    """Pairs by scoring every passage with every item, each item alone: passages are twice the next power of two of its words long, half overlapping."""
    texts = [lower(words(t)) for _, t in docs]
    df = Counter(w for t in texts for w in set(t))
    parsed = [(i, lower(words(t)), [lower(words(p)) for p in D.split_item(t)]) for i, t in items if lower(words(t))]
    idf = lambda w: math.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5))
    grams = lambda ws, k: {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)}
    out = set()
    for item, own, parts in parsed:
        span = 1
        while span < len(own):
            span *= 2
        counts = Counter(own)
        weight = {w: idf(w) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(own) / 40)) for w, c in counts.items()}
        parts = [grams(p, min(5, len(p))) for p in parts if p]
        for (doc, _), text in zip(docs, texts):
            if (doc, item) in out or not counts.keys() & set(text):
                continue
            for begin in range(0, len(text), span):
                passage = text[begin : begin + 2 * span]
                there = set(passage)
                if sum(v for w, v in weight.items() if w in there) < 0.6 * sum(weight.values()) - 1e-9:
                    continue
                shares = [len(p & grams(passage, len(next(iter(p))))) / len(p) for p in parts]
                if shares[0] >= 0.5 and shares[-1] >= 0.5:
                    out.add((doc, item))
    return out


@pytest.fixture(scope="module")
def world():
    rnd = random.Random(17)
    vocab = [f"w{i}" for i in range(150)] + ["é", "straße", "日本"]
    say = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, f"{say(rnd.randint(6, 14))}?{rnd.choice([chr(10), ' '])}{say(rnd.randint(3, 9))}.") for i in range(40)]
    docs = []
    for i in range(150):
        parts = [say(rnd.randint(0, 60))]
        for _, item in rnd.sample(items, rnd.choice([0, 0, 1, 2])):
            own = item.split(" ")
            for _ in range(rnd.choice([0, 0, 1, 3, 6])):
                own[rnd.randrange(len(own))] = rnd.choice(vocab)
            cut = rnd.choice([0, 0, 0, 3])
            parts += [rnd.choice([" ".join, ", ".join])(own[cut:]).upper() if rnd.random() < 0.3 else " ".join(own[cut:]), say(rnd.randint(0, 40))]
        docs.append((i, " ".join(parts)))
    return docs + [(200, None), (201, ""), (202, " \n"), (203, say(30000) + " " + items[3][1])], items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_pairs_equal_exhaustive_search(spark, world):
    docs, items = world
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(*frames(spark, docs, items)).collect()}
    want = brute(docs, items)
    assert got == want and 40 < len(want) < 400 and (203, 3) in want


def leaks(spark, docs, items):
    return sorted(map(tuple, D.find_leaks(*frames(spark, docs, items)).collect()))


def test_any_split_and_any_further_item_give_the_same(spark, world, monkeypatch):
    docs, items = world
    one = leaks(spark, docs, items)
    for name, most in (("WORDS_PER_INDEX", 100), ("ITEMS_PER_INDEX", 3), ("TERMS_PER_PASS", 40)):
        monkeypatch.setattr(D, name, most)
        assert leaks(spark, docs, items) == one
        monkeypatch.undo()
    more = [(900, " ".join(f"z{k}" for k in range(404)) + "? y x."), (901, "w1 w2? w3."), (902, " ".join(f"w{k % 150}" for k in range(1000)))]
    assert [r for r in leaks(spark, docs, items + more) if r[1] < 900] == one
    assert [r for k in range(0, 40, 10) for r in leaks(spark, docs, items[k : k + 10])] == [r for k in range(0, 40, 10) for r in one if k <= r[1] < k + 10]
    kept = {r.doc_id for r in D.clean_documents(*frames(spark, docs, items)).collect()}
    assert {200, 201, 202} <= kept and 203 not in kept and kept == {d for d, _ in docs} - {r[0] for r in one}


def test_parts_far_apart_are_no_pair(spark):
    item = (1, "one two three four five six seven?\neight nine ten eleven twelve thirteen.")
    question, answer = item[1].split("\n")
    docs = [(0, f"{question} {answer}"), (1, question + " filler" * 200 + " " + answer), *((k, f"other words {k}") for k in range(2, 30))]
    long_one = (2, " ".join(f"q{k}" for k in range(404)) + "? a b.")
    for items in ([item], [item, long_one]):
        assert [r[:2] for r in leaks(spark, docs, items)] == [(0, 1)]


def test_odd_rows_and_names(spark, world):
    docs, items = world
    d, b = frames(spark, docs[:20] * 2 + [(None, items[0][1])], items + [(None, "x y z?\nw"), (77, None), (78, "")])
    d = d.withColumns({"item_id": F.lit(1), "question_overlap": F.lit("q"), "terms": F.lit(0)})
    rows = D.find_leaks(d, b).collect()
    assert any(r.doc_id is None and r.item_id == 0 for r in rows)
    counts = Counter((r.doc_id, r.item_id) for r in rows if r.doc_id is not None)
    assert set(counts.values()) <= {2} and not {77, 78, None} & {i for _, i in counts}
    assert D.find_leaks(d.limit(0), b).collect() == [] and D.find_leaks(d, b.limit(0)).collect() == []
    assert D.clean_documents(d, b.limit(0)).columns == d.columns

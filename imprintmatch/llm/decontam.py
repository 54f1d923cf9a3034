"""Benchmark decontamination by a BM25 index of test items.

Every passage of every training text is a query.  Items stand in blocks; for each term a block holds the
greatest impact of its items, as a share of what the item needs to be retrieved.  A passage first meets
the terms that an item cannot do without (its pivots), then the block maxima, and only blocks that can
still reach an item's threshold are scored in full.  All of it is done on arrays over a batch of
passages.  Retrieved pairs are verified on the words: enough of the question's and of the answer's
shingles must stand in the passage.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean
from .hashing import Words, mix64, slices, utf8

#: Share of an item's own score that a passage needs to be retrieved.
THRESHOLD = 0.6
#: Shares of the shingles of a question and of an answer that verify a pair.
OVERLAP = 0.5
SHINGLE = 5
BLOCK = 8
K1, B = 1.2, 0.75
#: Items and words of one index, about; more are taken in turns, each with an index of its own.
ITEMS_PER_INDEX, WORDS_PER_INDEX = 20_000, 4_000_000
#: Terms that are counted in one pass over the documents (8 bytes each in every task).
TERMS_PER_PASS = 4_000_000
#: The length over which words count less; a stated value, so that no item depends on the others.
AVERAGE = 40
#: A sum of shares that reaches the threshold, rounding aside.
REACHED = 1 - 1e-9


def normal(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with everything but ASCII letters, digits and non-ASCII bytes as spaces."""
    data, offsets = utf8(text)
    return _FORM[data], offsets


_FORM = np.array([b if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last line, else the last sentence, else the last third of the words."""
    parts = [x for x in text.strip().split("\n") if x.strip()]
    if len(parts) < 2:
        parts = [x for x in re.split(r"(?<=[.?!])\s+", text.strip()) if x]
    if len(parts) < 2:
        words = text.split()
        at = len(words) - max(1, len(words) // 3)
        return " ".join(words[:at]), " ".join(words[at:])
    return " ".join(parts[:-1]), parts[-1]


def _hashes(text: str) -> np.ndarray:
    data, offsets = normal(pa.array([text]))
    return Words(data, offsets, 0, 1).hashes


def _rolled(h: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        out = mix64(out * np.uint64(31) + h[i : i + len(out)])
    return out


@dataclass
class Item:
    item_id: int
    terms: np.ndarray
    counts: np.ndarray
    n_words: int
    parts: list[tuple[int, np.ndarray]] = field(default_factory=list)  # shingle length and shingles of question, answer


def read_items(rows: list[tuple[int, str]]) -> list[Item]:
    out = []
    for item_id, text in rows:
        h = _hashes(text or "")
        if not len(h) or item_id is None:
            continue
        terms, counts = np.unique(h, return_counts=True)
        parts = []
        for part in split_item(text):
            own = _hashes(part)
            if len(own):
                k = min(SHINGLE, len(own))
                parts.append((k, np.unique(_rolled(own, k))))
        out.append(Item(item_id, terms, counts, len(h), parts))
    return out


def _csr(rows: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(rows, np.arange(n + 1))


def _expand(starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For list numbers `at` of a CSR: (which element of at, place in the lists) of every entry."""
    sizes = starts[at + 1] - starts[at]
    which = np.repeat(np.arange(len(at)), sizes)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[at], sizes)
    return which, place


class Class:
    """Items of one length class of an index in blocks of BLOCK; impacts are shares of the item's threshold.

    numbers: places of the items in the index; terms are numbered as in the index.
    """

    def __init__(self, span: int, numbers: list[int], items: list[Item], terms: np.ndarray, idf: np.ndarray, threshold: float):
        self.span, self.numbers, self.n_items = span, np.array(numbers), len(numbers)
        term, item, impact, pivot = [], [], [], []
        for number, i in enumerate(items):
            at = np.searchsorted(terms, i.terms)
            weight = idf[at] * i.counts * (K1 + 1) / (i.counts + K1 * (1 - B + B * i.n_words / AVERAGE))
            share = weight / (threshold * weight.sum())
            # Terms from the weakest on whose sum stays under the threshold are no pivots: without a pivot no retrieval.
            order = np.argsort(share, kind="stable")
            weak = np.cumsum(share[order]) < REACHED
            own = np.ones(len(at), bool)
            own[order[weak]] = False
            term.append(at), item.append(np.full(len(at), number)), impact.append(share), pivot.append(own)
        term, item, impact, pivot = map(np.concatenate, (term, item, impact, pivot))
        order = np.lexsort((item, term))
        self.term, self.item, self.impact, pivot = term[order], item[order], impact[order], pivot[order]
        self.postings = _csr(self.term, len(terms))
        self.has = np.diff(self.postings) > 0
        self.pivot_item = self.item[pivot]
        self.pivots = _csr(self.term[pivot], len(terms))
        block = self.item // BLOCK
        first = np.flatnonzero(np.r_[True, (self.term[1:] != self.term[:-1]) | (block[1:] != block[:-1])])
        self.block, self.block_max = block[first], np.maximum.reduceat(self.impact, first)
        self.blocks = _csr(self.term[first], len(terms))
        self.n_blocks = int(block.max()) + 1

    def retrieve(self, window: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of distinct rows (window, term), ordered by window, that reach the threshold.

        A pair's impacts are summed in the order of its terms, whatever other items there are.
        """
        none = np.zeros(0, np.int64)
        which, place = _expand(self.pivots, term)
        if not len(which):
            return none, none
        wanted = np.unique(window[which] * self.n_blocks + self.pivot_item[place] // BLOCK)
        # Only windows that met a pivot go on.
        keep = np.isin(window, wanted // self.n_blocks)
        window, term = window[keep], term[keep]
        which, place = _expand(self.blocks, term)
        key = window[which] * self.n_blocks + self.block[place]
        at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
        hit = wanted[at] == key
        most = np.bincount(at[hit], weights=self.block_max[place][hit], minlength=len(wanted))
        wanted = wanted[most >= REACHED - 1e-9]  # a bound: never below the sums that it stands for
        if not len(wanted):
            return none, none
        keep = np.isin(window, wanted // self.n_blocks)
        window, term = window[keep], term[keep]
        which, place = _expand(self.postings, term)
        key = window[which] * self.n_blocks + self.item[place] // BLOCK
        hit = np.isin(key, wanted)
        pair = window[which][hit] * self.n_items + self.item[place][hit]
        pairs, back = np.unique(pair, return_inverse=True)
        score = np.bincount(back, weights=self.impact[place][hit])
        pairs = pairs[score >= REACHED]
        return pairs // self.n_items, self.numbers[pairs % self.n_items]

    def windows(self, at: np.ndarray, known: np.ndarray, doc: np.ndarray, starts: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct windows * terms, first stride of each text) of the known words `at`.

        A window is two strides of span words long, so that every run of span words lies in one.
        """
        strides = per_doc // self.span + 1
        base = np.cumsum(strides) - strides
        mine = self.has[at]
        at, known, doc = at[mine], known[mine], doc[mine]
        stride = base[doc] + (known - starts[doc]) // self.span
        later = stride > base[doc]
        return np.unique(np.r_[stride, stride[later] - 1] * len(self.has) + np.r_[at, at[later]]), base


class Index:
    """Items by length class.

    What an item meets depends on the item and the corpus alone: passages are as long as its class of lengths says (the
    next power of two), terms weigh by the corpus and by its own length over a stated average.  So items may be dealt
    over indexes in any way.
    """

    def __init__(self, items: list[Item], terms: np.ndarray, seen: np.ndarray, n_docs: int, threshold: float = THRESHOLD):
        """terms, seen: documents that hold each term, by ascending term."""
        self.items = items
        self.terms = np.unique(np.concatenate([i.terms for i in items]))
        at = np.minimum(np.searchsorted(terms, self.terms), max(0, len(terms) - 1))
        own = np.where(terms[at] == self.terms, seen[at], 0).astype(float) if len(terms) else np.zeros(len(self.terms))
        idf = np.log1p((n_docs - own + 0.5) / (own + 0.5))
        spans: dict[int, list[int]] = {}
        for number, item in enumerate(items):
            spans.setdefault(span_of(item.n_words), []).append(number)
        self.classes = [Class(span, numbers, [items[k] for k in numbers], self.terms, idf, threshold) for span, numbers in sorted(spans.items())]

    def verify(self, words: np.ndarray, item: int) -> tuple[float, float]:
        """Shares of the question's and the answer's shingles among the words of a passage."""
        shares = [float(np.isin(own, _rolled(words, k)).mean()) for k, own in self.items[item].parts]
        return (shares[0], shares[-1]) if shares else (0.0, 0.0)

    def search(self, text: pa.Array):
        """(row, item number, question share, answer share) of verified pairs of a text column."""
        data, offsets = normal(text)
        for first, last in slices(offsets):
            words = Words(data, offsets, first, last)
            h = words.hashes
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
            known = np.flatnonzero(self.terms[at] == h)
            if not len(known):
                continue
            ends = np.cumsum(words.per_doc)
            starts = ends - words.per_doc
            doc = np.searchsorted(ends, known, side="right")
            best: dict[tuple[int, int], tuple[float, float]] = {}
            for own in self.classes:
                rows, base = own.windows(at[known], known, doc, starts, words.per_doc)
                for window, item in zip(*(x.tolist() for x in own.retrieve(rows // len(self.terms), rows % len(self.terms)))):
                    d = int(np.searchsorted(base, window, side="right")) - 1
                    begin = int(starts[d] + (window - base[d]) * own.span)
                    q, a = self.verify(h[begin : min(begin + 2 * own.span, int(ends[d]))], item)
                    if q >= OVERLAP and a >= OVERLAP:
                        best[d, item] = max(best.get((d, item), (0.0, 0.0)), (q, a))
            for (d, item), (q, a) in best.items():
                yield first + d, item, q, a


def span_of(n_words: int) -> int:
    """The length class of an item: the next power of two."""
    return 1 << max(0, n_words - 1).bit_length()


def term_counts(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(terms, number of documents that hold each, number of documents), over all documents; terms no document holds are left out or 0."""

    def count(batches):
        seen, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            data, offsets = normal(batch.column("text"))
            n += batch.num_rows
            for first, last in slices(offsets):
                words = Words(data, offsets, first, last)
                if not len(words.hashes) or not len(terms):
                    continue
                at = np.minimum(np.searchsorted(terms, words.hashes), len(terms) - 1)
                known = terms[at] == words.hashes
                pairs = np.unique(words.doc_of()[known] * len(terms) + at[known])
                seen += np.bincount(pairs % len(terms), minlength=len(terms))
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[terms[own].view(np.int64)]), pa.array(seen[own]), pa.array(np.zeros(len(own), np.int64))], names=["term", "seen", "rows"])
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([n], pa.int64())], names=["term", "seen", "rows"])

    found = docs.select("text").mapInArrow(lean(count), "term long, seen long, rows long").groupBy("term").agg(F.sum("seen").alias("seen"), F.sum("rows").alias("rows")).toArrow()
    term, seen = found.column("term").to_numpy().view(np.uint64), found.column("seen").to_numpy()
    order = np.argsort(term)
    return term[order], seen[order], int(pc.sum(found.column("rows")).as_py() or 0)


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()


def item_terms(items: DataFrame) -> DataFrame:
    """(term) distinct hashes of the items' words."""

    def terms(batches):
        for batch in batches:
            data, offsets = normal(batch.column("text"))
            for first, last in slices(offsets):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(Words(data, offsets, first, last).hashes).view(np.int64))], names=["term"])

    return items.select("text").mapInArrow(terms, "term long").distinct()


def _counted(docs: DataFrame, items: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(terms, documents that hold each, documents) of all items: one pass over the documents for every TERMS_PER_PASS terms."""
    terms = cut(item_terms(items))
    passes = max(1, -(-terms.count() // TERMS_PER_PASS))
    found = []
    for k in range(passes):
        own = terms.filter(F.pmod(F.xxhash64("term"), F.lit(passes)) == k).toArrow().column("term").to_numpy()
        found.append(term_counts(docs, np.sort(own.view(np.uint64))))
    term, seen = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    order = np.argsort(term)
    return term[order], seen[order], found[0][2]


def _indexes(docs: DataFrame, benchmark: DataFrame, threshold: float):
    """Broadcast indexes of all items, ITEMS_PER_INDEX at a time, so that each has a bounded size."""
    rows = cut(_items(benchmark))
    n, words = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()
    turns = max(1, -(-n // ITEMS_PER_INDEX), -(-words // WORDS_PER_INDEX))
    counts = _counted(docs, rows) if n else None
    for turn in range(turns if n else 0):
        own = rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn).orderBy("item_id", "text").toArrow()
        items = read_items(list(zip(own.column("item_id").to_pylist(), own.column("text").to_pylist())))
        if items:
            yield docs.sparkSession.sparkContext.broadcast(Index(items, *counts, threshold))


LEAKS = "doc_id long, item_id long, question_overlap double, answer_overlap double"


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Contaminated pairs: doc_id, item_id, question_overlap, answer_overlap.

    The items are a stated query set; every index of theirs meets all documents.

    Cases: items and texts that are null or without words match nothing; a text of any length is cut into
    passages, a score or share that just reaches its bound counts; repeated documents are reported as often as
    they stand there, repeated items once; a null doc_id is kept, an item without an id is left out; an empty
    table gives no rows.  Other columns of docs are not read, whatever their names.
    """
    slim = docs.select("doc_id", "text")
    out = docs.sparkSession.createDataFrame([], LEAKS)
    for sent in _indexes(slim, benchmark, threshold):

        def search(batches, sent=sent):
            index = sent.value
            for batch in batches:
                found = list(index.search(batch.column("text")))
                ids = batch.column("doc_id").cast(pa.int64()).take(pa.array([x[0] for x in found], pa.int64()))
                own = [pa.array([index.items[x[1]].item_id for x in found], pa.int64()), *(pa.array([x[k] for x in found], pa.float64()) for k in (2, 3))]
                yield pa.RecordBatch.from_arrays([ids, *own], names=["doc_id", "item_id", "question_overlap", "answer_overlap"])

        out = out.union(slim.mapInArrow(lean(search), LEAKS))
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, whose text holds no test item; nothing is shuffled.  Cases as in find_leaks."""
    out = docs
    for sent in _indexes(docs, benchmark, threshold):

        def clean(batches, sent=sent):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in sent.value.search(batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(lean(clean), docs.schema)
    return out

"""A quality classifier by co-training.

One view sees the text, the other only what is stored beside it (lang, source, n_chars).  Starting from the
same labelled rows, each view names the unlabelled rows of the whole corpus that it is surest of, as many of
either kind as the labels' base rate says, and these join the training rows of the other view with the
probability that the naming view's calibration gives them.  After some rounds both are calibrated on labelled
rows that neither was trained on, and their calibrated log-odds are combined.

Sure is meant relative to the view itself: its highest and lowest scores, where its calibration puts them
above and below the base rate.  A view whose calibration finds nothing in it passes on next to nothing.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean
from .hashing import Words, slices, utf8
from .models import fit_logistic, sigmoid

#: Labelled rows that the views are fitted on, and unlabelled rows that their scale is taken from, at most:
#: those with the least hash of their id.  What the views pass on comes from all rows.
MAX_LABELLED, MAX_UNLABELLED = 20_000, 20_000
ROUNDS = 3
#: Rows that a view passes on in a round, as a share of the labelled rows.
PASS_ON = 0.1
#: Bins of log-odds, from -SPAN to SPAN, in which the corpus is counted.
BINS, SPAN = 4096, 16.0
REJECT_BELOW = 0.5

LANGS, SOURCES = 16, 32
_KINDS = 13
#: Columns of the content view.
CONTENT = 1 + _KINDS + 11


def _kind(b: int) -> int:
    if 97 <= b <= 122:
        return 0
    if 65 <= b <= 90:
        return 1
    if 48 <= b <= 57:
        return 2
    if b >= 128:
        return 3
    if b in (9, 11, 12, 13, 32):
        return 4
    if b == 10:
        return 5
    return {"|": 6, "!": 7, "#": 8, "$": 8, "%": 8, "&": 8, "*": 8, "<": 9, ">": 9, "{": 9, "}": 9, ";": 9, "=": 9, "/": 10, "@": 10, ".": 11, ",": 11}.get(chr(b), 12)


_KIND = np.array([_kind(b) for b in range(256)], np.int64)


def content_view(text: pa.Array) -> np.ndarray:
    """Rates of character kinds, word lengths and repetition of each text; a constant first."""
    data, offsets = utf8(text)
    n = len(text)
    kinds, words_n, distinct, same, pairs, long_words = np.zeros((n, _KINDS)), *(np.zeros(n) for _ in range(5))
    for first, last in slices(offsets):
        words = Words(data, offsets, first, last)
        span = offsets[first : last + 1] - offsets[first]
        doc = np.repeat(np.arange(last - first), np.diff(span))
        own = _KIND[data[offsets[first] : offsets[last]]]
        kinds[first:last] = np.bincount(doc * _KINDS + own, minlength=(last - first) * _KINDS).reshape(-1, _KINDS)
        words_n[first:last] = words.per_doc
        h = words.hashes
        if not len(h):
            continue
        at = words.doc_of()
        order = np.lexsort((h, at))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (at[order][1:] != at[order][:-1])]
        distinct[first:last] = np.bincount(at[order][new], minlength=last - first)
        together = at[1:] == at[:-1]
        same[first:last] = np.bincount(at[1:][together & (h[1:] == h[:-1])], minlength=last - first)
        two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[together]
        where = at[1:][together]
        order = np.lexsort((two, where))
        new = np.r_[True, (two[order][1:] != two[order][:-1]) | (where[order][1:] != where[order][:-1])] if len(two) else np.zeros(0, bool)
        pairs[first:last] = np.bincount(where[order][new], minlength=last - first)
        long_words[first:last] = np.bincount(at[words.lengths > 15], minlength=last - first)
    size, count = np.maximum(1, kinds.sum(axis=1)), np.maximum(1, words_n)
    letters = np.maximum(1, kinds[:, 0] + kinds[:, 1] + kinds[:, 3])
    rates = np.log1p(200 * kinds / size[:, None])
    more = [np.log1p(20 * kinds[:, 1] / letters), np.log1p(20 * kinds[:, 6] / count), np.log1p(20 * kinds[:, 7] / count), np.log1p(20 * kinds[:, 8] / count), size / count / 10, distinct / np.sqrt(count) / 10, 1 - distinct / count, 20 * np.minimum(0.2, same / count), 1 - pairs / np.maximum(1, count - 1), long_words / count, np.log1p(words_n) / 5]
    return np.column_stack([np.ones(n), rates, *more])


def _stored(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Language and source by hash, and the log of the stated length."""
    bucket = lambda column, n: np.array([zlib.crc32(str(x or "").encode()) % n for x in column.to_pylist()], float)
    length = np.log1p(np.maximum(0, np.array([x or 0 for x in n_chars.to_pylist()], float)))
    return np.column_stack([bucket(lang, LANGS), bucket(source, SOURCES), length]).astype(np.float32)


def expanded(stored: np.ndarray) -> np.ndarray:
    """The metadata view: a constant, the length, and a column for each bucket of language and source."""
    rows, length = len(stored), stored[:, 2]
    out = np.zeros((rows, 4 + LANGS + SOURCES))
    out[:, 0], out[:, 1], out[:, 2] = 1, length / 10, (length / 10) ** 2
    out[:, 3] = length == 0
    if rows:
        out[np.arange(rows), 4 + stored[:, 0].astype(int)] = 1
        out[np.arange(rows), 4 + LANGS + stored[:, 1].astype(int)] = 1
    return out


@dataclass
class CoModel:
    content: np.ndarray
    metadata: np.ndarray
    calibration: np.ndarray  # constant, content log-odds, metadata log-odds
    mean: np.ndarray
    spread: np.ndarray
    passed: list = field(default_factory=list)  # (round, view, rows, mean label) of what a view passed on

    def odds(self, content: np.ndarray, metadata: np.ndarray) -> list[np.ndarray]:
        return [((content - self.mean) / self.spread) @ self.content, metadata @ self.metadata]

    def score(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.odds(content, metadata)
        return sigmoid(a), sigmoid(b), sigmoid(np.column_stack([np.ones(len(a)), a, b]) @ self.calibration)


def surest(odds: np.ndarray, key: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the low rows of the least and the high rows of the greatest log-odds; ties by key."""
    order = np.lexsort((key, odds))
    high = min(high, max(0, len(order) - low))
    return order[:low], order[len(order) - high :]


class Held:
    """A pool of unlabelled rows in arrays."""

    def __init__(self, content: np.ndarray, metadata: np.ndarray):
        self.content, self.metadata, self.free = content, metadata, np.ones(len(content), bool)

    def take(self, model: CoModel, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each view: content and metadata of its surest rows, and which of them are high.  No row is taken twice."""
        rows = np.flatnonzero(self.free)
        out = []
        for odds in model.odds(self.content[rows], self.metadata[rows]):
            lows, highs = surest(odds, rows, low, high)
            some = rows[np.r_[lows, highs]]
            self.free[some] = False
            out.append((self.content[some], self.metadata[some], np.r_[np.zeros(len(lows), bool), np.ones(len(highs), bool)]))
        return out


def _unseen_odds(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Log-odds of the first len(fold) rows, each from a fit on all rows but those of its fold."""
    out = np.zeros(len(fold))
    for f in np.unique(fold):
        rest = np.r_[fold != f, np.ones(len(y) - len(fold), bool)]
        out[fold == f] = x[: len(fold)][fold == f] @ fit_logistic(x[rest], y[rest], penalty=1.0)
    return np.clip(out, -30, 30)


def co_train(content: np.ndarray, metadata: np.ndarray, y: np.ndarray, fold: np.ndarray, rounds: int = ROUNDS, pool=None, most: int | None = None) -> CoModel:
    """y: 1, 0, or -1 for unlabelled rows; labelled rows of fold 0 are kept for the calibrations.

    Where fold 0 lacks a kind, the calibrations take all labelled rows.  pool: where rows to pass on come from,
    else the unlabelled rows themselves; most: rows that a view passes on in a round.
    """
    mean, spread = content.mean(axis=0), content.std(axis=0) + 1e-6
    mean[0], spread[0] = 0, 1
    pool = pool or Held(content[y < 0], metadata[y < 0])
    seed, held = (y >= 0) & (fold != 0), (y >= 0) & (fold == 0)
    if not 0 < y[held].sum() < held.sum():
        held = y >= 0
    base = y[y >= 0].mean()
    most = max(2, round(PASS_ON * (y >= 0).sum())) if most is None else most
    high = min(most - 1, max(1, round(base * most)))
    own = [((content[seed] - mean) / spread, y[seed]), (metadata[seed], y[seed])]
    model = CoModel(*(np.zeros(x.shape[1]) for x, _ in own), np.zeros(3), mean, spread)
    for turn in range(rounds + 1):
        model.content, model.metadata = (fit_logistic(x, t, penalty=1.0) for x, t in own)
        odds = [np.clip(o, -30, 30) for o in model.odds(content[held], metadata[held])]
        if turn == rounds:
            break
        for k, (a, b, is_high) in enumerate(pool.take(model, most - high, high)):
            # What a view's log-odds are worth, from all labelled rows: each was out of the fit that its own come from.
            unseen = np.r_[odds[k], _unseen_odds(*own[k], fold[seed])]
            sure = fit_logistic(np.column_stack([np.ones(len(unseen)), unseen]), np.r_[y[held], y[seed]], penalty=1.0)
            label = sigmoid(np.column_stack([np.ones(len(a)), np.clip(model.odds(a, b)[k], -30, 30)]) @ sure)
            given = np.where(is_high, label > base, label < base)
            rows = b[given] if k == 0 else (a[given] - mean) / spread
            own[1 - k] = (np.concatenate([own[1 - k][0], rows]), np.r_[own[1 - k][1], label[given]])
            model.passed.append((turn, k, int(given.sum()), float(label[given].mean()) if given.any() else float("nan")))
    model.calibration = fit_logistic(np.column_stack([np.ones(held.sum()), *odds]), y[held], penalty=1.0)
    return model


class Corpus:
    """The unlabelled rows of a corpus as a pool: counted in bins of log-odds, of which only the outermost are read."""

    def __init__(self, rows: DataFrame):
        self.rows, self.given = rows, np.zeros(0, np.int64)

    def take(self, model: CoModel, low: int, high: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        given = self.given

        def count(batches):
            seen = np.zeros((2, BINS), np.int64)
            for batch, own in _scored(batches, model, given):
                for k in (0, 1):
                    seen[k] += np.bincount(_bin(own[k]), minlength=BINS)
            view, at = np.nonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(view), pa.array(at), pa.array(seen[view, at])], names=["view", "bin", "rows"])

        counts = np.zeros((2, BINS), np.int64)
        for r in self.rows.mapInArrow(count, "view long, bin long, rows long").groupBy("view", "bin").agg(F.sum("rows").alias("rows")).collect():
            counts[r["view"], r["bin"]] = r["rows"]
        # Of the last bin that is needed about twice what is missing is read, by the hash of the id.  The first view
        # may take what the second wants.
        cuts = [(*_edge(counts[k], low + k * (low + high)), *_edge(counts[k][::-1], high + k * (low + high))) for k in (0, 1)]

        def pick(batches):
            for batch, own in _scored(batches, model, given):
                draw = batch.column("place").to_numpy(zero_copy_only=False).view(np.uint64) / 2.0**64
                keep = np.zeros(batch.num_rows, bool)
                for k, (low_bin, low_part, high_bin, high_part) in enumerate(cuts):
                    at = _bin(own[k])
                    keep |= (at < low_bin) | ((at == low_bin) & (draw < low_part)) | (BINS - 1 - at < high_bin) | ((BINS - 1 - at == high_bin) & (draw < high_part))
                yield batch.filter(pa.array(keep))

        found = self.rows.mapInArrow(pick, self.rows.schema).groupBy("doc_id").agg(F.min(F.struct("a", "b", "place")).alias("row"))
        got = found.select("doc_id", "row.*").toArrow()
        ids, place = got["doc_id"].to_numpy(), got["place"].to_numpy()
        content, metadata = _unpacked(got["a"], got["b"])
        free, out = np.ones(len(ids), bool), []
        for odds in model.odds(content, metadata):
            rows = np.flatnonzero(free)
            lows, highs = surest(odds[rows], place[rows], low, high)
            some = rows[np.r_[lows, highs]]
            free[some] = False
            out.append((content[some], metadata[some], np.r_[np.zeros(len(lows), bool), np.ones(len(highs), bool)]))
        self.given = np.sort(np.r_[self.given, ids[~free]])
        return out


def _bin(odds: np.ndarray) -> np.ndarray:
    return np.clip((odds + SPAN) / (2 * SPAN) * BINS, 0, BINS - 1).astype(np.int64)


def _edge(counts: np.ndarray, wanted: int) -> tuple[int, float]:
    """The bin in which the first `wanted` rows end, and the share of it to read."""
    ends = np.cumsum(counts)
    at = int(np.searchsorted(ends, min(wanted, ends[-1])))
    before = int(ends[at] - counts[at])
    return at, 1.0 if not counts[at] else min(1.0, 2.0 * (wanted - before + 10) / counts[at])


def _scored(batches, model: CoModel, given: np.ndarray):
    """(batch, log-odds of both views) without rows that were given already."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        if len(given):
            old = given[np.minimum(np.searchsorted(given, ids), len(given) - 1)] == ids
            batch = batch.filter(pa.array(~old))
        yield batch, model.odds(*_unpacked(batch.column("a"), batch.column("b")))


def stratified(y: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Folds 0 to 3 dealt within each kind of label; the first rows of a kind are in folds 1 to 3."""
    fold = np.zeros(len(y), int)
    for kind in np.unique(y):
        rows = np.flatnonzero(y == kind)
        fold[rows[np.argsort(order[rows], kind="stable")]] = np.arange(1, len(rows) + 1) % 4
    return fold


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("double").alias("n_chars"))


def _features(batches):
    """(doc_id, place, a, b): both views as bytes; place: a hash of the id."""
    for batch in batches:
        a = content_view(batch.column("text")).astype(np.float32)
        b = _stored(*(batch.column(c) for c in ("lang", "source", "n_chars")))
        packed = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (a, b)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), *packed], names=["doc_id", "place", "a", "b"])


def _unpacked(a: pa.Array | pa.ChunkedArray, b: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    read = lambda column: np.frombuffer(b"".join(column.to_pylist()), np.float32).astype(float)
    content, stored = read(a), read(b).reshape(-1, 3)
    return content.reshape(len(stored), -1) if len(stored) else np.zeros((0, CONTENT)), expanded(stored)


def features(docs: DataFrame) -> DataFrame:
    return cut(_columns(docs).withColumn("place", F.xxhash64("doc_id", F.lit(9))).mapInArrow(lean(_features), "doc_id long, place long, a binary, b binary"))


def fit_quality(docs: DataFrame, labels: DataFrame, labelled: int = MAX_LABELLED, unlabelled: int = MAX_UNLABELLED, rounds: int = ROUNDS, feats: DataFrame | None = None) -> CoModel | None:
    """None where the labels are not of both kinds.  feats: features(docs), where they are there already."""
    feats = (features(docs) if feats is None else feats).filter("doc_id is not null")
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("long").alias("label"))
    every = feats.select("doc_id").distinct()
    ids, known = cut(every.join(known, "doc_id", "left_anti")), cut(known.join(every, "doc_id", "left_semi"))
    # A twentieth of the bound for either kind, so that a rare kind is never missed; the rest as they come.
    least = max(1, labelled // 20)
    first = lambda rows, n: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    some = first(known, max(0, labelled - 2 * least)).union(first(known.filter("label = 0"), least)).union(first(known.filter("label > 0"), least)).distinct()
    others = first(ids, unlabelled).withColumn("label", F.lit(-1).cast("long"))
    rows = feats.join(F.broadcast(some.union(others)), "doc_id")
    # One row of each id: the least.  The bound is one of rows, and no id weighs more than another.
    got = rows.groupBy("doc_id", "label").agg(F.min(F.struct("a", "b", "place")).alias("_row")).select("label", "_row.*").toArrow()
    y = np.minimum(got["label"].to_numpy().astype(float), 1)
    if not (y == 0).any() or not (y == 1).any():
        return None
    a, b = _unpacked(got["a"], got["b"])
    pool = Corpus(cut(feats.join(ids, "doc_id", "left_semi")))
    return co_train(a, b, y, stratified(y, got["place"].to_numpy()), rounds, pool)


def score_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, content_score, metadata_score, score (1: good), accepted (score is REJECT_BELOW or more).

    Cases: null and empty texts and null metadata are features like any, and so is a text of any length; repeated
    rows score alike, and so do ties; of rows of one doc_id one takes part in the fit; rows without a doc_id are
    scored only; without labels of both kinds all scores are 1 (nothing can be rejected); other columns are not
    read, so their names cannot clash; an empty table gives no rows.
    """
    feats = features(docs)
    sent = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, feats=feats, **options))

    def score(batches):
        model = sent.value
        for batch in batches:
            own = model.score(*_unpacked(batch.column("a"), batch.column("b"))) if model else [np.ones(batch.num_rows)] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, own)], names=["doc_id", "content_score", "metadata_score", "score"])

    out = feats.mapInArrow(score, "doc_id long, content_score double, metadata_score double, score double")
    return out.withColumn("accepted", F.col("score") >= REJECT_BELOW)


def accepted_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all columns, that the classifier accepts; texts are not shuffled.  Cases as above."""
    sent = docs.sparkSession.sparkContext.broadcast(fit_quality(docs, labels, **options))

    def accept(batches):
        model = sent.value
        for batch in batches:
            if model:
                content = content_view(batch.column("text")).astype(np.float32).astype(float)
                stored = _stored(batch.column("lang").cast(pa.string()), batch.column("source").cast(pa.string()), batch.column("n_chars").cast(pa.float64()))
                batch = batch.filter(pa.array(model.score(content, expanded(stored.astype(float)))[2] >= REJECT_BELOW))
            yield batch

    return docs.mapInArrow(lean(accept), docs.schema)

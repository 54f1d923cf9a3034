"""Alignment of two tokenizers' ids over the same bytes.

After both tokenizers have encoded a text in full, a place is an anchor where a token of either side ends and the
next of either side begins with a blank.  Anchors cut a document into windows of ids, mostly words.  Windows recur, so
within a slice of text the alignment of a window is found once for its two tuples of ids and taken from there at
every place where those stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut, lean, new_folder
from .hashing import mix64, slices, utf8
from .tokens import _dealt, _picked, default_tokenizer, encoder

BLANK = 0x20
MARK = "▁"
#: Bytes of text that are aligned at once, and whose windows are remembered.
SLICE_BYTES = 2_000_000
#: Distinct pairs whose counts are sent to all tasks (12 bytes each); beyond it counts are joined.
MOST_BROADCAST = 3_000_000

ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_KEPT: dict = {}


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Bytes:
    """What each id of a tokenizer stands for, as one array of bytes."""

    def __init__(self, words: list[bytes]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(words), np.uint8)
        self.blank = np.array([w[:1] == b" " for w in words])

    def of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        place = np.repeat(self.first[ids] - (np.cumsum(size) - size), size)
        return self.data[place + np.arange(len(place))]


def byte_level(tokenizer) -> Bytes:
    """Entries of a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    words = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return Bytes([bytes(byte[c] for c in w) if all(c in byte for c in w) else w.encode() for w in words])


def piece_bytes(model) -> Bytes:
    words = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        words.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else piece.replace(MARK, " ").encode())
    return Bytes(words)


class Pieces:
    """A sentencepiece model that puts a blank before a text.

    Where no piece holds a blank after another character, a blank always begins a piece, so texts with single blanks
    inside are encoded word by word, each distinct word of a slice once.  Other texts are encoded as they are.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = piece_bytes(self.model)
        every = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any(MARK in piece.lstrip(MARK) for piece in every)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        whole = np.ones(len(texts), bool)
        if self.splits:
            whole = pc.match_substring_regex(texts, rf"  |^ | $|^$|\x00|{MARK}").to_numpy(zero_copy_only=False).astype(bool)
        out, counts = np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        if not whole.all():
            words, word, per_text = _dealt(pc.replace_substring(texts.filter(pa.array(~whole)), " ", "\0"))
            found = self.model.encode(words.to_pylist(), num_threads=1)
            size = np.array(list(map(len, found)), np.int64)
            ids = np.fromiter(chain.from_iterable(found), np.int64, int(size.sum()))
            out, counts[~whole] = _picked(ids, size, word, per_text)
        if not whole.any():
            return out, counts
        alone = iter([np.array(x, np.int64) for x in self.model.encode(texts.filter(pa.array(whole)).to_pylist(), num_threads=1)])
        ends = np.cumsum(counts)
        rows = [next(alone) if w else out[end - n : end] for w, n, end in zip(whole, counts, ends)]
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)


class Windows:
    """Alignments of distinct windows, found together: everything that stands at a window's places is taken from here."""

    def __init__(self, a: Bytes, b: Bytes):
        self.a, self.b = a.size, b.size
        ids = range(max(len(a.size), len(b.size)))
        self.words = pa.array([f"{i}{sep}" for i in ids for sep in ",|;"])

    def align(self, ids_a: np.ndarray, many_a: np.ndarray, ids_b: np.ndarray, many_b: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
        """(`a1,a2|b1;a3|b2;` of each window, its number of groups, all linked pairs in a row, number of them in each window).

        The ids of windows stand one after the other.  Both sides of a window have the same bytes, so ends of
        tokens are compared over all windows at once.
        """
        ends_a, ends_b = np.cumsum(self.a[ids_a]), np.cumsum(self.b[ids_b])
        total = int(ends_a[-1])
        at_a, at_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        at_a[ends_a] = at_b[ends_b] = True
        shared, either = np.flatnonzero(at_a & at_b), np.flatnonzero(at_a | at_b)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        of_a, of_b = np.bincount(group_a, minlength=len(shared)), np.bincount(group_b, minlength=len(shared))
        first_a, first_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
        items = np.empty(len(ids_a) + len(ids_b), np.int64)
        for ids, group, last, sep, shift in ((ids_a, group_a, first_a + of_a - 1, 1, first_b), (ids_b, group_b, first_b + of_b - 1, 2, first_a + of_a)):
            own = np.arange(len(ids))
            items[own + shift[group]] = 3 * ids + np.where(own == last[group], sep, 0)
        texts = self.words.take(pa.array(items))
        _, offsets, data = texts.buffers()
        stops = np.frombuffer(offsets, np.int32, len(items) + 1)[np.r_[0, np.cumsum(many_a) + np.cumsum(many_b)]]
        strings = pa.StringArray.from_buffers(len(many_a), pa.py_buffer(stops.astype(np.int32)), data)
        borders = ends_a[np.cumsum(many_a) - 1]
        groups, links = np.searchsorted(shared, borders, "right"), np.searchsorted(either, borders, "right")
        pairs = pair_of(ids_a[np.searchsorted(ends_a, either)], ids_b[np.searchsorted(ends_b, either)])
        return strings, np.diff(np.r_[0, groups]), pairs, np.diff(np.r_[0, links])


def pair_of(a, b):
    """Ids of a vocabulary below 2^16 and of one below 2^15 as positive 32-bit numbers."""
    return a << 15 | b


def a_of(pairs):
    return pairs >> 15


def _tuple_hash(ids: np.ndarray, many: np.ndarray) -> np.ndarray:
    first = np.cumsum(many) - many
    place = np.arange(len(ids)) - np.repeat(first, many)
    mixed = mix64(ids.astype(np.uint64) << np.uint64(32) | place.astype(np.uint64) | np.uint64(1 << 60))
    return np.add.reduceat(mixed, first)


def _runs(ids: np.ndarray, many: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of some of the runs one after the other, number of ids of each)."""
    if not len(some):
        return ids[:0], many[:0]
    return _picked(ids, many, some, np.ones(len(some), np.int64))


def _digests(strings: pa.Array, ends: np.ndarray, per_text: np.ndarray) -> list[str]:
    """SHA-256 of each text's windows one after the other, without the last separator; empty for a text without any."""
    _, offsets, data = strings.buffers()
    stops = np.frombuffer(offsets, np.int32, len(strings) + 1)
    data = memoryview(data)
    spans = zip(stops[ends - per_text].tolist(), stops[ends].tolist())
    return [hashlib.sha256(data[a : b - 1]).hexdigest() if b > a else "" for a, b in spans]


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the runs of values that end at these places; runs may be empty."""
    return np.diff(np.r_[0, np.r_[0, np.cumsum(values)][ends]])


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.enc, self.pieces = encoder(path_a, plain=True), Pieces(path_b)
        self.a, self.b = byte_level(self.enc.tokenizer), self.pieces.bytes
        if len(self.a.size) > 1 << 16 or len(self.b.size) > 1 << 15:
            raise ValueError("pairs of ids need vocabularies of at most 65,536 and 32,768")
        self.windows = Windows(self.a, self.b)

    def align(self, texts: pa.Array) -> dict[str, list]:
        """Columns of ROWS (without row and doc_id) for texts."""
        n = len(texts)
        spaced = pc.binary_join_element_wise("", texts, " ")
        ids_a, n_a = self.enc.encode(spaced)
        ids_b, n_b = self.pieces.encode(texts)
        ids_a, ids_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
        whole = self._same_bytes(spaced, ids_a, n_a, ids_b, n_b)
        whole &= pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        ids_a, ids_b = ids_a[np.repeat(whole, n_a)], ids_b[np.repeat(whole, n_b)]
        n_a, n_b = np.where(whole, n_a, 0), np.where(whole, n_b, 0)
        size_a, size_b = self.a.size[ids_a], self.b.size[ids_b]
        ends_a, ends_b = np.cumsum(size_a), np.cumsum(size_b)
        windows_a, windows_b, per_text = self._cut(ids_a, ends_a, n_a, ids_b, ends_b, n_b)
        which, one = self._distinct(ids_a, windows_a, ids_b, windows_b)
        ends = np.cumsum(per_text)
        digests, pairs, n_groups, n_links = [""] * n, np.zeros(0, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        if len(which):
            strings, groups, flat, links = self.windows.align(*_runs(ids_a, windows_a, one), *_runs(ids_b, windows_b, one))
            pairs = _picked(flat, links, which, np.ones(len(which), np.int64))[0]
            n_links, n_groups = _sums(links[which], ends), _sums(groups[which], ends)
            digests = _digests(strings.take(pa.array(which)), ends, per_text)
        unique, times = np.unique(np.repeat(np.arange(n), n_links) << 31 | pairs, return_counts=True)
        per_row = np.bincount(unique >> 31, minlength=n)
        offsets = np.r_[0, np.cumsum(per_row)].astype(np.int32)
        as_lists = lambda x: pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32)))
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups_sha256": digests, "pairs": as_lists(unique & (1 << 31) - 1), "times": as_lists(times)}

    def _same_bytes(self, spaced: pa.Array, ids_a, n_a, ids_b, n_b) -> np.ndarray:
        """Whether the bytes of either side's tokens are those of a text."""
        data, at = utf8(spaced)
        wanted, ok = np.diff(at), np.ones(len(spaced), bool)
        for own, ids, counts in ((self.a, ids_a, n_a), (self.b, ids_b, n_b)):
            total = np.r_[0, np.cumsum(own.size[ids])]
            ends = np.cumsum(counts)
            size = total[ends] - total[ends - counts]
            ok &= size == wanted
            if ok.any():
                mine = own.of(ids[np.repeat(ok, counts)])
                differ = np.r_[0, np.cumsum(mine != data[at[0] : at[-1]][np.repeat(ok, wanted)])]
                stops = np.cumsum(wanted[ok])
                ok[np.flatnonzero(ok)[differ[stops] != differ[stops - wanted[ok]]]] = False
        return ok

    def _cut(self, ids_a, ends_a, n_a, ids_b, ends_b, n_b):
        """Number of ids of each window on both sides, and of windows of each text.

        An anchor is an end of both sides after which both go on with a blank; every text ends with one.
        """
        last = int(ends_a[-1]) if len(ends_a) else 0
        mark = np.zeros(last + 1, np.int8)
        going_a, going_b = np.r_[self.a.blank[ids_a[1:]], True][: len(ids_a)], np.r_[self.b.blank[ids_b[1:]], True][: len(ids_b)]
        stops_a, stops_b = np.cumsum(n_a), np.cumsum(n_b)
        final = np.unique(ends_a[stops_a[n_a > 0] - 1])
        mark[ends_a[going_a]] = 1
        mark[ends_b[going_b]] += 2
        anchors = np.union1d(np.flatnonzero(mark == 3), final)
        cuts_a, cuts_b = np.searchsorted(ends_a, anchors) + 1, np.searchsorted(ends_b, anchors) + 1
        texts = np.searchsorted(stops_a, cuts_a - 1, side="right")
        return np.diff(np.r_[0, cuts_a]), np.diff(np.r_[0, cuts_b]), np.bincount(texts, minlength=len(n_a))

    @staticmethod
    def _distinct(ids_a, windows_a, ids_b, windows_b) -> tuple[np.ndarray, np.ndarray]:
        """(the number of the distinct window at each place, a place of each distinct window).

        Windows are distinct by their two tuples of ids: sorted by a hash of those, and told apart id by id within it.
        """
        if not len(windows_a):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = _tuple_hash(ids_a, windows_a) * np.uint64(3) ^ _tuple_hash(ids_b, windows_b)
        _, one, which = np.unique(code, return_index=True, return_inverse=True)
        same = np.ones(len(which), bool)
        for ids, many in ((ids_a, windows_a), (ids_b, windows_b)):
            same &= many == many[one][which]
            own, count = _runs(ids, many, np.flatnonzero(same))
            model, _ = _runs(ids, many, one[which[same]])
            same[np.flatnonzero(same)[_sums(own != model, np.cumsum(count)) > 0]] = False
        odd = np.flatnonzero(~same)  # another window has the same hash: each of these stands alone
        which[odd] = len(one) + np.arange(len(odd))
        return which, np.r_[one, odd]

    def forget(self) -> None:
        self.enc.forget()


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _KEPT:
        _KEPT[path_a, path_b] = Aligner(path_a, path_b)
    return _KEPT[path_a, path_b]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for every document; see ROWS.  pairs are its distinct linked pairs of ids, times how often each is linked."""
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    schema = arrow_schema(ROWS)

    def rows(batches) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            text = batch.column("text")
            for first, last in slices(utf8(text)[1], SLICE_BYTES):
                found = both.align(text.slice(first, last - first))
                own = {"row": batch.column("row").slice(first, last - first), "doc_id": batch.column("doc_id").slice(first, last - first)} | found
                yield pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if not isinstance(own[f.name], pa.Array) else own[f.name].cast(f.type) for f in schema], schema=schema)
        both.forget()

    return slim.mapInArrow(lean(rows), ROWS)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count: documents that hold it linked), one row for each pair of ids; summed before the shuffle."""
    return rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))


def align_tokens(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """One row for every document, see RESULT: how the ids of two tokenizers meet in its text.

    A is a byte-level tokenizer of blank and text, B a sentencepiece model that adds the blank itself; the strings of
    special tokens are plain text.  Byte offsets where tokens of both end cut them into groups, and tokens whose
    bytes overlap are linked.  n_best counts the links whose pair of ids is held linked by as many documents as
    any of the same A id; count_sum sums those numbers over all links.

    Cases: a null or empty text, and one whose bytes either side does not give back (U+2581 in the text, say), has
    no tokens, zeros and an empty groups_sha256; texts are taken whole at any length; every row is a document,
    repeated ids and null ids too; ties for the best pair all count; an empty table gives no rows; only doc_id and
    text are read, so other columns cannot clash.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "aligned")
    aligned(docs, path_a or default_tokenizer(), path_b or default_pieces()).write.option("compression", "zstd").parquet(folder)
    rows = spark.read.parquet(folder)
    counts = cut(pair_counts(rows))
    if counts.count() <= most_broadcast:
        return _scored_by_broadcast(rows, counts)
    return _scored_by_join(rows, counts)


def _scored_by_broadcast(rows: DataFrame, counts: DataFrame) -> DataFrame:
    table = counts.toArrow()
    pair = table.column("pair").to_numpy()
    order = np.argsort(pair)
    pair, count = pair[order].astype(np.int32), table.column("count").to_numpy()[order].astype(np.int64)
    if len(pair):
        starts = np.flatnonzero(np.r_[True, np.diff(a_of(pair)) != 0])
        best = count == np.repeat(np.maximum.reduceat(count, starts), np.diff(np.r_[starts, len(pair)]))
    else:
        best = np.zeros(0, bool)
    sent = rows.sparkSession.sparkContext.broadcast((pair, count, best))
    columns = [c for c in arrow_schema(RESULT).names]

    def score(batches):
        pair, count, best = sent.value
        for batch in batches:
            lists, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
            flat, per_row = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            place = np.searchsorted(pair, flat)
            ends = np.cumsum(per_row)
            sums = [_sums(times * best[place], ends), _sums(times * count[place], ends)]
            found = {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
            yield pa.RecordBatch.from_arrays([found[c] if c in found else batch.column(c) for c in columns], names=columns)

    return rows.mapInArrow(lean(score), RESULT)


def _scored_by_join(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The same where the counts are too many to be sent: pairs meet their counts in a join, hot ones split by Spark."""
    a = F.shiftright("pair", 15)
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    counts = cut(counts.withColumn("a", a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")))
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    times = F.col("times").cast("long")
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("count")).alias("count_sum"))
    found = rows.join(sums, "row", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")

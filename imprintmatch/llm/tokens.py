"""Token-ID files: flat little-endian unsigned integers with 64-bit document offsets.

A dataset is a folder with, for every part, `<part>.ids` (uint16 where the vocabulary allows, else
uint32), `<part>.offsets` (uint64, one more than documents, from 0) and `<part>.docs` (int64 document
ids).  Parts follow each other in ascending document order; the global start of a part is the prefix sum
of the parts before.  Parts are written under names of their own attempt, and only those that a finished
task reports are in the manifest, so a lost or repeated task leaves no trace in it.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import cut, lean, shuffle_partitions
from .hashing import slices, utf8

END_ID = 0
#: A part ends with the slice of documents in which it reaches either.
DOCS_PER_PART, TOKENS_PER_PART = 50_000, 1 << 24
#: Stands for a null document id in `<part>.docs`.
NO_ID = -(1 << 63)
#: Bytes of text that are encoded at once; bytes of words that a task remembers, in two halves of this size.
SLICE_BYTES, REMEMBERED, PER_WORD = 4_000_000, 60_000_000, 200
#: Words that are encoded in one call.
TOGETHER = 64
#: Fixed value: the words of a byte-level tokenizer, in texts whose white space is single blanks and line ends.
_WORD = r"'(?:[stmd]|re|ve|ll)| ?\pL+| ?\pN+| ?[^ \n\pL\pN]+|\n"
#: Other white space, and characters outside blocks whose classes are the same in all versions of Unicode.
_UNSAFE = r"[^\n -~\x{a1}-\x{52f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{3041}-\x{3096}\x{30a1}-\x{30fa}\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}]|[ \n][ \n]|[ \n]$"
_FIRST = r"^[ \n]"
_KEPT: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _dealt(marked: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut at every NUL: (distinct parts, the part at each place, number of places of each text)."""
    lists = pc.split_pattern(marked, "\0")
    every = pc.list_flatten(lists).dictionary_encode()
    return every.dictionary, every.indices.to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)


def _picked(ids: np.ndarray, size: np.ndarray, part: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of parts (of these sizes, one after the other) put together to texts: (ids, number of ids of each text)."""
    own, first = size[part], (np.cumsum(size) - size)[part]
    ends = np.cumsum(own)
    place = np.repeat(first - (ends - own), own)
    place += np.arange(len(place))
    return ids[place], np.diff(np.r_[0, ends[np.cumsum(per_text) - 1]])


class Encoder:
    """Encodes whole texts with the tokenizers library.

    A byte-level tokenizer first splits a text into words and encodes each alone.  Where white space is
    simple, texts are split alike here, and every distinct word of a slice is encoded once.  Other texts are
    encoded as they are, and so are texts that hold an added token's string and all texts of other tokenizers.
    With plain, such strings are plain text, and texts begin with one blank.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.tokenizer.encode_special_tokens = plain
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.unsafe = _UNSAFE if plain else "|".join([_UNSAFE, _FIRST, *map(re.escape, added)])
        made = json.loads(self.tokenizer.to_str())
        before = made.get("pre_tokenizer") or {}
        self.splits = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not made.get("normalizer") and not made.get("post_processor")
        self.line_end = self._ids("\n")
        self.splits = self.splits and len(self.line_end) == 1
        self.fixed = {"": b"", "\n": self.line_end.tobytes()}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        whole = np.ones(len(texts), bool)
        if self.splits:
            whole = pc.match_substring_regex(texts, self.unsafe).to_numpy(zero_copy_only=False).astype(bool)
        out, counts = np.zeros(0, self.dtype), np.zeros(len(texts), np.int64)
        if not whole.all():
            out, counts[~whole] = self._in_words(texts.filter(pa.array(~whole)))
        if not whole.any():
            return out, counts
        alone = iter([self._ids(t) for t in texts.filter(pa.array(whole)).to_pylist()])
        ends = np.cumsum(counts)
        rows = [next(alone) if w else out[end - n : end] for w, n, end in zip(whole, counts, ends)]
        return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)

    def _in_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As encode, for texts that can be split: at blanks and line ends first, then each distinct piece into words."""
        pieces, piece, per_text = _dealt(pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 "))
        words, word, per_piece = _dealt(pc.replace_substring_regex(pieces, _WORD, "\0\\0"))
        known = self.words(words.to_numpy(zero_copy_only=False).tolist())
        size = np.array([len(x) for x in known], np.int64) // self.dtype.itemsize
        ids, size = _picked(np.frombuffer(b"".join(known), self.dtype), size, word, per_piece)
        return _picked(ids, size, piece, per_text)

    def words(self, wanted: list[str]) -> list[bytes]:
        """Ids of distinct words.  The latest are remembered, in two halves; the older half is given up first."""
        got = list(map(self.known.get, wanted))
        missing = []
        for i in [i for i, found in enumerate(got) if found is None]:
            word = wanted[i]
            found = self.fixed.get(word)
            if found is None:
                found = self.older.get(word)
                if found is None:
                    missing.append(i)
                    continue
                self._remember(word, found)
            got[i] = found
        for first in range(0, len(missing), TOGETHER):
            some = missing[first : first + TOGETHER]
            for i, ids in zip(some, self._together([wanted[i] for i in some])):
                got[i] = ids
                self._remember(wanted[i], ids)
        return got

    def forget(self) -> None:
        """At the end of a task: the worker lives on, and other work needs the room."""
        self.known, self.older, self.held = {}, {}, 0

    def _remember(self, word: str, ids: bytes) -> None:
        self.known[word] = ids
        self.held += len(word) + len(ids) + PER_WORD
        if self.held > REMEMBERED:
            self.known, self.older, self.held = {}, self.known, 0

    def _together(self, words: list[str]) -> list[bytes]:
        """Words as a text of as many lines: a line end between them is a word of its own."""
        ids = self._ids("\n".join(words))
        ends = np.flatnonzero(ids == self.line_end[0]).tolist()
        if len(ends) != len(words) - 1:
            return [self._ids(w).tobytes() for w in words]
        data, size = ids.tobytes(), self.dtype.itemsize
        return [data[a * size : b * size] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)])]


def encoder(path: str, plain: bool = False) -> Encoder:
    """One encoder for each Python worker."""
    if (path, plain) not in _KEPT:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _KEPT[path, plain] = Encoder(path, plain)
    return _KEPT[path, plain]


def _open(folder: str):
    fs, base = pafs.FileSystem.from_uri(folder)
    return fs, base


class _Part:
    """Files of one part, written as documents come."""

    def __init__(self, fs, base: str, itemsize: int):
        self.name, self.itemsize = uuid.uuid4().hex, itemsize
        self.files = {k: fs.open_output_stream(f"{base}/{self.name}.{k}") for k in ("ids", "offsets", "docs")}
        self.at = self.docs = 0
        self.files["offsets"].write(np.zeros(1, "<u8").tobytes())

    def add(self, doc_ids: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        self.files["ids"].write(ids.tobytes())
        self.files["offsets"].write((self.at + np.cumsum(counts)).astype("<u8").tobytes())
        self.files["docs"].write(doc_ids.astype("<i8").tobytes())
        self.at += len(ids)
        self.docs += len(doc_ids)

    @property
    def full(self) -> bool:
        return self.docs >= DOCS_PER_PART or self.at >= TOKENS_PER_PART

    def close(self) -> dict:
        for f in self.files.values():
            f.close()
        return {"name": self.name, "n_tokens": self.at, "n_docs": self.docs}


def _encoded(batches, enc: Encoder, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, ids, number of ids of each) of slices of bounded text; every document ends with end_id."""
    for batch in batches:
        doc_ids = batch.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        text = batch.column("text")
        for first, last in slices(utf8(text)[1], SLICE_BYTES):
            ids, counts = enc.encode(text.slice(first, last - first))
            yield doc_ids[first:last], np.insert(ids, np.cumsum(counts), end_id), counts + 1


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", null_ids: bool = False) -> DataFrame:
    """Write docs in ascending id order; returns the manifest (part, seq, name, n_tokens, n_docs, base, dtype).

    Only the manifest's rows, one for each part, come together; bases are their prefix sums.

    Cases: a null or empty text gives the end id alone; a text of any length is one document; repeated ids
    are all written, by text; rows without an id are left out, or with null_ids come first, as NO_ID in the files;
    an empty table gives a manifest without rows; only the id and the text are read, so other columns cannot
    clash.
    """
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)
    dtype = encoder(path).dtype.str
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    slim = slim if null_ids else slim.filter("doc_id is not null")
    ordered = slim.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        enc, (out, at) = encoder(path), _open(folder)
        number, part, rows = TaskContext.get().partitionId(), None, []
        for slice_of in _encoded(batches, enc, end_id):
            part = part or _Part(out, at, enc.dtype.itemsize)
            part.add(*slice_of)
            if part.full:
                rows.append({"part": number, "seq": len(rows)} | part.close())
                part = None
        if part:
            rows.append({"part": number, "seq": len(rows)} | part.close())
        enc.forget()
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    parts = cut(ordered.mapInArrow(lean(write), "part long, seq long, name string, n_tokens long, n_docs long"))
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    return parts.select("*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"), F.lit(dtype).alias("dtype"))


def _mapped(fs, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the folder is a local or mounted one."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r") if fs.get_file_info(path).size else np.zeros(0, dtype)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


def _ids_of(docs: np.ndarray) -> pa.Array:
    docs = np.asarray(docs)
    return pa.array(docs, mask=docs == NO_ID)


def read_tokens(manifest: DataFrame, folder: str, digest: bool = False) -> DataFrame:
    """Documents from the files: doc_id, start (ids of all documents before it), n_tokens and ids, or ids_crc32."""
    kind = "ids_crc32 long" if digest else "ids array<long>"

    def read(batches):
        fs, at = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, docs = (_mapped(fs, f"{at}/{row['name']}.{k}", d) for k, d in (("ids", row["dtype"]), ("offsets", "<u8"), ("docs", "<i8")))
                for first in range(0, len(docs), 1000):
                    ends = np.asarray(offsets[first : first + 1001]).astype(np.int64)
                    spans = [np.asarray(ids[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                    own = [zlib.crc32(x.astype("<u4").tobytes()) for x in spans] if digest else [x.astype(np.int64) for x in spans]
                    yield pa.RecordBatch.from_arrays(
                        [_ids_of(docs[first : first + 1000]), pa.array(ends[:-1] + row["base"]), pa.array(np.diff(ends)), pa.array(own, pa.int64() if digest else pa.list_(pa.int64()))],
                        names=["doc_id", "start", "n_tokens", kind.split()[0]],
                    )

    spread = manifest.repartition(shuffle_partitions(manifest.sparkSession), "name")
    return spread.mapInArrow(read, f"doc_id long, start long, n_tokens long, {kind}")


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def token_files(docs: DataFrame, folder: str, **options) -> DataFrame:
    """Write docs and their manifest to folder and read the digest of every document back."""
    write_tokens(docs, folder, **options).write.parquet(f"{folder}/manifest")
    return read_tokens(manifest_of(docs.sparkSession, folder), folder, digest=True).select("doc_id", "start", "n_tokens", "ids_crc32")

"""Toxicity scores after noisy-channel deobfuscation.

A character model counted over the whole corpus restores disguised words (leetspeak, spaced or dotted
letters, stretched letters): each disguised token is a lattice of readings, and Viterbi search picks the
likeliest under the channel's and the model's probabilities together.  Words and word beginnings whose presence marks toxic training texts then score the text as
it stands together with what was restored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .decontam import normal
from .hashing import Words, doc_shingles, mix64, slices, utf8
from .models import fit_logistic, sigmoid

#: Labelled rows that a model is fitted on, at most: those with the least hash of their id.
MAX_TRAIN = 40_000
#: Features that are sent to all tasks, at most; more meet the texts in a sorted join.
MOST_BROADCAST = 2_000_000
PREFIXES = (4, 5, 6)

#: Readings of characters in disguised words.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "*": "aeiou", "\x1a": "u",
}
#: Signs of several characters, and the one that stands for them here.
DRAWN = {"(_)": "\x1a", "|_|": "\x1a"}

#: The channel, stated rather than learned: how likely a sign in a disguised word stands for a letter (its letters
#: share this evenly) or, where it is punctuation too, for nothing; a digit for a letter or for itself; two equal signs
#: for one letter or for two, two equal letters for one or themselves, a longer run for one or for two; a separator for
#: nothing or for the end of a word.
CHANNEL = {"sign": 0.8, "nothing": 0.2, "digit": 0.7, "itself": 0.3, "one of two signs": 0.5, "both signs": 0.5, "one of two": 0.2, "both": 0.8, "one": 0.7, "two": 0.3, "joins": 0.5, "parts": 0.5}
PUNCTUATION = "*!|+"
_COST = {name: float(np.log(p)) for name, p in CHANNEL.items()}

#: Latin letters, as in a class of a pattern.
LETTERS = "A-Za-zªºÀ-ÖØ-öø-ɏ̀-ͯḀ-ỿ"
_READ = re.escape("".join(LEET))
DISGUISED = re.compile(rf"[{LETTERS}][{_READ}]|[{_READ}][{LETTERS}]|([{LETTERS}])\1\1")
#: Single characters with anything between them.
SPACED = re.compile(rf"(?<![{LETTERS}0-9])[{LETTERS}0-9@$!](?:(?:[^\w@$!̀-ͯ]|_)++[{LETTERS}0-9@$!]){{2,}}(?![{LETTERS}0-9])")
#: Separators; those that have readings too are left to them.
BETWEEN = rf"(?:[^\w{_READ}̀-ͯ]|_)+"
APART = re.compile(rf"(?:[^\w@$!̀-ͯ]|_)+")
#: What words and their disguises are made of, or joined by; runs of these are split at all other characters.
PIECE = frozenset(c for c in map(chr, range(0x1F00)) if re.match(rf"[{LETTERS}{_READ}._/\-]", c))
RUNS = re.compile(rf"{BETWEEN}|(.)\1*", re.S)
REPEATED = re.compile(r"(.)\1{3,}", re.S)
#: A piece of a word that was cut in two, at most, for one of the pieces.
SHORT = 3
#: Readings of longer tokens are not kept for the next time.
KEPT = 64

ORDER = 4
_SYMBOLS = 28  # 0: outside a word, 1-26: letters, 27: other characters of words
_CLASS = np.array([b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 128 else 0 for b in range(256)], np.int32)
_CODES: dict[str, tuple[int, ...]] = {}


# ---------------------------------------------------------------- character model


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(character | three before), from counts over every whole text."""

    def count(batches):
        seen = np.zeros(_SYMBOLS**ORDER, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for first, last in slices(offsets):
                own = _CLASS[data[offsets[first] : offsets[last]]]
                own = np.concatenate([np.zeros(ORDER - 1, np.int32), own, np.zeros(1, np.int32)])
                code = own[: len(own) - ORDER + 1].copy()
                for i in range(1, ORDER):
                    code = code * _SYMBOLS + own[i : len(own) - ORDER + 1 + i]
                seen += np.bincount(code, minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["gram", "times"])

    grams = docs.select("text").mapInArrow(count, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times")).toArrow()
    times = np.zeros(_SYMBOLS**ORDER)
    times[grams["gram"].to_numpy()] = grams["times"].to_numpy()
    table = times.reshape(-1, _SYMBOLS)
    lower = table.reshape(_SYMBOLS, -1, _SYMBOLS).sum(axis=0) + 0.1
    back = np.tile(lower / lower.sum(axis=1, keepdims=True), (_SYMBOLS, 1))
    smooth = (table + 2 * back) / (table.sum(axis=1, keepdims=True) + 2)
    return np.log(smooth).astype(np.float32).ravel()


class Decoder:
    """Viterbi search over the readings of a token; a state is the last three characters read."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def readings(self, token: str) -> list[list[tuple[str, float]]]:
        """Readings of each run of equal characters, with the channel's log-probability of each."""
        out = []
        for run in RUNS.finditer(token.lower()):
            c, n = run[1], len(run[0])
            if c is None:
                out.append([("", _COST["joins"]), ("\0", _COST["parts"])])
                continue
            names = ("one", "two") if n > 2 else ("one of two signs", "both signs") if c in LEET else ("one of two", "both")
            often = [(k, _COST[name]) for k, name in enumerate(names, 1)] if n > 1 else [(1, 0.0)]
            if c in LEET:
                each = (_COST["sign"] if c in PUNCTUATION else _COST["digit"] if c.isdigit() else 0.0) - float(np.log(len(LEET[c])))
                own = [(r * times, each + cost) for r in LEET[c] for times, cost in often]
                out.append(own + ([("", _COST["nothing"])] if c in PUNCTUATION else [(c * n, _COST["itself"])] if c.isdigit() else []))
            elif c in PIECE:
                out.append([(c * times, cost) for times, cost in often])
            else:
                out.append([("\0", 0.0)])
        return out

    def decode(self, token: str) -> str:
        token = REPEATED.sub(r"\1\1\1", token.lower())  # four and more read like three
        found = self.known.get(token)
        if found is None:
            found = self.search(token)
            if len(token) <= KEPT and len(self.known) < 200_000:
                self.known[token] = found
        return found

    def search(self, token: str) -> str:
        """A state holds its score and its readings, linked to those before; what all states share is put aside."""
        done: list[str] = []
        states: dict[tuple, tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
        for options in self.readings(token) + [[("\0", 0.0)]]:
            new: dict[tuple, tuple[float, tuple | None]] = {}
            for state, (score, path) in states.items():
                for option, cost in options:
                    s, total = state, score + cost
                    for code in self.codes(option):
                        if not code and not s[2]:
                            continue  # outside a word already
                        total += float(self.model[((s[0] * _SYMBOLS + s[1]) * _SYMBOLS + s[2]) * _SYMBOLS + code])
                        s = (s[1], s[2], code)
                    if s not in new or total > new[s][0]:
                        new[s] = (total, (path, option))
            states = new
            if len(states) == 1:
                ((s, (_, path)),) = states.items()
                done.append(self.spell(path))
                states = {s: (0.0, None)}
        done.append(self.spell(max(states.values(), key=lambda x: x[0])[1]))
        return "".join(done).replace("\0", " ").strip()

    @staticmethod
    def codes(option: str) -> tuple[int, ...]:
        """As _CLASS gives them."""
        found = _CODES.get(option)
        if found is None:
            found = _CODES[option] = tuple(_CLASS[list(option.encode())].tolist())
        return found

    @staticmethod
    def spell(path: tuple | None) -> str:
        out = []
        while path:
            path, option = path
            out.append(option)
        return "".join(reversed(out))

    def restore(self, text: str) -> list[str]:
        """Readings of the disguised tokens of a text, in order."""
        out = []
        for drawn, sign in DRAWN.items():
            text = text.replace(drawn, sign)
        for m in SPACED.finditer(text):
            glued, parted = self.decode(APART.sub("", m[0])), self.decode(m[0])
            out += [glued] if parted == glued else [glued, parted]
        at = 0
        for m in DISGUISED.finditer(text):
            if m.start() < at:
                continue
            begin, end = m.span()
            while begin > at and text[begin - 1] in PIECE:
                begin -= 1
            while end < len(text) and text[end] in PIECE:
                end += 1
            at = end
            whole = text[begin:end]
            # Marks at an end may be letters or marks; without them there may be nothing to restore.
            bare = whole.strip("._/-!*|+")
            found = [self.decode(bare)] if len(bare) > 1 and DISGUISED.search(bare) else []
            if whole[0] in LEET or whole[-1] in LEET:
                more = self.decode(whole)
                found += [more] if more not in (*found, bare.lower()) else []
            out += found
        return out


# ---------------------------------------------------------------- marks of toxic texts


def _features(words: Words) -> list[np.ndarray]:
    """Of each word: the word itself and its beginnings, where it is longer."""
    out = [mix64(words.hashes ^ np.uint64(1))]
    for k in PREFIXES:
        out.append(np.where(words.lengths > k, mix64(words.prefix[k] ^ np.uint64(k)), np.uint64(0)) if len(words.hashes) else words.hashes)
    return out


@dataclass
class Marks:
    """Features that mark toxic texts, with the log-odds they give."""

    keys: np.ndarray
    odds: np.ndarray
    weights: np.ndarray | None = None  # of the final model

    def __post_init__(self):
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Log-odds of each hash, 0 where it is no mark."""
        out = np.zeros(len(h))
        maybe = np.flatnonzero(self.sieve[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(maybe) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
            hit = self.keys[at] == h[maybe]
            out[maybe[hit]] = self.odds[at[hit]]
        return out

    def hidden(self, words: Words, doc: np.ndarray, decoder: Decoder) -> list[tuple[int, str]]:
        """(text, word) of marks that stand in two pieces, one of them short, or with doubled letters.

        Only what is a mark when put together goes to the decoder, which must find that reading the likelier one.
        """
        if not len(self.keys):
            return []
        size, starts, raw, out = words.lengths, words.starts, words.bytes, []

        def tried(first: np.ndarray, at: np.ndarray, length: np.ndarray):
            """Numbers of first whose bytes `at`, length of them each, are a mark; and that word."""
            if not len(first):
                return
            text = np.full(len(at) + len(first), 32, np.uint8)
            text[np.arange(len(at)) + np.repeat(np.arange(len(first)), length)] = raw[at]
            ends = np.cumsum(length + 1)
            for k in np.flatnonzero(self.lookup(mix64(Words(text, np.array([0, len(text)]), 0, 1).hashes ^ np.uint64(1)))):
                yield int(first[k]), text[ends[k] - length[k] - 1 : ends[k] - 1].tobytes().decode("utf-8", "replace")

        def word(i: int) -> str:
            return raw[starts[i] : starts[i] + size[i]].tobytes().decode("utf-8", "replace")

        pair = np.flatnonzero((doc[1:] == doc[:-1]) & (np.minimum(size[1:], size[:-1]) <= SHORT))
        both = size[pair] + size[pair + 1]
        at = np.repeat(starts[pair] - (np.cumsum(both) - both), both) + np.arange(both.sum())
        later = at - np.repeat(starts[pair], both) >= np.repeat(size[pair], both)
        at += np.where(later, np.repeat(starts[pair + 1] - starts[pair] - size[pair], both), 0)
        out += [(int(doc[i]), mark) for i, mark in tried(pair, at, both) if decoder.decode(f"{word(i)} {word(i + 1)}") == mark]
        number = np.repeat(np.arange(len(starts)), size)
        at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
        again = np.r_[False, (raw[at[1:]] == raw[at[:-1]]) & (number[1:] == number[:-1]) & (raw[at[1:]] >= 97) & (raw[at[1:]] <= 122)]
        doubled = np.zeros(len(starts), bool)
        doubled[number[again]] = True
        kept = doubled[number] & ~again
        some = np.flatnonzero(doubled)
        out += [(int(doc[i]), mark) for i, mark in tried(some, at[kept], np.bincount(number[kept], minlength=len(starts))[some]) if decoder.decode(word(i)) == mark]
        return out

    def evidence(self, text: pa.Array, decoder: Decoder) -> np.ndarray:
        """For each text: greatest log-odds, log of hits, of words, and whether there is a hit."""
        best, hits, n = (np.zeros(len(text)) for _ in range(3))
        found: dict[int, list[str]] = {}

        def add(column: pa.Array, rows: np.ndarray, plain: bool = False) -> None:
            data, offsets = normal(column)
            for first, last in slices(offsets):
                words = Words(data, offsets, first, last, PREFIXES)
                if not len(words.hashes):
                    continue
                odds = np.maximum.reduce([self.lookup(f) for f in _features(words)])
                some = np.flatnonzero(odds)
                doc = rows[first + np.searchsorted(np.cumsum(words.per_doc), some, side="right")]
                np.maximum.at(best, doc, odds[some])
                np.add.at(hits, doc, 1)
                np.add.at(n, rows[first:last], words.per_doc)
                for i, mark in self.hidden(words, first + words.doc_of(), decoder) if plain else ():
                    found.setdefault(i, []).append(mark)

        add(text, np.arange(len(text)), plain=True)
        for i, t in enumerate(text):
            if t.is_valid and (restored := decoder.restore(t.as_py())):
                found.setdefault(i, []).extend(restored)
        if found:
            add(pa.array([" ".join(found[i]) for i in sorted(found)]), np.array(sorted(found)))
        return np.column_stack([best, np.log1p(hits), np.log1p(n), hits > 0])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return sigmoid(_design(evidence) @ self.weights)


def _design(evidence: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(evidence)), evidence[:, 0] / 5, evidence[:, 1], evidence[:, 3], evidence[:, 3] * evidence[:, 2] / 5])


def held_out(doc_id):
    """crc32 of the id as text, mod 5, is 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _training(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic, fold) of labelled rows that are not held out: MAX_TRAIN, or `most`, at most."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return cut(rows.select("text", (F.col("toxic") > 0).cast("long").alias("toxic"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)).alias("fold")))


def _presence(batches):
    """(key, toxic, group): features of a text once each; near copies share their group's number."""
    for batch in batches:
        text = batch.column("text")
        toxic = np.array(batch.column("toxic").to_pylist(), np.int64)
        group = np.array([int(s[0] >> np.uint64(1)) if len(s) else 0 for s in doc_shingles(text)], np.int64)
        data, offsets = normal(text)
        for first, last in slices(offsets):
            words = Words(data, offsets, first, last, PREFIXES)
            if not len(words.hashes):
                continue
            doc = np.tile(words.doc_of(), 1 + len(PREFIXES))
            key = np.concatenate(_features(words))
            doc, key = doc[key != 0], key[key != 0]
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            once = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]
            doc, key = doc[once] + first, key[once]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(toxic[doc]), pa.array(group[doc])], names=["key", "toxic", "groups"])


def find_marks(train: DataFrame) -> Marks:
    """Features present in more toxic than other texts beyond what chance over all features would give.

    Groups of near copies (one least shingle) count once, or a copied text would make marks of its words.
    """
    sizes = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.countDistinct(F.xxhash64("text")).alias("n")).collect()}
    n_bad, n_good = sizes.get(1, 0), sizes.get(0, 0)
    none = Marks(np.zeros(0, np.uint64), np.zeros(0))
    if not n_bad or not n_good:
        return none
    schema = "key long, toxic long, groups long"
    bad = train.filter("toxic = 1").select("text", "toxic").mapInArrow(_presence, schema).groupBy("key").agg(F.countDistinct("groups").alias("bad"))
    tried = cut(bad)
    bad, n_tried = tried.filter("bad >= 3"), tried.count()
    wanted = bad.select("key")
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    good = train.filter("toxic = 0").select("text", "toxic").mapInArrow(_presence, schema).join(wanted, "key").groupBy("key").agg(F.countDistinct("groups").alias("good"))
    both = bad.join(good, "key", "left").select("key", "bad", F.coalesce("good", F.lit(0)).alias("good"))
    # Only marks come to the driver: most words of toxic texts are none.
    base = n_bad / (n_bad + n_good)
    b, g = F.col("bad"), F.col("good")
    rate = b / (b + g)
    gain = b * F.log(rate / base) + g * F.log(F.greatest(1 - rate, F.lit(1e-9)) / (1 - base))
    odds = F.log((b + 0.5 * base) / (g + 0.5 * (1 - base))) - float(np.log(base / (1 - base)))
    marks = both.filter((rate > 0.5) & (gain > float(np.log(max(2, n_tried))) + 1)).select("key", odds.alias("odds")).toArrow()
    key = marks["key"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(key)
    return Marks(key[order], np.clip(marks["odds"].to_numpy().astype(float)[order], 0, 12))


def fit(docs: DataFrame, labels: DataFrame, decoder: Decoder, most: int = MAX_TRAIN) -> Marks:
    """Marks from three quarters of the training rows; the final model on the evidence of the rest."""
    train = _training(docs, labels, most)
    marks = find_marks(train.filter("fold <> 0"))
    sent = docs.sparkSession.sparkContext.broadcast((marks, decoder))

    def weigh(batches):
        marks, decoder = sent.value
        for batch in batches:
            e = marks.evidence(batch.column("text"), decoder)
            yield pa.RecordBatch.from_arrays([*(pa.array(e[:, i].astype(float)) for i in range(4)), batch.column("toxic")], names=["a", "b", "c", "d", "toxic"])

    rest = train.filter("fold = 0").select("text", "toxic").mapInArrow(weigh, "a double, b double, c double, d double, toxic long").toArrow()
    e = np.column_stack([rest[c].to_numpy() for c in "abcd"]) if rest.num_rows else np.zeros((0, 4))
    y = rest["toxic"].to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        marks.weights = fit_logistic(_design(e), y)
    else:
        marks.weights = np.array([-3.0, 1.0, 1.0, 1.0, 0.0])
    return marks


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Learns only from labelled rows that are not held out; scores depend on the text alone.

    Cases: null and empty texts get the score of a text without marks; a text of any length is read whole; without
    labels of both kinds a fixed model is used; repeated rows and ties score alike, and rows of one doc_id are
    scored each by its own text (the least takes part in the fit); a null doc_id is held out as the empty string would
    be by its checksum; other columns are not read, so their names cannot clash; an empty table gives no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    decoder = Decoder(character_model(slim))
    sent = docs.sparkSession.sparkContext.broadcast((fit(slim, labels, decoder, most), decoder))

    def score(batches):
        marks, decoder = sent.value
        for batch in batches:
            s = marks.score(marks.evidence(batch.column("text"), decoder))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    out = slim.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

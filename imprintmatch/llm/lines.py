"""Line dedup over a store that takes documents in and gives them back.

A store keeps, in a folder that all executors share:

- `postings/<n>`: for every document of step n the key of each line (null for short lines);
- `removed/<n>`: ids of documents that step n took out;
- `counts/<n>`: exact reference counts, (key, refs, least): how many rows of documents hold a key and the smallest doc_id
  among them; a key's latest step counts, and 0 refs mean that nothing holds it any more;
- `filters/<n>`: two cuckoo filters for each shard of keys after step n, of those that something holds (`held`) and of
  those that two rows or more hold (`shared`).

A batch's keys are summed before they are shuffled, so a line that everything holds is one row for each task.  The
`held` filter of a shard tells which of a batch's keys are surely new; only the others meet the exact counts.  Where
lines are judged, those that the `shared` filters do not know stay without a look at the counts.  A document that leaves
lowers the counts of its keys, and keys leave the filters with it, which Bloom filters could not do.  Keys are the first
128 bits of SHA-256.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, cut, lean, lower_ascii, new_folder, shuffle_partitions
from .hashing import mix64

#: What is stripped from lines, and the code points that a key has at least.
SPACE = " \t\n\x0b\f\r"
LEAST_LENGTH = 10
#: Places of a bucket, share of them that may be taken, and rounds of moves before a filter grows.
PLACES, LOAD, ROUNDS = 4, 0.85, 200
FILTERS = "kind string, shard long, buckets long, used long, slots binary"
#: Bytes of `shared` filters that are sent to all tasks; beyond it all lines meet the counts.
MOST_BROADCAST = 64_000_000
HITS = "doc_id long, print binary, line int, key binary"


class Cuckoo:
    """A cuckoo filter of 16-bit fingerprints that takes, finds and drops arrays of 64-bit hashes.

    A fingerprint stands in one of two buckets; either follows from the other and the fingerprint.  Every key is to be
    added once and dropped only while it is there.  A filter that is too full is built anew by its owner, who knows
    the keys.
    """

    def __init__(self, buckets: int, slots: np.ndarray | None = None, used: int = 0):
        self.buckets, self.used = buckets, used
        self.slots = np.zeros((buckets, PLACES), np.uint16) if slots is None else slots.reshape(buckets, PLACES).copy()

    @classmethod
    def for_keys(cls, keys: int) -> Cuckoo:
        """An empty filter with room for twice as many keys, so that it is seldom built anew."""
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, 2 * keys) / (PLACES * LOAD))))))

    def _where(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = mix64(hashes)
        mark = (mixed >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1  # 0 is an empty place
        return mark, (mixed & np.uint64(self.buckets - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mix64(mark.astype(np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        mark, one = self._where(hashes)
        two = self._other(one, mark)
        return (self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1)

    def add(self, hashes: np.ndarray) -> bool:
        """Whether all found a place; otherwise the filter is to be built anew, larger."""
        if self.used + len(hashes) > LOAD * self.buckets * PLACES:
            return False
        mark, bucket = self._where(hashes)
        self.used += len(hashes)
        rng = np.random.default_rng(0)
        for turn in range(ROUNDS):
            placed = self._placed(mark, bucket)
            mark, bucket = mark[~placed], bucket[~placed]
            if not len(mark):
                return True
            bucket = self._other(bucket, mark)
            if turn % 2:  # both buckets are full: one mark of each bucket changes places with one that stands there
                _, first = np.unique(bucket, return_index=True)
                place = rng.integers(0, PLACES, len(first))
                moved = self.slots[bucket[first], place]
                self.slots[bucket[first], place] = mark[first]
                mark[first] = moved
                bucket[first] = self._other(bucket[first], moved)
                full = moved == 0  # an empty place was taken
                keep = np.ones(len(mark), bool)
                keep[first[full]] = False
                mark, bucket = mark[keep], bucket[keep]
        return not len(mark)

    def _placed(self, mark: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Puts marks into empty places of their buckets as far as those go."""
        order = np.argsort(bucket, kind="stable")
        run = bucket[order]
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else np.zeros(0, np.int64)
        rank = np.arange(len(run)) - np.repeat(starts, np.diff(np.r_[starts, len(run)]))
        empty = self.slots[run] == 0
        fits = rank < empty.sum(1)
        nth = np.cumsum(empty, 1) == (rank + 1)[:, None]
        place = (nth & empty).argmax(1)
        self.slots[run[fits], place[fits]] = mark[order][fits]
        out = np.zeros(len(mark), bool)
        out[order[fits]] = True
        return out

    def drop(self, hashes: np.ndarray) -> None:
        """Takes one fingerprint away for each hash."""
        mark, one = self._where(hashes)
        two = self._other(one, mark)
        for m, a, b in zip(mark, one.tolist(), two.tolist()):
            bucket = a if (self.slots[a] == m).any() else b
            place = np.flatnonzero(self.slots[bucket] == m)
            if len(place):
                self.slots[bucket, place[0]] = 0
                self.used -= 1


def line_keys(text: Column) -> Column:
    """The key of every line of a text, in order, as 16 bytes; null for lines whose key is too short."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def key(line: Column) -> Column:
        bare = lower_ascii(F.trim(line, F.lit(SPACE)))
        return F.when(F.length(bare) >= LEAST_LENGTH, F.substring(F.unhex(F.sha2(bare, 256)), 1, 16))

    return F.transform(lines, key)


def _shard(shards: int) -> Column:
    return (F.conv(F.hex(F.substring("key", 9, 4)), 16, 10).cast("long") % shards).alias("shard")


def _hashes(keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64 bits of each key, the bits that choose its shard)."""
    data = np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(-1, 16)
    return data[:, :8].copy().view("<u8").ravel().astype(np.uint64), data[:, 8:12].copy().view(">u4").ravel().astype(np.int64)


def _built(hashes: np.ndarray) -> Cuckoo:
    made = Cuckoo.for_keys(len(hashes))
    while not made.add(hashes):
        made = Cuckoo(2 * made.buckets)
    return made


def _loaded(row: dict) -> Cuckoo:
    return Cuckoo(row["buckets"], np.frombuffer(row["slots"], np.uint16), row["used"])


def _row(key, made: Cuckoo | None) -> pa.Table:
    """A filter as a row; without slots where it is to be built anew."""
    kind, shard = (x.as_py() for x in key)
    row = {"kind": kind, "shard": shard, "buckets": made.buckets if made else 0, "used": made.used if made else 0, "slots": made.slots.tobytes() if made else None}
    return pa.Table.from_pylist([row], arrow_schema(FILTERS))


def _updated(key, changes: pa.Table, old: pa.Table) -> pa.Table:
    changes = changes.combine_chunks()
    hashes, _ = _hashes(changes.column("key"))
    up = changes.column("up").to_numpy().astype(bool)
    if not old.num_rows:
        return _row(key, _built(hashes[up]))
    made = _loaded(old.to_pylist()[0])
    made.drop(hashes[~up])
    return _row(key, made if made.add(hashes[up]) else None)


def _rebuilt(key, keys: pa.Table) -> pa.Table:
    return _row(key, _built(_hashes(keys.column("key"))[0]))


def _probed(key, batch: pa.Table, old: pa.Table) -> pa.Table:
    """Keys of a batch with whether their shard's filter knows them."""
    maybe = _loaded(old.to_pylist()[0]).has(_hashes(batch.column("key"))[0]) if old.num_rows else np.zeros(batch.num_rows, bool)
    return batch.select(["key", "refs", "least"]).append_column("maybe", pa.array(maybe))


class LineStore:
    """Lines of the documents in it; see the module.

    shards bounds what one task holds of the filters and of a batch's distinct keys.  A step that fails leaves files that
    the next attempt of the step writes over.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, shards: int | None = None):
        self.spark, self.folder, self.shards = spark, folder or new_folder(spark, "lines"), shards or shuffle_partitions(spark)
        self.inserted: list[int] = []
        self.removed: list[int] = []

    @property
    def step(self) -> int:
        return len(self.inserted) + len(self.removed)

    def _write(self, df: DataFrame, kind: str) -> DataFrame:
        path = f"{self.folder}/{kind}/{self.step}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _of_steps(self, kind: str, steps: list[int]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.folder}/{kind}/{n}" for n in steps))

    def postings(self) -> DataFrame:
        """(doc_id, print, keys, step) of the documents that are in the store; print tells texts of one id apart."""
        every = self._of_steps("postings", self.inserted)
        if not self.removed:
            return every
        gone = self._of_steps("removed", self.removed).groupBy(F.col("doc_id").alias("gone")).agg(F.max("step").alias("until"))
        return every.join(gone, (F.col("doc_id") == F.col("gone")) & (F.col("until") > F.col("step")), "left_anti")

    def counts(self) -> DataFrame:
        """(key, refs, least) of all keys that something holds."""
        every = self._of_steps("counts", range(self.step))
        if self.step > 1:
            every = every.groupBy("key").agg(F.max_by(F.struct("refs", "least"), "step").alias("now")).select("key", "now.*")
        return every.filter("refs > 0").select("key", "refs", "least")

    def filters(self) -> DataFrame:
        if not self.step:
            return self.spark.createDataFrame([], FILTERS)
        return self._of_steps("filters", [self.step - 1])

    def insert(self, docs: DataFrame) -> None:
        """Take documents in.  Rows of one doc_id are parts of one document."""
        text = F.coalesce(F.col("text"), F.lit(""))
        slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_print(text).alias("print"), line_keys(text).alias("keys"), F.lit(self.step).alias("step"))
        batch = _summed(self._write(slim, "postings"))
        if self.step:
            held = self.filters().filter("kind = 'held'")
            batch = batch.withColumn("shard", _shard(self.shards))
            batch = cut(batch.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(lambda key, a, b: _probed(key, a, b), "key binary, refs long, least long, maybe boolean"))
            old = self.counts().withColumnsRenamed({"refs": "had", "least": "first"})
            met = batch.filter("maybe").join(old, "key", "left")
            fresh = batch.filter("not maybe").withColumns({"had": F.lit(None).cast("long"), "first": F.lit(None).cast("long")})
            batch = met.unionByName(fresh)
        else:
            batch = batch.withColumns({"had": F.lit(None).cast("long"), "first": F.lit(None).cast("long")})
        had = F.coalesce("had", F.lit(0))
        self._close(batch.select("key", (had + F.col("refs")).alias("refs"), F.least("first", "least").alias("least"), had.alias("had")), self.inserted)

    def remove(self, ids: DataFrame) -> None:
        """Take the documents of these doc_ids out, whatever step brought them in."""
        ids = ids.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
        before = self.postings()
        ids = self._write(ids.withColumn("step", F.lit(self.step)), "removed").select("doc_id")
        gone = _summed(before.join(ids, "doc_id", "left_semi")).select("key", F.col("refs").alias("less"))
        now = cut(gone.join(self.counts(), "key").select("key", (F.col("refs") - F.col("less")).alias("refs"), "least", F.col("refs").alias("had")))
        orphans = now.filter("refs > 0").join(ids, F.col("least") == F.col("doc_id"), "left_semi").select("key")
        rest = before.join(ids, "doc_id", "left_anti").select("doc_id", F.explode("keys").alias("key")).join(orphans, "key", "left_semi")
        heirs = rest.groupBy("key").agg(F.min("doc_id").alias("heir"), F.lit(True).alias("orphan"))
        now = now.join(heirs, "key", "left").withColumn("least", F.when(F.col("orphan"), F.col("heir")).otherwise(F.col("least")))
        self._close(now.select("key", "refs", "least", "had"), self.removed)

    def _close(self, changed: DataFrame, steps: list[int]) -> None:
        """Write the counts that a step has changed, (key, refs, least, had before), and the filters after it."""
        changed = self._write(changed.withColumn("step", F.lit(self.step)), "counts")
        old = self.filters()
        kinds = F.array(*(F.struct(F.lit(kind).alias("kind"), (F.col("had") >= least).alias("was"), (F.col("refs") >= least).alias("up")) for kind, least in (("held", 1), ("shared", 2))))
        moves = changed.select("key", _shard(self.shards), F.inline(kinds)).filter("was <> up").select("kind", "shard", "key", "up")
        made = cut(moves.groupBy("kind", "shard").cogroup(old.groupBy("kind", "shard")).applyInArrow(lambda key, a, b: _updated(key, a, b) if a.num_rows else b, FILTERS))
        full = made.filter("slots is null").select("kind", "shard")
        number = self.step
        steps.append(number)
        if not full.isEmpty():
            keys = self.counts().withColumn("shard", _shard(self.shards)).withColumn("kind", F.explode(F.when(F.col("refs") >= 2, F.array(F.lit("held"), F.lit("shared"))).otherwise(F.array(F.lit("held")))))
            anew = keys.join(F.broadcast(full), ["kind", "shard"]).select("kind", "shard", "key").groupBy("kind", "shard").applyInArrow(lambda key, a: _rebuilt(key, a), FILTERS)
            made = made.filter("slots is not null").unionByName(anew)
        made.write.mode("overwrite").parquet(f"{self.folder}/filters/{number}")

    def dropped(self) -> DataFrame:
        """(doc_id, print, lines: numbers of the lines that a text loses), for texts that lose any."""
        shared = self.filters().filter("kind = 'shared'")
        lines = self.postings().select("doc_id", "print", "keys")
        size = shared.agg(F.coalesce(F.sum(F.length("slots")), F.lit(0))).first()[0]
        if size <= MOST_BROADCAST:
            sent, shards = self.spark.sparkContext.broadcast(shared.toArrow().to_pylist()), self.shards
            lines = lines.mapInArrow(lean(lambda batches: _hits(batches, sent.value, shards)), HITS)
        else:
            lines = lines.select("doc_id", "print", F.posexplode("keys").alias("line", "key")).filter("key is not null")
        owners = cut(self.counts().filter("refs > 1 and least is not null").select("key", "least"))
        lost = lines.join(owners, "key").filter("doc_id is null or doc_id > least")
        return lost.groupBy("doc_id", "print").agg(F.collect_set("line").alias("lines"))


def _hits(batches, rows: list[dict], shards: int):
    """Lines whose keys the `shared` filters may know."""
    known = {row["shard"]: _loaded(row) for row in rows}
    for batch in batches:
        lists = batch.column("keys")
        keys = lists.flatten()
        there = np.flatnonzero(keys.is_valid().to_numpy(zero_copy_only=False))
        per_row = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        if not len(there):
            continue
        hashes, shard = _hashes(keys.take(pa.array(there)))
        shard %= shards
        hit = np.zeros(len(there), bool)
        for n in np.unique(shard).tolist():
            if n in known:
                mine = shard == n
                hit[mine] = known[n].has(hashes[mine])
        there = there[hit]
        row = np.repeat(np.arange(len(per_row)), per_row)[there]
        line = there - (np.cumsum(per_row) - per_row)[row]
        row = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("print").take(row), pa.array(line.astype(np.int32)), keys.take(pa.array(there))], schema=arrow_schema(HITS))


def text_print(text: Column) -> Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _summed(postings: DataFrame) -> DataFrame:
    """(key, refs, least) of postings, summed before the shuffle; a row counts once for a key."""
    keys = postings.select("doc_id", F.explode(F.array_distinct("keys")).alias("key")).filter("key is not null")
    return keys.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.min("doc_id").alias("least"))


def without_lines(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs with their lines, the numbers of those to drop, and the text without them: doc_id, n_lines, n_dropped, text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_print(text).alias("print"))
    gone = dropped.withColumnsRenamed({"doc_id": "gone_id", "print": "gone_print"})
    found = slim.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("print") == F.col("gone_print")), "left")
    split = F.split("text", "\n", -1)
    numbers = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "lines")
    kept = F.array_join(F.transform(numbers, lambda n: F.get(split, n)), "\n")
    n_dropped = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines"))
    return found.select("doc_id", F.size(split).cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), F.when(F.col("lines").isNull(), F.col("text")).otherwise(kept).alias("text"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """Documents without the lines that a document of smaller id holds too: doc_id, n_lines, n_dropped, text.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case; keys of fewer than 10 code
    points stay everywhere.  Of the documents that hold another key only that of the smallest doc_id keeps its lines.

    Cases: a null or empty text is one empty line; texts of any length are taken whole; a line that recurs inside the
    document that keeps it stays as often as it stands; rows of one doc_id are one document, and all keep what it keeps;
    rows without a doc_id come after all others and are one document among themselves; an empty table gives no
    rows; only doc_id and text are read, so other columns cannot clash.
    """
    store = LineStore(docs.sparkSession)
    store.insert(docs)
    return without_lines(docs, store.dropped())


def line_digest(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))

"""URL filters by cascades of Bloom filters.

Level 0 holds the listed keys, level 1 the keys of the corpus that wrongly pass level 0, level 2 the
listed keys that wrongly pass level 1, and so on until a level has nothing to hold.  Over the key
universe it was built for, a cascade answers membership exactly, with bit tests and no join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lower_ascii


@dataclass(frozen=True)
class Rule:
    verdict: str  # block or allow
    host: str
    path: str  # starts with /

    @property
    def key(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


@dataclass(frozen=True)
class Level:
    seed: int
    bits: int
    hashes: int
    words: np.ndarray  # int64, bits // 64

    def passes(self, key: Column) -> Column:
        words, out = _literal(self.words), F.lit(True)
        for place in _places(key, self.seed, self.bits, self.hashes):
            word = F.get(words, F.shiftright(place, 6).cast("int"))
            out = out & (F.getbit(word, place.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out


def _literal(words: np.ndarray) -> Column:
    """An array<bigint> literal that goes to the JVM as one block of bytes, not number by number."""
    from pyspark.sql.classic.column import Column as OfJvm

    jvm, gateway = (lambda c: (c._jvm, c._gateway))(SparkSession.active().sparkContext)
    numbers = gateway.new_array(jvm.long, len(words))
    jvm.java.nio.ByteBuffer.wrap(bytearray(words.astype(">i8").tobytes())).asLongBuffer().get(numbers)
    return OfJvm(jvm.org.apache.spark.sql.functions.lit(numbers))


def _places(key: Column, seed: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(bits)) for i in range(hashes)]


def _level(keys: DataFrame, count: int, seed: int, bits_per_key: int, max_bits: int) -> Level:
    """A filter of the rows of keys (one column, key).  Only set words, bits / 64 at most, come back."""
    bits = max(64, -(-count * bits_per_key // 64) * 64)
    if bits > max_bits:
        raise OverflowError(f"{count} keys need {bits} bits; max_bits is {max_bits}")
    hashes = max(1, min(8, round(bits_per_key * 0.69)))
    place = F.explode(F.array(*_places(F.col("key"), seed, bits, hashes))).alias("place")
    set_words = keys.select(place).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))).alias("word"))
    words, found = np.zeros(bits // 64, dtype=np.int64), set_words.toArrow()
    words[found.column("at").to_numpy()] = found.column("word").to_numpy()
    return Level(seed, bits, hashes, words)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """True for the listed keys and false for all other keys of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[k].passes(key), out).otherwise(F.lit(k % 2 == 1))
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = 8, max_bits: int = 1 << 26) -> Cascade:
    """listed, universe: DataFrames of one column, key.  max_bits bounds what is sent to the tasks."""
    inside = cut(listed.select("key").distinct())
    count = inside.count()
    if not count:
        return Cascade(())
    levels = [_level(inside, count, 0, bits_per_key, max_bits)]
    passed = universe.filter(levels[0].passes(F.col("key"))).select("key").distinct()
    outside = cut(passed.join(inside, "key", "left_anti"))
    sets, k = (inside, outside), 1
    while count := sets[1].count():
        levels.append(_level(sets[1], count, k, bits_per_key, max_bits))
        sets, k = (sets[1], cut(sets[0].filter(levels[-1].passes(F.col("key"))))), k + 1
    return Cascade(tuple(levels))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(raw), F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)


def _keys(host: Column, path: Column, lengths: list[int], most: int) -> Column:
    """All host suffixes of as many labels as a rule's host has at most, with all path prefixes as long as a rule's path."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), F.size(labels) - most + 1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda x: x.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(heads, lambda p: F.concat(s, p))))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains where the url's path starts with the rule's; the longest
    rule wins (of equal length, the least by code point).  A url that no rule fits gets `default`.
    A key on both lists counts as blocked.

    Cases: null urls and urls without :// have an empty host and path and fit no rule.  Repeated rows are
    judged alike.  An empty table or rule list gives no error.  Columns other than id and url are not read.  A url of
    any length is judged whole; a long host costs no more keys than its last labels, as many as a rule's host has.
    """
    spark: SparkSession = pages.sparkSession
    host, path = host_and_path(F.col("_url"))
    lengths = sorted({len(r.path) for r in rules})
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    if not rules:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    most = max(r.host.count(".") for r in rules) + 1
    rows = rows.withColumn("_keys", _keys(F.col("host"), F.col("path"), lengths, most))
    universe = rows.select(F.explode("_keys").alias("key"))
    blocked = {r.key for r in rules if r.verdict == "block"}
    lists = {"block": blocked, "allow": {r.key for r in rules} - blocked}
    made = {v: build_cascade(spark.createDataFrame([(k,) for k in sorted(keys)], "key string"), universe, **options) for v, keys in lists.items()}
    fit = F.filter("_keys", lambda k: made["block"].contains(k) | made["allow"].contains(k))
    ranked = F.array_sort(F.transform(fit, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key"))))
    rows = rows.select("page_id", "host", "path", F.get(ranked, F.lit(0)).getField("key").alias("rule"))
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(made["block"].contains(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return rows.withColumn("verdict", verdict)

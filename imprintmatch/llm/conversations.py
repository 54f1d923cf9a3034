"""Conversation structure repair by the cheapest edits.

A conversation's rows are edited to the pattern `(s?(ua)+)?` of role initials.  The edits are found as the least
path in a layered graph whose weights are single big integers: the high digits carry the cost, below them stand
W digits of three bits, one for each place of the audit, that hold the letters of the edits in order; places after
the last edit hold zero.  So the least integer is the least cost, and of equal costs the ASCII-least audit.

Short conversations are repaired where their rows meet in one sorted partition.  A conversation with more rows than
an average partition (at most as many of those as there are partitions) is dealt over ranges of its order in blocks;
a block is summed up by its least paths from every state to every state, blocks are chained by those sums, and
only text already repaired is brought into order, block by block, for the hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut, lean, shuffle_partitions

#: ASCII white space, ends of a sentence, and the digit of each edit's letter (0 ends an audit).
SPACE = " \t\n\x0b\f\r"
ENDS = ".!?"
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing said yet, only the system's turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {"u": "user", "a": "assistant"}
#: Inserts that end a conversation from each state.
CLOSING = ("", "II", "I", "")
#: Rows of a block of a long conversation; patterns of so many rows at most that a task remembers.
BLOCK, REMEMBERED, LONGEST_KNOWN = 512, 50_000, 32
#: A conversation with fewer rows is never dealt over partitions.
LEAST_LONG = 20_000
_LETTERS = " DIKR"

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def least_paths(codes: str, entry: int = START) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) of the edits of rows from a state to every state they can end in, without closing inserts.

    A code is `d` for a row that must go, else its role's initial (`x` for any other, `e` for none), in upper case
    where the row is truncated.  One insert before a row is enough: two lead back to where one was.  Two
    paths of one cost to one state never hold audits of which one begins the other (the longer has more inserts), so
    the least of a state's integers is all that the next row needs.
    """
    width = 2 * len(codes) + 2
    price = 1 << 3 * width
    at = {entry: (0, 0)}  # state: (weight, letters so far)
    for code in codes:
        reached: dict[int, tuple[int, int]] = {}
        before = dict(at)
        for state, (weight, n) in at.items():
            nxt = ASSISTANT if state == USER else USER
            inserted = weight + INSERT * price + (DIGIT["I"] << 3 * (width - 1 - n))
            if nxt not in before or inserted < before[nxt][0]:
                before[nxt] = inserted, n + 1
        for state, (weight, n) in [*at.items(), *((s, x) for s, x in before.items() if at.get(s) != x)]:
            place = 3 * (width - 1 - n)
            wanted = ASSISTANT if state == USER else USER
            edits = [("D", DELETE, state)]
            if code != "d":
                more = TRUNCATED if code.isupper() else 0
                edits.append(("R", REROLE + more, wanted))
                kept = _kept(code.lower(), state)
                if kept is not None:
                    edits.append(("K", KEEP + more, kept))
            for letter, cost, to in edits:
                found = weight + cost * price + (DIGIT[letter] << place)
                if to not in reached or found < reached[to][0]:
                    reached[to] = found, n + 1
        at = reached
    return {state: (weight >> 3 * width, _audit(weight, width, n)) for state, (weight, n) in at.items()}


def _kept(initial: str, state: int) -> int | None:
    """The state after a kept row, or None where it may not stand."""
    if initial == "e":
        return state
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == "u":
        return USER if state != USER else None
    if initial == "a":
        return ASSISTANT if state == USER else None
    return None


def _audit(weight: int, width: int, n: int) -> str:
    return "".join(_LETTERS[weight >> 3 * (width - 1 - k) & 7] for k in range(n))


def closed(paths: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return min((cost + INSERT * len(CLOSING[state]), audit + CLOSING[state]) for state, (cost, audit) in paths.items())


def sums_of(codes: str, known=least_paths) -> list[tuple[int, int, int, int]]:
    """(entry, state, least cost, place of its audit among those of the entry) of a block of rows."""
    sums = []
    for entry in range(4):
        paths = known(codes, entry)
        order = {audit: k for k, audit in enumerate(sorted(audit for _, audit in paths.values()))}
        sums += [(entry, state, cost, order[audit]) for state, (cost, audit) in paths.items()]
    return sums


def chained(blocks: Iterable[list[tuple[int, int, int, int]]]) -> tuple[list[tuple[int, int]], str]:
    """((entry, state) of every block of a conversation on its least path, closing inserts), from the blocks' sums.

    Every block's audit ends with a row's letter, so audits that lead to different states differ within both: of
    equal costs the order of what stands before decides, and of one origin the order within the block.
    """
    steps, at = [], {START: (0, 0)}
    for sums in blocks:
        found: dict[int, tuple[int, int, int]] = {}
        for entry, state, more, place in sums:
            if entry in at:
                cost, rank = at[entry]
                label = cost + more, 4 * rank + place, entry
                found[state] = min(label, found.get(state, label))
        order = {r: k for k, r in enumerate(sorted(r for _, r, _ in found.values()))}
        at = {state: (cost, order[r]) for state, (cost, r, _) in found.items()}
        steps.append({state: entry for state, (_, _, entry) in found.items()})
    state = min(at, key=lambda s: (at[s][0] + INSERT * len(CLOSING[s]), at[s][1]))
    closing, out = CLOSING[state], []
    for step in reversed(steps):
        out.append((step[state], state))
        state = step[state]
    return out[::-1], closing


def best_edits(codes: str, known=least_paths) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation; of more than BLOCK rows block by block, so the time grows with them."""
    if len(codes) <= BLOCK:
        return closed(known(codes, START))
    blocks = [codes[k : k + BLOCK] for k in range(0, len(codes), BLOCK)]
    path, closing = chained(sums_of(b, known) for b in blocks)
    found = [known(b, entry)[state] for b, (entry, state) in zip(blocks, path)]
    return sum(cost for cost, _ in found) + INSERT * len(closing), "".join(audit for _, audit in found) + closing


def code_of(role: str, blank: bool, seen: bool, truncated: bool) -> str:
    if blank or seen:
        return "d"
    code = (role[0] if role[0] in "usa" else "x") if role else "e"
    return code.upper() if truncated else code


def applied(audit: str, rows: list[tuple[str, str]], state: int = START) -> tuple[list[str], int]:
    """(`role:text` of what an audit makes of rows, the state after it)."""
    out, left = [], iter(rows)
    for letter in audit:
        if letter == "D":
            next(left)
            continue
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "K":
            initial = role[:1]
            state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial, state)
        else:
            state = ASSISTANT if state == USER else USER
            role = NAMES["a" if state == ASSISTANT else "u"]
        out.append(f"{role}:{text}")
    return out, state


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage: conv_id, turn, role, text, copies (0 for a dropped one), blank, truncated."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20).cast("int")
    rows = conversations.select("conv_id", "turn", kind.alias("_kind"), word("role").alias("role"), word("text").alias("text"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ENDS, "")).when(F.col("_kind") == 0, "").otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))
    return rows.withColumns({"blank": _bare("text") == "", "truncated": ~F.right(_bare("text"), F.lit(1)).isin(*ENDS)})


def _bare(text: str) -> Column:
    return F.rtrim(F.col(text), F.lit(SPACE))


class _Known:
    """Least paths by pattern, remembered within a bound."""

    def __init__(self):
        self.found: dict = {}

    def __call__(self, codes: str, entry: int) -> dict[int, tuple[int, str]]:
        if len(codes) > LONGEST_KNOWN:
            return least_paths(codes, entry)
        got = self.found.get((codes, entry))
        if got is None:
            if len(self.found) >= REMEMBERED:
                self.found.clear()
            got = self.found[codes, entry] = least_paths(codes, entry)
        return got


class _Whole:
    """One conversation whose rows come in order."""

    def __init__(self, conv_id):
        self.conv_id, self.rows, self.codes, self.turns, self.seen = conv_id, [], [], set(), set()
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn, role: str, text: str, copies: int, blank: bool, truncated: bool) -> None:
        for _ in range(copies):
            seen = not blank and (role, text) in self.seen
            self.seen.add((role, text))
            fault = "blank" if blank else "duplicate" if seen else "truncated" if truncated else None
            if fault:
                self.counts[fault] += 1
            self.rows.append((role, text))
            self.codes.append(code_of(role, blank, seen, truncated))
            if turn is not None:
                self.turns.add(turn)

    def result(self, known: _Known) -> dict:
        cost, audit = best_edits("".join(self.codes), known)
        made = "\n".join(applied(audit, self.rows)[0])
        gaps = max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0
        illegal = illegal_pairs([role[:1] for role, _ in self.rows])
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "illegal": illegal, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(made.encode()).hexdigest()}


def _batches(rows: Iterator[dict], schema: pa.Schema, many: int = 2000) -> Iterator[pa.RecordBatch]:
    some = []
    for row in rows:
        some.append(row)
        if len(some) == many:
            yield pa.RecordBatch.from_pylist(some, schema)
            some = []
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


_COLUMNS = ("conv_id", "turn", "role", "text", "copies", "blank", "truncated")


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in batch.schema.names))


def _repair_whole(batches):
    known = _Known()

    def results():
        now = None
        for conv_id, *row in _rows(batches):
            if now is None or now.conv_id != conv_id:
                if now:
                    yield now.result(known)
                now = _Whole(conv_id)
            now.add(*row)
        if now:
            yield now.result(known)

    yield from _batches(results(), arrow_schema(RESULT))


def _in_order(rows: DataFrame) -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def repair_conversations(conversations: DataFrame, least_long: int = LEAST_LONG) -> DataFrame:
    """One row for every conv_id of conversations, after the damage and its repair; see RESULT for the columns.

    Costs: Keep 0, Rerole to user or assistant 2, Delete 3 (a blank or duplicate row has no other edit), Insert 2;
    an undeleted truncated row adds 1.  The audit names the cheapest edits in order (D, I, K, R), of equally cheap
    ones the ASCII-least.

    Cases: null turns, roles and texts count as one blank in the damage and as role or text; null turns come first
    and count for no gap; rows of one turn follow by role and text; repeated rows are rows, all but the first
    duplicates; a null conv_id is a conversation of its own; an empty role has no initial, so keeping its row changes
    nothing in the pattern, and pairs with it are illegal; a conversation without a row after the damage gives zeros,
    an empty audit and the hash of nothing; an empty table gives no rows; texts of any length are hashed whole;
    other columns are not read.
    """
    spark = conversations.sparkSession
    parts = shuffle_partitions(spark)
    sizes = conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_rows"))
    most = max(least_long, conversations.count() // parts)
    names = [r[0] for r in sizes.filter(F.col("_rows") > most).select("conv_id").collect()]  # fewer than parts
    rows = damaged(conversations)
    if not names:
        return _whole_ones(rows, parts)
    long_ones = F.broadcast(spark.createDataFrame(list(enumerate(names)), "conv int, long_id long"))
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    chosen = rows.join(long_ones, same).drop("conv_id", "long_id")
    return _whole_ones(rows.join(long_ones, same, "left_anti"), parts).unionByName(_long_ones(chosen, long_ones, parts))


def _whole_ones(rows: DataFrame, parts: int) -> DataFrame:
    dealt = rows.repartition(parts, "conv_id").sortWithinPartitions(*_in_order(rows))
    return dealt.select(*_COLUMNS).mapInArrow(lean(_repair_whole), RESULT)


# Long conversations: `conv` numbers them, so no key is null.

_BLOCKS = "conv int, part int, seq long, codes string, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string"
_SUMS = "conv int, part int, seq long, entries array<int>, states array<int>, costs array<long>, ranks array<int>"
_CHOICE = "conv int, part int, seq long, entry int, state int, closing string"
_PIECES = "conv int, part int, seq long, cost long, audit string, made string, blank long, duplicate long, truncated long, illegal long, first string, last string"
_JOINED = "conv int, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _long_ones(rows: DataFrame, names: DataFrame, parts: int) -> DataFrame:
    there = rows.filter("copies > 0").groupBy("conv", "turn", "role", "text", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    there = cut(there.withColumn("digest", F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)))
    turn = F.struct(F.col("turn").isNotNull().alias("named"), F.col("turn").alias("turn"))
    firsts = cut(there.groupBy("conv", "digest").agg(F.min(turn).alias("earliest")))
    marked = there.join(firsts, ["conv", "digest"]).withColumn("new", F.col("earliest.turn").eqNullSafe(F.col("turn")))
    # ranges by the head of a text: where heads are equal, and the roles with them, rows stay together.
    keys = ["conv", F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.when(F.length("role") < 64, F.substring("text", 1, 64)).otherwise("")]
    ranged = marked.repartitionByRange(parts, *keys).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    ranged = ranged.select("conv", F.spark_partition_id().alias("part"), "role", "text", "copies", "blank", "truncated", "new")
    blocks = cut(ranged.mapInArrow(lean(_to_blocks), _BLOCKS))
    sums = blocks.select("conv", "part", "seq", "codes").mapInArrow(lean(_to_sums), _SUMS)
    choice = sums.repartition(parts, "conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(lean(_to_choice), _CHOICE)
    pieces = blocks.join(choice, ["conv", "part", "seq"]).mapInArrow(lean(_to_pieces), _PIECES)
    whole = pieces.repartition(parts, "conv").sortWithinPartitions("conv", "part", "seq").mapInArrow(lean(_to_results), _JOINED)
    turns = there.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    found = names.join(whole, "conv", "left").join(turns, "conv", "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(F.col("long_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def _to_blocks(batches):
    def results():
        block, seq = None, 0
        for conv, part, role, text, copies, blank, truncated, new in _rows(batches):
            for k in range(copies):
                seen = not blank and not (new and k == 0)
                code = code_of(role, blank, seen, truncated)
                if block and (block["conv"] != conv or len(block["codes"]) == BLOCK):
                    yield block | {"codes": "".join(block["codes"])}
                    block = None
                if block is None:
                    seq += 1
                    block = {"conv": conv, "part": part, "seq": seq, "codes": [], "roles": [], "texts": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": role[:1]}
                else:
                    block["illegal"] += illegal_pairs([block["last"], role[:1]])
                block["last"] = role[:1]
                block["codes"].append(code)
                fault = "blank" if blank else "duplicate" if seen else "truncated" if truncated else None
                if fault:
                    block[fault] += 1
                if code != "d":
                    block["roles"].append(role)
                    block["texts"].append(text)
        if block:
            yield block | {"codes": "".join(block["codes"])}

    yield from _batches(results(), arrow_schema(_BLOCKS), 16)


def _to_sums(batches):
    """Of each block and entry: the least cost for every state after it, and the place of its audit among those."""
    known = _Known()

    def results():
        for conv, part, seq, codes in _rows(batches):
            yield {"conv": conv, "part": part, "seq": seq} | dict(zip(("entries", "states", "costs", "ranks"), zip(*sums_of(codes, known))))

    yield from _batches(results(), arrow_schema(_SUMS))


def _to_choice(batches):
    """The states of the least path of a conversation before and after each of its blocks."""

    def results():
        for conv, rows in groupby(_rows(batches), key=lambda row: row[0]):
            places = []

            def own(rows=rows, places=places):
                for _, part, seq, *sums in rows:
                    places.append((part, seq))
                    yield list(zip(*sums))

            path, closing = chained(own())
            for k, ((part, seq), (entry, state)) in enumerate(zip(places, path)):
                yield {"conv": conv, "part": part, "seq": seq, "entry": entry, "state": state, "closing": closing if k == len(path) - 1 else ""}

    yield from _batches(results(), arrow_schema(_CHOICE))


def _to_pieces(batches):
    known = _Known()

    def results():
        for batch in batches:
            for x in batch.to_pylist():
                cost, audit = known(x["codes"], x["entry"])[x["state"]]
                kept = iter(zip(x["roles"], x["texts"]))
                rows = [("", "") if code == "d" else next(kept) for code in x["codes"]]
                made, _ = applied(audit + x["closing"], rows, x["entry"])
                same = {c: x[c] for c in ("conv", "part", "seq", "blank", "duplicate", "truncated", "illegal", "first", "last")}
                yield same | {"cost": cost + INSERT * len(x["closing"]), "audit": audit + x["closing"], "made": "\n".join(made) if made else None}

    yield from _batches(results(), arrow_schema(_PIECES), 16)


def _to_results(batches):
    counts = ("blank", "duplicate", "truncated", "illegal", "cost")

    def results():
        row, audit, digest, made, last = None, [], None, False, ""
        for batch in batches:
            for x in batch.to_pylist():
                if row is None or row["conv"] != x["conv"]:
                    if row:
                        yield row | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
                    row, audit, digest, made = {"conv": x["conv"]} | dict.fromkeys(counts, 0), [], hashlib.sha256(), False
                else:
                    row["illegal"] += illegal_pairs([last, x["first"]])
                for c in counts:
                    row[c] += x[c]
                audit.append(x["audit"])
                last = x["last"]
                if x["made"] is not None:
                    digest.update((b"\n" if made else b"") + x["made"].encode())
                    made = True
        if row:
            yield row | {"audit": "".join(audit), "repaired_sha256": digest.hexdigest()}

    yield from _batches(results(), arrow_schema(_JOINED))

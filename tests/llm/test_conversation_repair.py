"""Conversation repair against a search over all edit sequences, and the two ways of dealing rows against each other."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from imprintmatch.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
GOAL = re.compile(r"(s?(ua)+)?\Z")
SPACE = " \t\n\x0b\f\r"


def every_edit(rows):
    """(cost, audit, repaired) of all sequences of edits of rows [(role, text, fault)] with up to two inserts in a gap."""
    def walk(i, cost, audit, out, inserts):
        if i == len(rows):
            yield cost, audit, out
        if inserts < 2:
            for role in ("user", "assistant"):
                yield from walk(i, cost + 2, audit + "I", [*out, (role, "")], inserts + 1)
        if i == len(rows):
            return
        role, text, fault = rows[i]
        yield from walk(i + 1, cost + 3, audit + "D", out, 0)
        if fault in ("blank", "duplicate"):
            return
        more = int(fault == "truncated")
        yield from walk(i + 1, cost + more, audit + "K", [*out, (role, text)], 0)
        for new in ("user", "assistant"):
            yield from walk(i + 1, cost + 2 + more, audit + "R", [*out, (new, text)], 0)

    return walk(0, 0, "", [], 0)


def search(rows):
    """The same by a search in order of (cost, audit), with any number of inserts: for longer conversations."""
    done, n = set(), itertools.count()
    heap = [(0, "", next(n), 0, "", ())]
    while heap:
        cost, audit, _, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out

        def go(letter, price, i, role, text):
            after = state + role[:1] if role[:1] == "s" else role[:1] if (state[-1:], role[:1]) in {("", "u"), ("s", "u"), ("a", "u"), ("u", "a")} else None if role else state
            if after in ("", "s", "u", "a"):
                heapq.heappush(heap, (cost + price, audit + letter, next(n), i, after, (*out, (role, text))))

        for role in ("user", "assistant"):
            go("I", 2, i, role, "")
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", next(n), i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                go("K", more, i + 1, role, text)
                for new in ("user", "assistant"):
                    go("R", 2 + more, i + 1, new, text)


def brute(conversation):
    """The contract's columns of one conversation [(conv_id, turn, role, text)]."""
    one = lambda x: " " if x is None else str(x)
    rows = []
    for conv_id, turn, role, text in conversation:
        kind = zlib.crc32(f"{one(conv_id)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * (2 if kind == 3 else 1)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    best = search([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    return {
        "conv_id": conversation[0][0], "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": best[0], "audit": best[1],
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest(),
    }


def table(seed, conversations=60, most=4):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", "tool", None, ""], ["Yes.", "No", " \n", None, "Well!", "so \t", "?x", "Yes. "]
    return [
        (c, rng.choice([t, t, t, None, 2 * t]), rng.choice(roles[:3] * 3 + roles), rng.choice(texts))
        for c in [None, *range(conversations)] for t in range(rng.randint(1, most))
    ]


def grouped(rows):
    return [list(g) for _, g in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), key=lambda r: r[0])]


def as_dicts(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0))


@pytest.mark.parametrize("codes", [["".join(c) for n in range(3) for c in itertools.product("dusaxeUSA", repeat=n)], ["usa", "dUa", "ssu", "aeA", "xdu", "Uua"]])
def test_least_integer_is_the_least_cost_and_audit(codes):
    for some in codes:
        check(some)


def check(codes):
    names = {"u": "user", "s": "system", "a": "assistant", "x": "tool", "e": "", "d": "user"}
    rows = [(names[c.lower()], "t", "blank" if c == "d" else "truncated" if c.isupper() else None) for c in codes]
    best = min((c, a) for c, a, o in every_edit(rows) if GOAL.match("".join(r[:1] for r, _ in o)))
    assert C.closed(C.least_paths(codes)) == best == search(rows)[:2]


def test_blocks_chained_equal_one_path(monkeypatch):
    rng = random.Random(6)
    for n in (1, 5, 40, 90):
        codes = "".join(rng.choice("duasxeUASX") for _ in range(n))
        whole = C.best_edits(codes)
        for block in (1, 2, 7, 64):
            monkeypatch.setattr(C, "BLOCK", block)
            assert C.best_edits(codes) == whole
        monkeypatch.undo()
    cost, audit = C.best_edits("usaxUd" * 20_000)
    assert len(audit.replace("I", "")) == 120_000 and cost > 0


def test_repair_equals_a_search_over_all_edits(spark):
    rows = table(1)
    assert as_dicts(C.repair_conversations(spark.createDataFrame(rows, SCHEMA))) == [brute(g) for g in grouped(rows)]


def test_long_conversations_are_repaired_alike(spark, monkeypatch):
    rng = random.Random(3)
    long_one = [(7, t // 2, rng.choice(["user", "assistant", "system"]), f"{rng.randint(0, 300)}{rng.choice(['.', '', '?'])}") for t in range(1500)]
    rows = [*table(2, 20), *long_one, *[(30, 1, "user", "again and again.")] * 2000, *[(9, None, "user", "x")] * 900]
    frame = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(C, "BLOCK", 16)
    whole = as_dicts(C.repair_conversations(frame))
    assert as_dicts(C.repair_conversations(frame, least_long=0)) == whole
    names = {r["conv_id"]: r for r in whole}
    assert names[30]["duplicate"] in (0, 1999, 3999) and len(whole) == len({r[0] for r in rows})


def test_all_rows_dropped_and_no_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(gone, 0, "user", "Yes.")] * 3, SCHEMA)
    empty = {"conv_id": gone, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    assert as_dicts(C.repair_conversations(frame)) == as_dicts(C.repair_conversations(frame, least_long=0)) == [empty]
    assert C.repair_conversations(frame.limit(0)).count() == 0


def test_other_columns_may_have_any_name(spark):
    rows = table(4, 10)
    frame = spark.createDataFrame(rows, SCHEMA)
    clash = frame.selectExpr("*", "'x' as copies", "1 as blank", "2 as audit", "3 as conv", "4 as long_id")
    assert as_dicts(C.repair_conversations(clash)) == as_dicts(C.repair_conversations(frame))
    assert as_dicts(C.repair_conversations(clash, least_long=0)) == as_dicts(C.repair_conversations(frame))

"""Edits against all that are possible, and damage against zlib."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from stridewell.llm import repair

FORM = re.compile(r"(s?(ua)+)?")
BLANK = "\t\n\x0b\x0c\r "


def damage(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text)
        yield from [row] * (0 if fate == 0 else 2 if fate == 3 else 1)


def cheapest(turns):
    """(cost, audit, repaired) by trying all edits that cost no more than deleting every turn."""
    best = (10**9, "", None)

    def go(i, cost, audit, left):
        nonlocal best
        if cost > min(2 * len(turns), best[0]):
            return
        if i == len(turns) and FORM.fullmatch("".join(r[:1] or "?" for r, _ in left)):
            best = min(best, (cost, audit, left))
        for role in ("user", "assistant"):
            go(i, cost + 5, audit + "I", [*left, (role, "")])
        if i < len(turns):
            role, text, fault = turns[i]
            go(i + 1, cost + 2, audit + "D", left)
            if fault not in ("blank", "duplicate"):
                more = cost + 5 * (fault == "truncated")
                go(i + 1, more, audit + "K", [*left, (role, text)])
                for to in ("user", "assistant"):
                    go(i + 1, more + 1, audit + "R", [*left, (to, text)])

    go(0, 0, "", [])
    return best


def brute(rows):
    after, out = {conv: [] for conv, *_ in rows}, []
    for r in damage(rows):
        after[r[0]].append(r)
    for conv, own in after.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns, seen = [], set()
        for _, _, role, text in own:
            body = text.rstrip(BLANK)
            turns.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
            seen.add((role, text))
        numbers = [t for _, t, *_ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults = Counter(f for *_, f in turns)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        cost, audit, left = cheapest(turns)
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()))
    return out


def some(seed, convs=60):
    rng, rows = random.Random(seed), []
    for conv in [*range(convs), None]:
        for turn in range(rng.randrange(7)):
            role = rng.choice(["user", "assistant"] * 3 + ["system", "tool", "", None, "usher"])
            text = rng.choice(["Yes.", "No!", "A line\nand more.", "cut off", "Ends? \n", " ", "", " ", None, f"Text {turn}.", " "])
            rows += [(conv, rng.choice([turn, turn, turn + rng.randrange(4), None]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 512), (3, 1), (4, 2), (5, 3)])
def test_digests_against_all_edits(spark, monkeypatch, seed, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = some(seed)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"at": F.lit(1), "c": F.lit(2), "block": F.lit("x"), "a.b": F.lit(0)}).repartition(3)
    got = repair.digests(df)
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows))
    assert repair.digests(df.limit(0)).count() == 0


def test_a_long_conversation_and_the_sql(spark):
    """A third of all turns in one conversation, in many blocks; the SQL's rows."""
    rng = random.Random(8)
    rows = [(1, i, rng.choice(["user", "assistant"]), rng.choice(["Yes.", f"Turn {i}.", f"Turn {i}", ""])) for i in range(900)] + some(9, 300)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    table = df.toArrow()
    con.register("conversations", table)
    cur = con.execute(repair.ORACLE)
    names = [c[0] for c in cur.description]
    repair_block = repair.BLOCK
    try:
        repair.BLOCK = 50
        got = repair.digests(df).select(*names).collect()
    finally:
        repair.BLOCK = repair_block
    assert Counter(map(tuple, got)) == Counter(cur.fetchall())


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "A."), (1, 2, "user", "B."), (1, 3, "user", "C."), (2, 0, "user", "x")]
    audit, parts = repair.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in audit.collect()} == {1: (3, "KDKR"), 2: (2, "D")}
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in parts.collect()} == {1: [("system", "S."), ("user", "B."), ("assistant", "C.")], 2: []}

"""Repair of conversations against an enumeration of all edits."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from tablewright.llm import repair

BLANK = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, repaired) of (role, text, fault) by trying everything, up to two insertions at a place."""
    inserts = ["", "u", "a", "ua", "au"]
    steps = []
    for role, text, fault in rows:
        choices = [("D", 3, None)]
        if fault not in ("blank", "duplicate"):
            cut = fault == "truncated"
            choices += [("K", cut, (role, text)), *[("R", 2 + cut, (r, text)) for r in ROLES.values()]]
        steps.append(choices)
    best = None
    for gaps in product(inserts, repeat=len(rows) + 1):
        for taken in product(*steps):
            cost, audit, kept = 0, "", []
            for gap, step in zip(gaps, (*taken, None), strict=True):
                cost, audit = cost + 2 * len(gap), audit + "I" * len(gap)
                kept += [(ROLES[g], "") for g in gap]
                if step:
                    cost, audit = cost + step[1], audit + step[0]
                    kept += [step[2]] if step[2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in kept)):
                found = (cost, audit, "\n".join(f"{r}:{t}" for r, t in kept))
                best = found if best is None or found[:2] < best[:2] else best
    return best


def expected(rows):
    """``rows``: (turn, role, text) of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        held = text.rstrip(BLANK)
        fault = "blank" if not held else "duplicate" if (role, text) in seen else "truncated" if held[-1] not in ".!?" else ""
        faults.append(fault)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, text = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)])
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        fault = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        if fault == 0:
            continue
        role, text = "user" if fault == 4 else shown[2], "" if fault == 1 else re.sub("[.!?]", "", shown[3]) if fault == 2 else shown[3]
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


COLUMNS = list(repair.RESULT)


def results(df):
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in df.collect()}


@pytest.mark.parametrize("block", [1, 2, 256])
def test_least_edits_equal_all_edits(spark, block):
    draw = random.Random(block)
    texts = ["Yes.", "No!", "and then", " ", "", "Well? ", "so\n", "Last."]
    roles = ["system", "user", "assistant", "tool", "", "user", "assistant"]
    rows = [(c, draw.choice([None, 0, 1, 2, 3, 5]), draw.choice(roles), draw.choice(texts), 1) for c in range(30) for _ in range(draw.choice([1, 2, 3, 3]))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int").repartition(5)
    got = results(repair.repair(df, block))
    for conv in range(30):
        assert got[conv] == expected([r[1:4] for r in rows if r[0] == conv]), [r for r in rows if r[0] == conv]


def test_blocks_do_not_change_results(spark):
    draw = random.Random(3)
    rows = [
        (c, t, draw.choice(["system", "user", "assistant", "assistant", "other"]), draw.choice(["a.", "b", f"{t}.", f"{t}", ""]), draw.choice([1, 1, 1, 4]))
        for c, n in enumerate([40, 17, 3, 64])
        for t in range(n)
    ]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string, copies int").repartition(3)
    whole = results(repair.repair(df, 1000))
    for block in (1, 7, 16):
        assert results(repair.repair(df, block)) == whole
    assert all(re.fullmatch("[DIKR]*", r[6]) for r in whole.values()) and len(whole) == 4


def test_damage_nulls_ties_and_clashing_columns(spark):
    rows = [(c, t, r, x) for c in range(40) for t, r, x in [(0, "user", "Hi there."), (1, "assistant", "Hello! "), (2, "user", "x")]]
    rows += [(None, None, None, None), (None, 1, "user", "one."), (7, None, "assistant", "null turn."), (7, 0, "user", "tie"), (-1, 5, None, "no role.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = results(repair.repair(repair.damaged(df.withColumns({c: F.lit("clash") for c in ("copies", "after", "fresh", "blank", "of")}))))
    after = damage(rows)
    assert got.keys() == {r[0] for r in rows}
    for conv in got:
        assert got[conv] == expected([r[1:] for r in after if r[0] == conv])
    everything_dropped = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = results(repair.repair(repair.damaged(spark.createDataFrame(everything_dropped, df.schema))))
    assert set(got.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())} and len(got) == len(everything_dropped)
    assert repair.repair(repair.damaged(df.limit(0))).count() == 0


def test_a_hot_conversation_and_many_copies(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(1200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copies", F.lit(1))
    copies = spark.range(20_000).selectExpr("2L AS conv_id", "3L AS turn", "'user' AS role", "'same.' AS text", "1 AS copies")
    got = results(repair.repair(df.union(copies)))
    assert got[1][:7] == (0, 0, 0, 0, 0, 0, "K" * 1200)
    # the copies go; an answer is put after the one that stays, or that one goes too where this is as cheap
    assert got[2][2] == 19_999 and got[2][4] == 19_999 and got[2][5] == 3 * 19_999 + 2
    assert got[2][6] == "K" + "D" * 19_999 + "I"


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = results(repair.repair(repair.damaged(table)))
    after = damage(rows)
    assert got.keys() == {r[0] for r in rows}
    for conv in got:
        mine = [r[1:] for r in after if r[0] == conv]
        if len(mine) <= 3:
            assert got[conv] == expected(mine)

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from helpers import SMALL, in_duckdb, same_rows

import __spark_entry__ as entry
from ridgeline.llm.conversation_repair import SQL, Repair, damaged, repair_report, repaired_turns
from ridgeline.llm.repair_tables import Costs

SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = " \t\n\x0b\x0c\r"
FORCED = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(turns):
    """(cost, audit, repaired lines) of [(role, text, fault)]: the least pair of
    cost and letters for each state, turn by turn from the start."""
    now = {0: (0, "", ())}

    def offer(into, q, found):
        if q not in into or found[:2] < into[q][:2]:
            into[q] = found

    def inserts(now):
        for _ in range(4):
            for q, (cost, audit, out) in list(now.items()):
                to, role = FORCED[q]
                offer(now, to, (cost + 2, audit + "I", (out, f"{role}:")))
        return now

    for role, text, fault in turns:
        new = {}
        for q, (cost, audit, out) in inserts(now).items():
            offer(new, q, (cost + 3, audit + "D", out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (q, role[:1]) in KEPT:
                    offer(new, KEPT[q, role[:1]], (cost + more, audit + "K", (out, f"{role}:{text}")))
                to, other = FORCED[q]
                offer(new, to, (cost + 2 + more, audit + "R", (out, f"{other}:{text}")))
        now = new
    ends = inserts(now)
    cost, audit, out = min((ends[q] for q in (0, 3) if q in ends), key=lambda e: e[:2])
    lines = []
    while out:
        out, line = out
        lines.append(line)
    return cost, audit, lines[::-1]


def by_hand(rows, ids=()):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, " " if role is None else role, hashlib.md5((" " if text is None else text).encode()).hexdigest(), " " if text is None else text))
    out = {}
    for conv in {*convs, *ids}:
        seen, turns, before, illegal = set(), [], None, 0
        for _, _, role, _, text in sorted(convs[conv]):
            body = text.strip(BLANK)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else None if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            illegal += before is not None and before + role[:1] not in ("su", "ua", "au")
            before = role[:1]
            turns.append((role, text, fault))
        numbers = [t[1] for t in convs[conv] if t[0]]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit, lines = cheapest(turns)
        faults = [sum(t[2] == f for t in turns) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def reported(df):
    found = df.collect()
    got = {r.conv_id: tuple(r)[1:] for r in found}
    assert len(got) == len(found)
    return got


def talk(seed, n, conv):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t", None, "Long answer number one.", "x", ".!?", "é?", "again. \n"]
    return [(conv, rng.choice([None, k, k, k + rng.randint(0, 2)]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]), rng.choice(texts) if k % 3 else f"{rng.choice(texts)} {k}.") for k in range(n)]


def test_op12_equals_sql(spark):
    same_rows(entry.queries()["op12_conversation_repair"](spark, SMALL), in_duckdb(entry.oracle_sql()["op12_conversation_repair"]))


def test_damage_and_odd_rows_equal_sql(spark):
    rows = [r for k in range(25) for r in talk(k, k % 9, None if k == 24 else k)] + [(77, None, None, None), (78, None, "user", "a b.c!"), (79, 5, "user", "Alone.")]
    table = spark.createDataFrame(rows, SCHEMA)
    same_rows(repair_report(damaged(table), every=table), in_duckdb(SQL, {"conversations": table.toArrow()}))
    hits = {zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 for c, t, *_ in rows}
    assert {0, 1, 2, 3, 4} <= hits


@pytest.mark.parametrize("bits", [6, 12])
def test_equals_brute_force(spark, bits):
    rows = [r for k in range(40) for r in talk(100 + k, 1 + k % 13, None if k == 3 else k)] + talk(7, 300, 1000) + talk(8, 150, 1001)
    got = reported(repair_report(spark.createDataFrame(rows, SCHEMA).repartition(4), Repair(chunk_bits=bits), every=spark.createDataFrame([(5000,), (1,)], "conv_id long")))
    assert got == by_hand(rows, [5000])


def test_chunks_traced_apart_give_the_same_edits(spark):
    rows = spark.createDataFrame(talk(7, 300, 1) + talk(9, 5, 2), SCHEMA)
    for how in (Repair(Costs(block=3), chunk_bits=6),):
        edits = defaultdict(list)
        for r in sorted(repaired_turns(rows, how).collect(), key=lambda r: (r.place, r.step)):
            edits[r.conv_id].append(r)
        for conv, report in reported(repair_report(rows, how)).items():
            assert "".join(r.edit for r in edits[conv]) == report[6]
            assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in edits[conv] if r.edit != "D").encode()).hexdigest() == report[7]


def test_a_long_conversation_of_equal_turns(spark):
    turns = spark.range(20_000).selectExpr("1L AS conv_id", "id DIV 4 AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "if(id % 3 = 0, 'Same.', concat('Turn ', id DIV 2, '.')) AS text")
    got = reported(repair_report(turns))
    assert got == by_hand([tuple(r) for r in turns.collect()])


def test_empty_tables_and_further_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair_report(none).count() == 0 and repaired_turns(none).count() == 0
    got = reported(repair_report(none, every=spark.createDataFrame([(4,), (4,), (None,)], "conv_id long")))
    assert got == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (4, None)}
    odd = spark.createDataFrame([(1, 0, "user", "Hi.", 9, "p", b"s", 3)], SCHEMA + ", place long, kind string, symbols binary, at int")
    assert reported(repair_report(odd))[1][6] == "KI"

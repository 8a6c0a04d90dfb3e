import hashlib
import re
from collections import defaultdict

import pytest
from helpers import SMALL, in_duckdb, same_rows

import __spark_entry__ as entry
from ridgeline.llm.line_dedup import SQL, LineRule, drop_repeated_lines

SCHEMA = "doc_id long, text string"


def key_of(line):
    return re.sub("[A-Z]", lambda m: m.group().lower(), line.strip(" \t\n\x0b\x0c\r"))


def by_hand(rows, chars=10, documents=2):
    """(doc_id, n_lines, n_dropped, kept text) of each row."""
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None:
                holders[key_of(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(key_of(x)) < chars or len(holders[key_of(x)]) < documents or min(holders[key_of(x)]) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def rows_of(df):
    found = df.collect()
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in found)
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found), key=repr)


def test_op13_equals_sql(spark):
    same_rows(entry.queries()["op13_line_dedup"](spark, SMALL), in_duckdb(entry.oracle_sql()["op13_line_dedup"]))


def test_messy_rows_equal_sql(messy, arrow_docs):
    same_rows(drop_repeated_lines(messy.filter("doc_id IS NOT NULL"), keep_text=False).dropDuplicates(), in_duckdb(f"SELECT DISTINCT * FROM ({SQL})", {"documents": arrow_docs}))


@pytest.mark.parametrize("rule", [LineRule(), LineRule(chars=3, documents=3)])
def test_equals_brute_force(spark, rule):
    shared = "The shared line of many."
    rows = [
        (5, f"{shared}\nown line number five\n{shared}"), (3, f"  {shared.upper()}\t\nown line number three"), (9, f"{shared}\n\n\nshort\n"), (2, "short\nshort\nanother line twice\nanother line twice"),
        (7, None), (8, ""), (11, "\n"), (12, "éèàçùöüßñø é"), (13, "ÉÈÀÇÙÖÜSSÑØ É\néèàçùöüßñø é"), (14, " tenth sp "), (15, "tenth spac\x1c\ntenth spac"), (16, "tenth spac"),
        (3, "own line number three"), (3, f"x\n{shared}"), (None, shared), (20, f"{shared}\n" * 50), (20, f"{shared}\n" * 50), (1, None), (30, "nine char"), (31, "nine char"), (32, "nine char\r\nten  chars\r"), (33, "ten  chars"),
    ]
    got = rows_of(drop_repeated_lines(spark.createDataFrame(rows, SCHEMA).repartition(3), rule))
    assert got == by_hand(rows, rule.chars, rule.documents)


def test_a_text_of_megabytes_and_many_copies(spark):
    long = "\n".join(f"line number {k} of the long one" for k in range(60_000))
    rows = [(1, "line number 77 of the long one"), (2, long), (3, long), *((k, "one common line of all\nown " * 2 + str(k)) for k in range(10, 400))]
    assert rows_of(drop_repeated_lines(spark.createDataFrame(rows, SCHEMA).repartition(5))) == by_hand(rows)


def test_empty_tables_and_clashing_columns(spark, nothing):
    assert drop_repeated_lines(nothing).count() == 0
    odd = spark.createDataFrame([(1, "a common line", 1, "x", "y", 3), (2, "a common line", 1, "x", "y", 3)], "doc_id long, text string, id int, name string, `lost.a` string, place int")
    assert [r[3] for r in rows_of(drop_repeated_lines(odd))] == ["a common line", ""]

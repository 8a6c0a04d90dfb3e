import html
import random
import re

import numpy as np
import pytest
from helpers import SMALL, in_duckdb, same_rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ridgeline.operators import bloom, ngrams
from ridgeline.operators.containment import containment_join
from ridgeline.operators.ngrams import found_grams
from ridgeline.operators.page_blocks import BLOCKS, FLAT, blocks_of, page_blocks
from ridgeline.plans import text
from ridgeline.session import table

BLANK = " \t\n\x0b\x0c\r"


def grams(text, n):
    found = [w for w in re.split(f"[{BLANK}]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]
    return {tuple(found[k : k + n]) for k in range(len(found) - n + 1)}


def contained(docs, items, n):
    def united(rows):
        out = {}
        for own, t in rows:
            if own is not None:
                out.setdefault(own, set()).update(grams(t, n))
        return out

    found = ((d, i, len(gi), len(gd & gi)) for d, gd in united(docs).items() for i, gi in united(items).items() if gd & gi)
    return {(d, i): (total, hit, hit / total) for d, i, total, hit in found}


@pytest.mark.parametrize("name", list(text.SQL))
def test_query_equals_sql(spark, name):
    same_rows(entry.queries()[name](spark, SMALL), in_duckdb(entry.oracle_sql()[name]))


@pytest.mark.parametrize("filtered", [True, False])
def test_containment_equals_brute_force(spark, monkeypatch, filtered):
    if not filtered:
        monkeypatch.setattr(bloom, "MOST_BITS", 8)
    rng = random.Random(4)
    vocabulary = ["a", "b", "c", "D", "é", "x\x1cy"]
    docs = [(k, rng.choice(BLANK).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90)))) for k in range(60)]
    docs += [(3, None), (None, docs[0][1]), (4, docs[5][1]), (5, docs[5][1]), (70, " \n"), (71, "a b"), (72, "b c d é a " * 9000)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))) for k in range(40)] + [(1, None), (None, "a b c"), (50, ""), (51, docs[0][1]), (7, "a b c d")]
    left = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, h int, `own.a` string").repartition(3)
    right = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, gram int, words string")
    for n, least in ((3, 0.0), (4, 0.5)):
        wanted = {k: v for k, v in contained(docs, items, n).items() if v[2] >= least}
        found = containment_join(left, right, n, least).collect()
        assert {(r.doc_id, r.item_id): (r.n_ngrams, r.n_found, r.share) for r in found} == wanted and len(found) == len(wanted) > 5


def test_containment_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert containment_join(docs.limit(0), items, 2).count() == containment_join(docs, items.limit(0), 2).count() == 0
    assert [tuple(r) for r in containment_join(docs, items, 2).collect()] == [(1, 1, 2, 2, 1.0)]


def test_few_n_grams_pass_the_filter(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("h"))
    tried = np.array([r.h for r in spark.range(200_000).select(F.xxhash64("id").alias("h")).collect()]).view(np.uint64)
    passed = set(bloom.bloom_of(keys, "h", 1000).holds(tried).tolist())
    assert passed >= set(range(1000)) and len(passed) < 1400


def test_the_filter_is_met_before_any_shuffle(spark):
    docs = spark.createDataFrame([(k, f"a b c d {k} e") for k in range(200)], "id long, text string")
    keys = found_grams(docs.filter("id = 7"), 3, hashes=True)
    assert {tuple(r) for r in found_grams(docs, 3, bloom.bloom_of(keys, "h", 4)).distinct().collect()} == {(k, g) for k in range(200) for g in ("a b c", "b c d")} | {(7, "c d 7"), (7, "d 7 e")}
    assert "Exchange" not in found_grams(docs, 3, bloom.bloom_of(keys, "h", 4))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 2, 5])
def test_long_texts_are_read_in_overlapping_parts(spark, monkeypatch, n):
    rng = random.Random(n)
    texts = [rng.choice(BLANK).join("x" * rng.randint(0, 9) + rng.choice("aBc\xe9") for _ in range(400)) for _ in range(5)] + ["y" * 300 + " z " + "y" * 300, "  a a a a a  ", "\n" * 500]
    for part in (16, 64, 1000):
        monkeypatch.setattr(ngrams, "PART", part)
        got = {}
        for rows, data in ngrams._parts([t.encode() for t in texts], n):
            for row, piece in zip(rows, data):
                got.setdefault(row, set()).update(grams(piece.decode(), n))
        assert got == {k: grams(t, n) for k, t in enumerate(texts)}


def by_character(page):
    """(tag, text, n_chars, link_chars, n_links) of each block, a character at a time."""
    out, open_, state = [], [], {"text": "", "linked": 0, "links": 0, "in": False, "run": ""}

    def end_run():
        run = html.unescape(state["run"])
        state["run"] = ""
        state["text"] += run
        state["linked"] += state["in"] * sum(c not in BLANK for c in run)

    def flush():
        end_run()
        words = [w for w in re.split(f"[{BLANK}]", state["text"]) if w]
        if words:
            out.append((open_[-1] if open_ else "page", " ".join(words), sum(map(len, words)), state["linked"], state["links"]))
        state.update(text="", linked=0, links=0, **{"in": False})

    k = 0
    while k < len(page):
        if page.startswith("<!--", k):
            end_run()
            to = page.find("-->", k + 4)
            k = len(page) if to < 0 else to + 3
        elif page.startswith(("<!", "<?"), k):
            end_run()
            to = page.find(">", k)
            k = len(page) if to < 0 else to + 1
        elif page[k] == "<" and re.match("/?[A-Za-z]", page[k + 1 : k + 3]):
            end_run()
            k += 1
            closing = page[k] == "/"
            k += closing
            name = ""
            while k < len(page) and page[k] not in "/>" and page[k] not in BLANK:
                name += page[k]
                k += 1
            quote = ""
            while k < len(page) and (quote or page[k] != ">"):
                quote = ("" if page[k] == quote else quote) if quote else page[k] if page[k] in "\"'" else ""
                k += 1
            k += 1
            name = name.lower()
            if name == "a":
                state["in"] = not closing
                state["links"] += not closing
            elif name == "br":
                state["text"] += " "
            elif name in BLOCKS:
                flush()
                if closing and name in open_:
                    while open_.pop() != name:
                        pass
                elif not closing and name != "hr":
                    if name in FLAT and open_ and open_[-1] == name:
                        open_.pop()
                    open_.append(name)
            elif name in ("script", "style") and not closing:
                to = page.lower().find(f"</{name}", k)
                k = len(page) if to < 0 else to
        else:
            state["run"] += page[k]
            k += 1
    flush()
    return out


def seen(blocks):
    return [(b[0], b[1], *b[3:6]) for b in blocks]


def test_blocks_of_random_markup_equal_brute_force():
    rng = random.Random(9)
    parts = ["<p>", "</p>", "<DIV class='a>b'>", "</div>", "<a href=\"x>y\">", "</a>", "<b>", "</b>", "<br/>", "<hr>", "<!-- <p> -->", "<!--", "<!doctype html>", "<script>", "</script>", "<style>", "</STYLE >", "<li>", "<td>", "</td>", "<table>",
             "text ", "é&amp;", "&lt;p&gt;", "&nbsp", " < ", "<3", "\n", "\t", "x", "<a '", "<", ">", "-->", "&#x41;", "<p", "</", "\xa0", "<?x?>"]
    for _ in range(3000):
        page = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert seen(blocks_of(page)) == by_character(page), page


def test_given_pages_equal_brute_force(spark):
    pages = {r.page_id: r.html for r in table(spark, SMALL, "pages").collect()}
    found = {}
    for r in sorted(entry.queries()["page_blocks"](spark, SMALL).collect(), key=lambda r: (r.page_id, r.block)):
        found.setdefault(r.page_id, []).append((r.tag, r.text, r.n_chars, r.link_chars, r.n_links))
        assert r.n_words == len(r.text.split(" ")) and r.link_share == r.link_chars / r.n_chars and 0 < r.density <= 1 and r.place == r.begin / len(pages[r.page_id])
    assert found == {k: by_character(v) for k, v in pages.items() if by_character(v)}
    profile = entry.queries()["block_profile"](spark, SMALL).collect()
    assert sum(r.blocks for r in profile) == sum(map(len, found.values()))


def test_odd_pages(spark):
    rows = [(1, None, 0, "t"), (2, "", 0, "t"), (3, "<div></div>", 0, "t"), (None, "free", 0, "t"), (4, "<p>a<p>b", 0, "t"), (4, "c", 0, "t"), (5, "<li>" + "word " * 300_000, 0, "t")]
    found = sorted(((r.page_id or 0, r.block, r.tag, len(r.text)) for r in page_blocks(spark.createDataFrame(rows, "page_id long, html string, block int, tag string")).collect()))
    assert found == [(0, 0, "page", 4), (4, 0, "p", 1), (4, 0, "page", 1), (4, 1, "p", 1), (5, 0, "li", 1_499_999)]
    assert page_blocks(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_deep_and_broken_pages_take_linear_time():
    assert len(blocks_of("<div>" * 100_000 + "</p>" * 100_000 + "x" + "<a \"" * 100_001)) == 1

"""Texts of megabytes in the operators that compare texts with each other."""

import hashlib

import pytest

from ridgeline.llm import jaccard, quality, substring_index, suffix_dedup


def long_text(seed, words):
    return " ".join(hashlib.md5(f"{seed}-{k}".encode()).hexdigest()[: 3 + k % 9] + ("." if k % 11 == 0 else "") + ("\n" if k % 23 == 0 else "") for k in range(words))


@pytest.fixture(scope="module")
def docs(spark):
    first, second = long_text(1, 150_000), long_text(2, 150_000)
    assert len(first) > 1_000_000
    cut = second[:500_000] + " changed in the middle " + second[500_020:]
    rows = [(1, first), (2, first), (3, second), (4, cut), (5, "short text of its own"), (6, first[70_000:71_000])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).persist()


def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def test_op3_counts_whole_texts(docs):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols) for r in quality.clean_lines(docs, keep_text=False).collect()}
    assert got == {k: (len(t.split()), sum(map(len, t.split())), 0) for k, t in texts(docs).items()}


def test_op9_equals_brute_force(docs):
    seen, want = {}, {}
    for doc, text in sorted(texts(docs).items()):
        words = text.split()
        windows = [" ".join(words[k : k + 50]) for k in range(len(words) - 49)]
        gone = [False] * len(words)
        for k, w in enumerate(windows):
            if seen.get(w, doc) < doc:
                gone[k : k + 50] = [True] * 50
        for w in windows:
            seen.setdefault(w, doc)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        want[doc] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_index.remove_repeats(docs, keep_text=False).collect()} == want


def test_op10_links_long_texts(docs):
    def shingles(text):
        words = text.lower().split()
        return len({tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))})

    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect()}
    assert got == {k: (shingles(t), {2: 1, 4: 3}.get(k, k)) for k, t in texts(docs).items()}


def test_op1_removes_all_copies(docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeated_bytes(docs, keep_text=False).collect()}
    assert all(got[k][0] == got[k][1] for k in (1, 2, 6)) and got[5][1] == 0
    # Of the changed copy all is found again but the change.
    assert got[3][0] - 200 < got[3][1] < got[3][0] and got[4][0] - 200 < got[4][1] < got[4][0]

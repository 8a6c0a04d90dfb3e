import random
from collections import Counter

import numpy as np
import pytest
from helpers import SMALL, in_duckdb, same_rows
from pyspark.sql import functions as F

import corpus_pipeline
from ridgeline.llm import metric_search, registry, toxicity
from ridgeline.llm.toxicity import BANDS, Training, correlated, fit_label_model
from ridgeline.session import table


def vectors(seed=0):
    rng = random.Random(seed)
    hot = [rng.uniform(-1, 1) for _ in range(5)]
    rows = [(k, hot if k % 3 == 0 else [rng.uniform(-1, 1) for _ in range(5)], 1) for k in range(300)]
    rows += [(300, None, 1), (301, [1.0, None, 0.0, 0.0, 0.0], 1), (302, [float("nan")] * 5, 1), (303, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1), (None, hot, 1), (40, rows[40][1], 1), (304, [0.5, 0.5], 1), (305, [], 1)]
    return rows


@pytest.mark.parametrize("how", [metric_search.Tree(), metric_search.Tree(regions=4, page=20, node=5, block=4)])
def test_op6_equals_brute_force(spark, how):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, rank int").repartition(3)
    got = sorted(tuple(r) for r in metric_search.top_k(df, F.col("vec_id") % 20 == 0, how=how).collect())
    live = {}
    for k, v, _ in vectors():
        if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            live[k] = np.pad(np.floor(64 * np.array(v, np.float32).astype(float)), (0, 5 - len(v))).astype(int)
    want = []
    for q in live:
        if q % 20 == 0:
            scored = sorted((-int(live[q] @ live[c]), c) for c in live if c != q)[:20]
            want += [(q, rank, c, -s) for rank, (s, c) in enumerate(scored, 1)]
    assert got == sorted(want)


def test_op6_when_every_row_asks(spark):
    """The blocks of queries follow the queries that there are."""
    rng = random.Random(3)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(4)]) for k in range(200)]
    got = sorted(tuple(r) for r in metric_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.lit(True), 3, metric_search.Tree(regions=4, page=40, node=8, block=16)).collect())
    ints = {k: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for k, v in rows}
    want = [(q, rank, c, -s) for q in ints for rank, (s, c) in enumerate(sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q)[:3], 1)]
    assert got == sorted(want)


def test_op6_skips_other_clusters(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16)) * 4
    vectors = np.array([centres[k % 40] + rng.normal(size=16) * 0.3 for k in range(4000)])
    computed = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {}
    for r in metric_search.top_k(df, F.col("vec_id") % 20 == 0, counter=computed).collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    x = np.floor(64 * vectors)
    for k in range(0, 4000, 20):
        best = sorted((-int(s), j) for j, s in enumerate(x @ x[k]) if j != k)[:20]
        assert [t[1:] for t in sorted(got[k])] == best
    assert 0 < computed.value < 0.3 * 200 * 3999


def test_op6_with_few_and_no_candidates(spark):
    schema = "vec_id long, embedding array<float>"
    asked = F.col("vec_id") % 20 == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [0.5]), (20, [1.0])], schema)
    assert sorted(tuple(r) for r in metric_search.top_k(few, asked).collect()) == [(0, 1, 20, 4096), (0, 2, 1, 2048), (20, 1, 0, 4096), (20, 2, 1, 2048)]
    assert metric_search.top_k(few.filter("vec_id = 0"), asked).collect() == []
    assert metric_search.top_k(few.limit(0), asked).collect() == []
    zeros = spark.createDataFrame([(k, [0.0, 0.0]) for k in range(30)], schema)
    assert [r.vec_id for r in metric_search.top_k(zeros, F.col("vec_id") == 20).orderBy("rank").collect()] == list(range(20))


def simulated(n=4000):
    """True classes and votes: ten independent voters, a copy of the first, and
    one that says nothing."""
    rng = np.random.default_rng(1)
    truth = rng.random(n) < 0.2
    votes = np.zeros((n, 12), bool)
    for v in range(10):
        votes[:, v] = rng.random(n) < np.where(truth, 0.35, 0.02)
    votes[:, 10] = votes[:, 0]
    votes[:, 11] = rng.random(n) < 0.1
    return truth, votes


def by_hand(states, labels, rounds):
    """Expectation maximisation on a row a document: rate, log-odds, posterior."""
    n, width = states.shape
    toxic = np.where(np.isnan(labels), np.minimum(states.sum(axis=1), 2) / 2, labels)
    for _ in range(rounds):
        tables = np.array([[[(w * (states[:, f] == k)).sum() + (2.0 if k == 0 else 0.5) for k in range(len(BANDS) + 1)] for f in range(width)] for w in (1 - toxic, toxic)])
        rate = (toxic.sum() + 1) / (n + 10)
        tables /= tables.sum(axis=2, keepdims=True)
        odds = np.maximum.accumulate(np.log(tables[1]) - np.log(tables[0]), axis=1)
        score = np.log(rate / (1 - rate)) + sum(odds[f, states[:, f]] for f in range(width))
        posterior = 1 / (1 + np.exp(-score))
        toxic = np.where(np.isnan(labels), posterior, labels)
    return rate, odds, posterior


def test_label_model_equals_plain_expectation_maximisation(spark):
    truth, votes = simulated()
    rows, items = np.nonzero(votes)
    factors = correlated(rows, items, truth, 12, 0.7)
    assert factors[0] == factors[10] and len(set(factors)) == 11
    labels = np.where(np.arange(len(truth)) % 10 == 0, truth, np.nan)
    single = np.flatnonzero(~np.isin(np.arange(12), [0, 10]))
    states = np.zeros((len(truth), 11), int)
    for v in single:
        states[:, factors[v]] = votes[:, v]
    states[:, factors[0]] = np.digitize(votes[:, [0, 10]].sum(axis=1), BANDS)
    # The first round counts votes, the plain version above takes states for them.
    states_first = votes.sum(axis=1)
    table = spark.createDataFrame([(np.flatnonzero(v).tolist(), None if np.isnan(m) else float(m)) for v, m in zip(votes, labels)], "hits array<int>, toxic double")
    table = table.repartition(3).groupBy("hits", "toxic").agg(F.count(F.lit(1)).alias("n"))
    model = fit_label_model(table, factors, Training(em_rounds=30))
    assert (np.minimum(states.sum(axis=1), 2) == np.minimum(states_first, 2)).all()
    rate, odds, posterior = by_hand(states, labels, 30)
    assert abs(model.rate - rate) < 1e-9 and np.allclose(model.odds, odds, atol=1e-6)
    got = model.posterior(model.states(rows, items, len(truth)))
    assert np.allclose(got, posterior, atol=1e-6) and ((got > 0.5) == truth).mean() > 0.95
    # Accuracies: the odds that a vote of each independent voter was made with.
    for v in range(1, 10):
        assert abs(odds[factors[v], 1] - np.log(0.35 / 0.02)) < 0.8
    assert odds[factors[11], 1] < 0.5


def test_correlations_of_either_class_count():
    toxic = np.arange(400) < 200
    votes = np.zeros((400, 3), bool)
    votes[:, 0] = np.arange(400) % 3 == 0
    votes[toxic, 1] = np.random.default_rng(0).random(200) < 0.3
    votes[~toxic, 1] = votes[~toxic, 0]  # a copy among the clean rows alone
    votes[:, 2] = np.random.default_rng(1).random(400) < 0.3
    factors = correlated(*np.nonzero(votes), toxic, 3, 0.7)
    assert factors[0] == factors[1] != factors[2]


def test_posteriors_are_not_the_labels(spark):
    """A label moves no posterior of its own row: rows of equal votes have equal ones."""
    docs, labels = toy(spark)
    rows, sample = toxicity.learnable_rows(docs, labels.withColumn("toxic", F.when(F.col("doc_id") % 25 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))), Training())
    assert sample.filter("toxic = 1").count() > 100
    features, weights = toxicity.train(docs, labels.withColumn("toxic", F.when(F.col("doc_id") % 25 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    score = toxicity.scorer(spark, features, weights)
    wrong = docs.filter("doc_id % 25 = 0 AND doc_id < 1500").dropDuplicates(["doc_id"]).withColumn("p", score("text")).collect()
    assert sum(r.p >= 0.5 for r in wrong) > 0.9 * len(wrong)


def toy(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for k in range(1500):
        words = ["".join(rng.choice(["ka", "lo", "mi", "re", "tu"]) for _ in range(3)) for _ in range(rng.randint(5, 60))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(["zorgab", "vixnu"]) + rng.choice(["ka", "lo", "x"]))
        docs.append((k, " ".join(words), 0.1, "x"))
        labels.append((k, int(toxic)))
    docs += [(2000, None, 0.1, "x"), (2001, "", 0.1, "x"), (None, "zorgabka", 0.1, "x"), (0, docs[0][1], 0.1, "x"), (2002, "what an idiot and a moron, stupid trash", 0.1, "x")]
    labels += [(None, 1), (7, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, score double, hits string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_op5_held_out_accuracy_and_odd_rows(spark):
    docs, labels = toy(spark)
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98
    odd = {r.doc_id: r.predicted for r in got if r.doc_id in (2000, 2001, 2002)}
    assert odd[2000] == odd[2001] == 0
    assert [r.held_out for r in got if r.doc_id is None] == [None]


def test_op5_never_sees_held_out_labels(spark):
    docs, labels = toy(spark)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda marks: Counter((r.doc_id, round(r.score, 9)) for r in toxicity.toxicity(docs, marks).collect())
    assert score(labels) == score(flipped)


def test_op5_without_labels_or_rows(spark):
    docs, labels = toy(spark)
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_operator_query_equals_sql(spark, name):
    same_rows(registry.queries()[name](spark, SMALL), in_duckdb(registry.oracle_sql()[name]))


def test_pipeline_stages(spark, messy):
    """Each stage on odd rows keeps the columns and does its own work."""
    docs = messy
    columns = docs.columns
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.storage.materialize(stage(spark, docs, SMALL), name)
        assert docs.columns == columns
        if name == "toxicity":
            assert docs.count() == rows
        if name == "near_duplicates":
            ids = [r.doc_id for r in docs.collect() if r.doc_id is not None]
            assert len(ids) == len(set(ids)) and not {5, 7, 8, 9, 10, 16} & set(ids) and {1, 2, 3, 4, 6, 15} <= set(ids)
        if name == "secret_scans":
            text = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
            assert "hunter2" not in text[21][0] and "[SECRET]" in text[21][0] and text[21][1] == len(text[21][0]) and text[1][0] is None
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_equals_its_parts(spark):
    """run() against the brute-force rule of each stage that has one."""
    docs = table(spark, SMALL, "documents")
    clean = docs.join(toxicity.toxicity(docs, table(spark, SMALL, "labels")).filter("predicted = 0").select("doc_id"), "doc_id", "left_semi")
    from test_against_brute_force import component_of

    kept = {d for d, _, c in component_of([(r.doc_id, r.text) for r in clean.collect()], 5, 80) if d == c}
    second = corpus_pipeline.storage.materialize(corpus_pipeline.keep_one_of_near_duplicates(spark, clean.select(docs.columns), SMALL), "second")
    assert {r.doc_id for r in second.collect()} == kept
    final = {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert final and final <= kept


def test_pipeline_drops_copies_of_80_percent(spark):
    """Extended, cut and edited copies between the stage's rule and op10's."""
    from test_against_brute_force import component_of

    docs = []
    for k, change in enumerate([lambda w: w + w[::-1][:13], lambda w: w[:-11], lambda w: w[:30] + ["edit"] + w[31:], lambda w: w + w[::-1][:20]]):
        words = [f"w{k}x{j}" for j in range(60)]
        docs += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(change(words)))]
    kept = {d for d, _, c in component_of(docs, 5, 80) if d == c}
    assert kept == {0, 10, 20, 30, 31} and kept < {d for d, _, c in component_of(docs) if d == c}
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(docs, "doc_id long, text string"), SMALL)
    assert {r.doc_id for r in got.collect()} == kept


def test_odd_column_names_pass_the_stages(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars", "a.b", "c`d", "row", "spans", "label"]
    texts = ["some words of a text number one", "some words of a text number one", "another text, password = hunter2hunter2x", None]
    docs = spark.createDataFrame([(k % 3, t, "en", "s", len(t or ""), "x", "y", 1, 2, 3) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `c``d` string, row int, spans int, label int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.storage.materialize(stage(spark, docs, SMALL), name)
        assert docs.columns == names
    assert docs.count() and corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count()


def test_repeated_ids_train_on_one_text(spark):
    rows = [(1, f"text {k}") for k in range(9)] + [(2, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    chosen = [{(r.doc_id, r.text) for r in toxicity.learnable_rows(docs.repartition(n), labels, toxicity.Training())[1].collect()} for n in (1, 7)]
    assert chosen[0] == chosen[1] and len(chosen[0]) == len({r[0] for r in rows if __import__("zlib").crc32(str(r[0]).encode()) % 5})


def test_pipeline_on_empty_documents(spark, nothing):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.collect() == []

"""Toxicity scores by weak supervision.

1. Voters: a fixed lexicon, and word patterns (whole words and word beginnings)
   that labelled training rows show in toxic texts.  A voter fires or abstains.
2. Label model: a generative model of the votes of all documents that may be
   learnt from.  Voters that nearly always fire together within a class are
   correlated and share one factor, whose states are bands of its number of
   votes; expectation maximisation, each round one aggregate over the distinct
   votes, estimates the class rate and each factor's rates, and so the voters'
   accuracies.  Known labels stand for the class of their rows while rates are
   estimated, and nowhere else.  No voter is worse than chance: more votes never
   lower the odds.
3. Classifier: logistic regression on word patterns, trained on the label
   model's posterior, which the votes alone decide, then applied to every text.

Patterns are hashed to ``2**BITS`` buckets, so tables and broadcasts have a
fixed size.  Only the text is an input of a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import storage
from ..session import ship_package
from .batches import map_batches

BITS = 20
#: Bytes of a word's beginning that are patterns, besides the whole word.
PREFIXES = (4, 5, 6)

#: Words that count as insults in any data (en, de, fr, es).
LEXICON = (
    "idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting", "clown",
    "dumbass", "imbecile", "filth", "vermin", "lowlife", "crap", "bastard", "asshole", "bitch", "bullshit",
    "arschloch", "dummkopf", "trottel", "abschaum", "drecksau", "wichser", "hurensohn", "schlampe", "missgeburt", "vollidiot",
    "connard", "salaud", "salope", "abruti", "crétin", "ordure", "enfoiré", "débile", "raclure", "minable",
    "gilipollas", "cabrón", "imbécil", "estúpido", "escoria", "basura", "mierda", "bastardo", "asqueroso", "inútil",
)

#: Votes at which a factor's next state begins.
BANDS = np.array([1, 2, 4, 8])

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[0x80:] = True


#: Tasks that the distinct votes are dealt over in a round, each giving one row of sums.
EM_TASKS = 64


@dataclass(frozen=True)
class Training:
    """Bounds of what is fitted on.

    ``rows``: documents that voters are found in and the classifier is fitted
    on, labelled ones first, then those of least hash of their id; labels of
    others are not used.  ``voters`` and ``features``: patterns kept.
    ``least``: documents a pattern must be in.  ``least_g``: least likelihood
    ratio of a pattern.  ``linked``: correlation within a class from which
    voters share a factor.
    """

    rows: int = 40_000
    voters: int = 256
    features: int = 512
    least: int = 6
    linked: float = 0.7
    least_g: float = 24.0
    em_rounds: int = 12
    steps: int = 100
    l2: float = 1e-4


def patterns(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text index, bucket) of every pattern of every word."""
    raw, at = K.text_bytes(column)
    raw = K.LOWER[raw]
    solid = _LETTER[raw]
    cut = np.zeros(len(raw) + 1, dtype=bool)
    cut[at] = True
    before = np.concatenate([[False], solid[:-1]])
    after = np.concatenate([solid[1:], [False]])
    begins = np.flatnonzero(solid & (~before | cut[:-1]))
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    text = np.searchsorted(at, begins, side="right") - 1
    texts, buckets = [text], [K.scramble(K.word_hashes(raw, begins, ends) + K.U64(1))]
    for size in PREFIXES:
        long = ends - begins >= size
        texts.append(text[long])
        buckets.append(K.scramble(K.word_hashes(raw, begins[long], begins[long] + size) + K.U64(size)))
    return np.concatenate(texts), (np.concatenate(buckets) >> K.U64(64 - BITS)).astype(np.int64)


def word_bucket(word: str) -> int:
    return int(patterns(pa.array([word]))[1][0])


def _present(text: np.ndarray, item: np.ndarray, items: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, item) pairs in order."""
    both = np.unique(text * items + item)
    return both // items, both % items


def bucket_rates(rows: DataFrame, weigh: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(bucket, toxic, clean): summed weights of the texts each bucket is in.
    ``weigh``: a part and the (text, bucket) pairs in it to a weight per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for whole in batches:
            for part in K.slices(whole, "text"):
                text, bucket = _present(*patterns(part.column("text")), 1 << BITS)
                w = weigh(part, text, bucket)[text]
                toxic += np.bincount(bucket, weights=w, minlength=1 << BITS)
                clean += np.bincount(bucket, weights=1 - w, minlength=1 << BITS)
        some = np.flatnonzero(toxic + clean)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(toxic[some]), pa.array(clean[some])], names=["bucket", "toxic", "clean"])

    return map_batches(rows, run, "bucket long, toxic double, clean double").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _strongest(rates: DataFrame, toxic: float, clean: float, most: int, how: Training, both_sides: bool) -> list[int]:
    """Buckets that depend most on the class, by the likelihood ratio of
    independence (G): ``most`` rows at most."""
    a, b, both = F.col("toxic"), F.col("clean"), toxic + clean

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / F.greatest(expected, F.lit(1e-9)))).otherwise(0.0)

    share, rest = (a + b) / both, 1 - (a + b) / both
    g = 2 * (part(a, share * toxic) + part(b, share * clean) + part(toxic - a, rest * toxic) + part(clean - b, rest * clean))
    kept = rates.filter(a + b >= how.least).select("bucket", F.round(g, 6).alias("g"), (a > share * toxic).alias("up")).filter(F.col("g") >= how.least_g)
    kept = kept if both_sides else kept.filter("up")
    return [r["bucket"] for r in kept.orderBy(F.desc("g"), "bucket").limit(most).collect()]


def _index(buckets: list[int]) -> np.ndarray:
    table = np.full(1 << BITS, -1, dtype=np.int16)
    table[buckets] = np.arange(len(buckets))
    return table


def presence(rows: DataFrame, buckets: list[int], keep: list[str]) -> DataFrame:
    """``keep`` and hits: the places in ``buckets`` of the patterns in a text."""
    shared = rows.sparkSession.sparkContext.broadcast(_index(buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for whole in batches:
            for part in K.slices(whole, "text"):
                text, bucket = patterns(part.column("text"))
                item = table[bucket].astype(np.int64)
                text, item = _present(text[item >= 0], item[item >= 0], 1 << 15)
                ends = np.searchsorted(text, np.arange(part.num_rows + 1))
                hits = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(item.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], hits], names=[*keep, "hits"])

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keep)
    return map_batches(rows.select(*keep, "text"), run, f"{kinds}, hits array<int>")


def _pairs(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) of a column of lists, without a Python object for each."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy()


def correlated(rows: np.ndarray, items: np.ndarray, toxic: np.ndarray, width: int, linked: float) -> np.ndarray:
    """The factor of each of ``width`` voters: those that are correlated, from
    ``linked`` on, among the toxic or among the clean rows share one.  ``rows``
    and ``items`` are the votes."""
    close = np.eye(width, dtype=bool)
    for side in (toxic, ~toxic):
        own = side[rows]
        n, fired = max(1, int(side.sum())), np.bincount(items[own], minlength=width).astype(float)
        together = np.zeros((width, width))
        held, voter = rows[own], items[own]
        order = np.argsort(held, kind="stable")
        for votes in np.split(voter[order], np.flatnonzero(np.diff(held[order])) + 1):
            together[np.ix_(votes, votes)] += 1
        spread = np.sqrt(np.maximum(fired - fired**2 / n, 0))
        close |= together - np.outer(fired, fired) / n >= linked * np.maximum(np.outer(spread, spread), 1e-9)
    group = np.arange(width)
    for _ in range(width):
        least = np.minimum(group, np.where(close, group[None, :], width).min(axis=1))
        if (least == group).all():
            break
        group = least
    return np.unique(group, return_inverse=True)[1]


@dataclass(frozen=True)
class LabelModel:
    """Generative model of votes: each voter's factor, the class rate, and the
    log-odds of each state of each factor."""

    factors: np.ndarray
    rate: float
    odds: np.ndarray

    def states(self, rows: np.ndarray, items: np.ndarray, n: int) -> np.ndarray:
        width = self.factors.max(initial=-1) + 1
        votes = np.bincount(rows * width + self.factors[items], minlength=n * width).reshape(n, width) if width else np.zeros((n, 0), np.int64)
        return np.digitize(votes, BANDS)

    def posterior(self, states: np.ndarray) -> np.ndarray:
        """Chance of the toxic class by the votes."""
        votes = self.odds[np.arange(states.shape[1]), states].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(np.log(self.rate / (1 - self.rate)) + votes, -30, 30)))


def fit_label_model(votes: DataFrame, factors: np.ndarray, how: Training) -> LabelModel:
    """Expectation maximisation over ``votes`` (hits, toxic, n): n documents
    with these votes and this label, null where none is known.  The first round
    takes two votes for a toxic text."""
    width = int(factors.max(initial=-1)) + 1
    votes = votes.coalesce(EM_TASKS)
    model = LabelModel(factors, 0.5, np.zeros((width, len(BANDS) + 1)))

    def sums(model: LabelModel, first: bool) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, width, len(BANDS) + 1))
            mass = np.zeros(2)
            for part in batches:
                rows, items = _pairs(part.column("hits"))
                states = model.states(rows, items, part.num_rows)
                toxic = np.minimum(np.bincount(rows, minlength=part.num_rows), 2) / 2 if first else model.posterior(states)
                truth = part.column("toxic").to_numpy(zero_copy_only=False).astype(float)
                toxic = np.where(np.isnan(truth), toxic, truth)
                n = part.column("n").to_numpy()
                for y, w in enumerate((n * (1 - toxic), n * toxic)):
                    mass[y] += w.sum()
                    for k in range(len(BANDS) + 1):
                        total[y, :, k] += ((states == k) * w[:, None]).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([mass, total.ravel()])], pa.list_(pa.float64()))], names=["sums"])

        # One row for each of at most EM_TASKS tasks.
        found = map_batches(votes, run, "sums array<double>").collect()
        return np.sum([r["sums"] for r in found], axis=0) if found else np.zeros(2 + 2 * width * (len(BANDS) + 1))

    for k in range(how.em_rounds):
        found = sums(model, k == 0)
        clean, toxic = found[:2]
        tables = found[2:].reshape(2, width, len(BANDS) + 1) + np.where(np.arange(len(BANDS) + 1) == 0, 2.0, 0.5)
        tables /= tables.sum(axis=2, keepdims=True)
        odds = np.maximum.accumulate(np.log(tables[1]) - np.log(tables[0]), axis=1)
        model = LabelModel(factors, (toxic + 1) / (clean + toxic + 10), odds)
    return model


def fit_linear(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int, how: Training) -> np.ndarray:
    """Logistic regression by accelerated gradient steps, on the pairs of a row
    and a feature in it; the last weight is the constant.

    Features are scaled by the root of their frequency, so that rare ones move
    as fast as common ones; the step is set by the largest curvature.
    """
    n = max(1, len(y))
    scale = np.append(1 / np.sqrt(np.maximum(np.bincount(cols, minlength=width) / n, 1 / n)), 1.0)

    def forward(w: np.ndarray) -> np.ndarray:
        own = w * scale
        return np.bincount(rows, weights=own[cols], minlength=len(y)) + own[-1]

    def backward(r: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(cols, weights=r[rows], minlength=width), r.sum()) * scale / n

    top = np.ones(width + 1)
    for _ in range(12):
        top = backward(forward(top))
        top /= np.linalg.norm(top) or 1.0
    curvature = 0.25 * np.linalg.norm(backward(forward(top))) * 1.1 + how.l2
    weights = np.zeros(width + 1)
    look, pace = weights.copy(), 1.0
    for _ in range(how.steps):
        miss = 1 / (1 + np.exp(-np.clip(forward(look), -30, 30))) - y
        slope = backward(miss) + how.l2 * np.append(look[:-1], 0.0)
        ahead = look - slope / curvature
        if slope @ (ahead - weights) > 0:  # overshot: start the acceleration anew
            pace = 1.0
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        look = ahead + (pace - 1) / faster * (ahead - weights)
        weights, pace = ahead, faster
    return weights * scale


def learnable_rows(docs: DataFrame, labels: DataFrame, how: Training) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, toxic) of all documents outside the fold that is held out,
    and of the sample of at most ``how.rows`` of them; toxic is null where no
    label is known or the row is outside the sample.  Of rows that share an id
    the sample has the one of least hash of its text."""
    free = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    marks = labels.filter(free & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("double").alias("toxic"))
    rows = docs.filter(free).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id").distinct().join(marks, "doc_id", "left")
    chosen = ids.orderBy(F.col("toxic").isNull(), F.xxhash64("doc_id"), "doc_id").limit(how.rows)
    chosen = F.broadcast(storage.materialize(chosen, "training-ids"))
    # Of rows that share an id, the text of least hash.
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "toxic")).alias("first")
    sample = storage.materialize(rows.join(chosen, "doc_id").groupBy("doc_id").agg(first).select("doc_id", "first.text", "first.toxic"), "training")
    return rows.join(chosen, "doc_id", "left"), sample


def train(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> tuple[list[int], np.ndarray]:
    """Buckets and weights of the linear classifier."""
    spark = docs.sparkSession
    rows, sample = learnable_rows(docs, labels, how)
    known = sample.filter("toxic IS NOT NULL")
    total = known.agg(F.sum("toxic").alias("t"), F.count("toxic").alias("n")).first()
    toxic = total["t"] or 0.0
    marked = bucket_rates(known.select("text", "toxic"), lambda part, text, bucket: part.column("toxic").to_numpy())
    learnt = _strongest(marked, toxic, total["n"] - toxic, how.voters, how, False) if toxic else []
    voters = list(dict.fromkeys([*map(word_bucket, LEXICON), *learnt]))

    # The votes and labels of the sample, at most how.rows rows, for the correlations.
    cast = presence(sample, voters, ["doc_id", "toxic"]).toArrow().sort_by("doc_id")
    at, items = _pairs(cast["hits"])
    truth = cast["toxic"].to_numpy().astype(float)  # nan: no label
    seems = np.where(np.isnan(truth), np.bincount(at, minlength=len(truth)) >= 2, truth > 0.5).astype(bool)
    factors = correlated(at, items, seems, len(voters), how.linked)
    votes = presence(rows, voters, ["toxic"]).groupBy("hits", "toxic").agg(F.count(F.lit(1)).alias("n"))
    votes = storage.materialize(votes, "votes")
    model = fit_label_model(votes, factors, how)
    posterior = model.posterior(model.states(at, items, len(truth)))
    del cast, at, items

    shared = spark.sparkContext.broadcast((_index(voters), model))

    def by_votes(part: pa.RecordBatch, text: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        table, own = shared.value
        item = table[bucket].astype(np.int64)
        return own.posterior(own.states(text[item >= 0], item[item >= 0], part.num_rows))

    rates = storage.materialize(bucket_rates(rows.select("text"), by_votes), "pattern-rates")
    n = votes.agg(F.sum("n")).first()[0] or 0
    mass = float(model.rate * n)
    features = list(dict.fromkeys([*voters, *_strongest(rates, mass, n - mass, how.features, how, True)]))
    seen = presence(sample, features, ["doc_id"]).toArrow().sort_by("doc_id")
    return features, fit_linear(*_pairs(seen["hits"]), posterior, len(features), how)


def scorer(spark: SparkSession, features: list[int], weights: np.ndarray) -> Callable[[Column], Column]:
    """A column function from texts to scores.  Only the texts go to Python."""
    shared = spark.sparkContext.broadcast((_index(features), np.asarray(weights)))

    def run(texts: pa.Array) -> pa.Array:
        table, w = shared.value
        scores = [np.zeros(0)]
        for part in K.slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text"):
            text, bucket = patterns(part.column("text"))
            item = table[bucket].astype(np.int64)
            text, item = _present(text[item >= 0], item[item >= 0], 1 << 15)
            total = np.bincount(text, weights=w[item], minlength=part.num_rows) + w[-1]
            scores.append(1 / (1 + np.exp(-np.clip(total, -30, 30))))
        return pa.array(np.concatenate(scores))

    ship_package(spark)
    return F.arrow_udf(run, "double")


def toxicity(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``.

    ``labels`` (doc_id, toxic) are learnt from only where crc32 of the id as
    text leaves a remainder other than 0 by 5.  Null and empty texts get the
    score of a text without patterns; texts of any length are read whole.  Rows
    with a null id are scored, not learnt from; their held_out is null.
    Repeated rows each return a row; an empty table none.  A tie of labels for
    one id is toxic, of patterns goes to the lower bucket, and a score of 0.5 is
    predicted toxic.  Without toxic labels the lexicon votes alone.  Other
    columns are ignored.
    """
    score = scorer(docs.sparkSession, *train(docs, labels, how))
    scored = docs.select("doc_id", score(F.coalesce("text", F.lit(""))).alias("score"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

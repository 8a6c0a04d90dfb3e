"""Mixing sources to target weights by iterative proportional fitting.

Only DataFrame functions are used.  Documents are summed to cells (source,
language, topic).  A cell's calibrated weight is its token share times one
factor for each of its three values; a round of raking fits the factors of
sources, then languages, then topics to their target marginals.  Sources may be
any number: their factors stay in Spark, and one aggregate a round gives the
sums by language and topic, of which there are few, that the other two factors
follow from.  The weights and a token budget give each cell a sampling
probability, and each document is taken or not by a hash of its id.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage

CELL = ["source", "lang", "topic"]
#: Cell tables up to this many rows are broadcast; longer ones join by a shuffle.
BROADCAST_CELLS = 50_000
#: Pairs of language and topic; more are an error.
MOST_PAIRS = 50_000
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``budget``: share of all tokens to take.  ``power``: where a marginal has
    no given targets, its values' shares are their token shares to this power,
    made to sum to 1; below 1 it lifts small sources.  ``targets``: {column:
    {value: share}}; values that are not named get 0.  ``rounds``: of raking, at
    most; it ends before when no factor moves by more than 1e-13 of itself.  A
    marginal that is then off by more than ``tolerance`` is warned of: its
    targets contradict others or the cells that there are."""

    budget: float = 0.8
    power: float = 0.7
    rounds: int = 20
    tolerance: float = 1e-3
    targets: dict = field(default_factory=dict)


def surface_topic(text: Column) -> Column:
    """A topic by the text's form: table, marked, loud, note, article or book."""
    words = F.greatest(F.regexp_count(text, F.lit(WORD)), F.lit(1))
    return (
        F.when(2 * F.regexp_count(text, F.lit(r"\|")) >= words, "table").when(2 * F.regexp_count(text, F.lit(r"[#*$%&<>]")) >= words, "marked")
        .when(2 * F.regexp_count(text, F.lit("!")) >= words, "loud").when(words < 100, "note").when(words < 1000, "article").otherwise("book")
    )


def _literal(cells: DataFrame, rows: list[dict], schema: str) -> DataFrame:
    """A small table of given rows, as one literal of the plan."""
    kind = "array<struct<" + ", ".join(f"{k}: {t}" for k, t in (f.split() for f in schema.split(", "))) + ">>"
    return cells.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def _targets(cells: DataFrame, dim: str, mix: Mix) -> DataFrame:
    """(value, share) of a dimension's values."""
    given = mix.targets.get(dim)
    if given is not None:
        return _literal(cells, [{"value": str(k), "share": float(v)} for k, v in given.items()], "value string, share double")
    sums = cells.groupBy(F.col(dim).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(mix.power)).alias("p"))
    return sums.join(F.broadcast(sums.agg(F.greatest(F.sum("p"), F.lit(1e-300)).alias("s")))).select("value", (F.col("p") / F.col("s")).alias("share"))


def _moved(factors: dict[str, float], sums: dict[str, float], targets: dict[str, float]) -> dict[str, float]:
    return {k: f * targets.get(k, 0.0) / sums[k] if sums[k] > 0 else 0.0 for k, f in factors.items()}


def _with_factors(cells: DataFrame, lang: dict[str, float], topic: dict[str, float], name: str) -> DataFrame:
    """``cells`` with the product of its language's and topic's factors."""
    for dim, factors in (("lang", lang), ("topic", topic)):
        table = _literal(cells, [{"of": k, "factor": x} for k, x in factors.items()], "of string, factor double")
        cells = cells.join(F.broadcast(table.select("of", F.col("factor").alias(f"{name}_{dim}"))), F.col(dim) == F.col("of")).drop("of")
    return cells.withColumn(name, F.col(f"{name}_lang") * F.col(f"{name}_topic")).drop(f"{name}_lang", f"{name}_topic")


def _source_factor(name: str) -> Column:
    """A source's factor under the others' product ``name``.  A source has as
    many cells as there are pairs of language and topic, at most."""
    held = F.sum(F.col("own") * F.col(name)).over(Window.partitionBy("source"))
    return F.when(held > 0, F.col("goal") / held).otherwise(0.0)


def raked(cells: DataFrame, mix: Mix) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``all``, all tokens, and
    ``weight``: shares that sum to about 1 and follow the marginals."""
    everything = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = _targets(cells, "source", mix).select(F.col("value").alias("s"), F.col("share").alias("goal"))
    cells = cells.join(goals, F.col("source") == F.col("s"), "left").drop("s").fillna(0.0, ["goal"])
    cells = storage.materialize(cells.withColumn("own", F.col("tokens") / F.lit(float(max(everything, 1)))), "goals")
    pairs = cells.select("lang", "topic").distinct().limit(MOST_PAIRS + 1).collect()
    if len(pairs) > MOST_PAIRS:
        raise ValueError(f"over {MOST_PAIRS} pairs of language and topic")
    lang, topic = ({r[c]: 1.0 for r in pairs} for c in ("lang", "topic"))
    want_lang, want_topic = ({r["value"]: r["share"] for r in _targets(cells, c, mix).collect()} for c in ("lang", "topic"))
    before = lang, topic
    for _ in range(mix.rounds if pairs else 0):
        # One row for each pair of language and topic.
        held = _with_factors(cells, lang, topic, "rest").withColumn("w", F.col("own") * _source_factor("rest")).groupBy("lang", "topic").agg(F.sum("w").alias("w")).collect()
        before = lang, topic
        lang = _moved(lang, {a: sum(r["w"] * lang[a] * topic[r["topic"]] for r in held if r["lang"] == a) for a in lang}, want_lang)
        topic = _moved(topic, {b: sum(r["w"] * lang[r["lang"]] * topic[b] for r in held if r["topic"] == b) for b in topic}, want_topic)
        if all(abs(new[k] - old[k]) <= 1e-13 * abs(new[k]) for new, old in zip((lang, topic), before) for k in new):
            break
    if not pairs:
        return cells.select(*CELL, "tokens", F.lit(0).cast("long").alias("all"), F.lit(0.0).alias("weight"))
    out = _with_factors(_with_factors(cells, *before, "rest"), lang, topic, "last")
    out = out.withColumn("weight", F.col("own") * _source_factor("rest") * F.col("last"))
    out = storage.materialize(out.select(*CELL, "tokens", F.lit(int(everything)).alias("all"), "weight", "goal"), "raked")
    for dim in CELL:
        sums = out.groupBy(dim).agg(F.sum("weight").alias("w"), F.first("goal").alias("goal"))
        sums = sums if dim == "source" else sums.drop("goal").join(_targets(cells, dim, mix).select(F.col("value").alias(dim), F.col("share").alias("goal")), dim, "left")
        gap = sums.agg(F.max(F.abs(F.col("w") - F.coalesce("goal", F.lit(0.0))))).first()[0]
        if everything and gap > mix.tolerance:
            warnings.warn(f"raking misses the target shares of {dim} by up to {gap:.3g}", stacklevel=2)
    return out.drop("goal")


def probabilities(cells: DataFrame, mix: Mix) -> DataFrame:
    """``cells`` with ``probability``, at most 1: in proportion to weight over
    tokens, with the factor at which the expected tokens meet the budget.

    Cells that the factor would take more than once are taken whole; the others
    share what is left of the budget, which raises the factor, until no more
    cells are taken whole.
    """
    able = cells.filter("weight > 0")
    budget, factor, taken = mix.budget * ((able.agg(F.max("all")).first()[0]) or 0), 0.0, -1
    while True:
        whole = F.col("tokens") < F.lit(factor) * F.col("weight") if taken >= 0 else F.lit(False)
        row = able.agg(F.count_if(whole).alias("n"), F.sum(F.when(whole, F.col("tokens")).otherwise(0)).alias("t"), F.sum(F.when(whole, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if row["n"] == taken or not row["w"]:
            factor = factor if row["n"] == taken else float("inf")
            break
        taken, factor = row["n"], (budget - row["t"]) / row["w"]
    share = F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.lit(factor) * F.col("weight") / F.greatest("tokens", F.lit(1)))).otherwise(0.0)
    return cells.select(*CELL, "tokens", "weight", share.alias("probability"))


def unit_hash(column: Column) -> Column:
    """A number in [0, 1) from the md5 of a value's text."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / 4294967296.0


def mix_sources(docs: DataFrame, mix: Mix = Mix(), *, topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """Every row of ``docs`` as two structs, so that no column can clash: ``row``,
    its own columns, and ``mix``: source, lang, topic, n_tokens, weight (its
    cell's calibrated share), probability and selected.

    ``topic`` and ``tokens``: columns of ``docs`` to use; by default the text's
    form and its words.  Null sources, languages and topics are the value ''.
    Documents without tokens (null and empty texts) cost none of the budget:
    they are selected, unless a given target of theirs is 0.  Texts of any
    length count whole.  Rows of one id, and so repeated rows, are taken
    together; rows with a null id share one hash; a hash that ties with the
    probability is not taken.  An empty table returns no rows.
    """
    text = F.coalesce("text", F.lit(""))
    label = F.struct(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(surface_topic(text) if topic is None else topic.cast("string"), F.lit("")).alias("topic"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)) if tokens is None else tokens, F.lit(0)).cast("long").alias("n_tokens"),
    )
    rows = docs.select(F.struct("*").alias("row"), label.alias("label"))
    cells = rows.groupBy(*[F.col(f"label.{c}").alias(c) for c in CELL]).agg(F.sum("label.n_tokens").alias("tokens"))
    cells = storage.materialize(cells, "cells")
    rates = storage.materialize(probabilities(raked(cells, mix), mix), "rates").select(F.struct(*CELL, "weight", "probability").alias("rate"))
    if rates.count() <= BROADCAST_CELLS:
        rates = F.broadcast(rates)
    joined = rows.join(rates, [F.col(f"label.{c}") == F.col(f"rate.{c}") for c in CELL])
    free = F.col("label.n_tokens") == 0
    for dim, given in mix.targets.items():
        free = free & F.col(f"label.{dim}").isin([str(k) for k, v in given.items() if v > 0])
    probability = F.when(free, 1.0).otherwise(F.col("rate.probability"))
    fields = [F.col(f"label.{c}").alias(c) for c in (*CELL, "n_tokens")]
    fields += [F.round("rate.weight", 9).alias("weight"), F.round(probability, 6).alias("probability"), (unit_hash(F.col("row.doc_id")) < probability).alias("selected")]
    return joined.select("row", F.struct(*fields).alias("mix"))


def mix_report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``mix_sources`` as columns doc_id, source and lang (as given), topic,
    n_tokens, weight, probability, selected."""
    found = mix_sources(docs.select("doc_id", "text", "source", "lang"), mix)
    return found.select("row.doc_id", "row.source", "row.lang", *[f"mix.{c}" for c in ("topic", "n_tokens", "weight", "probability", "selected")])


def sql(mix: Mix = Mix()) -> str:
    """``mix_report`` in DuckDB SQL, for targets by power."""
    count = lambda p: f"len(regexp_extract_all(t, '{p}'))"
    parts = [f"""
d AS (SELECT doc_id, source, lang, coalesce(text, '') AS t, coalesce(source, '') AS s, coalesce(lang, '') AS l FROM documents),
r AS (
  SELECT doc_id, source, lang, s, l, {count(WORD)}::BIGINT AS n_tokens, greatest({count(WORD)}, 1) AS w,
    {count("[|]")} AS bars, {count("[#*$%&<>]")} AS marks, {count("!")} AS bangs FROM d),
k AS (
  SELECT doc_id, source, lang, s, l, n_tokens, CASE WHEN 2 * bars >= w THEN 'table' WHEN 2 * marks >= w THEN 'marked' WHEN 2 * bangs >= w THEN 'loud'
    WHEN w < 100 THEN 'note' WHEN w < 1000 THEN 'article' ELSE 'book' END AS p FROM r),
c AS MATERIALIZED (SELECT s, l, p, sum(n_tokens)::BIGINT AS tokens FROM k GROUP BY ALL),
w0 AS MATERIALIZED (SELECT *, tokens / greatest((SELECT sum(tokens) FROM c)::DOUBLE, 1) AS weight FROM c)"""]
    for dim in "slp":
        parts.append(
            f"t{dim} AS MATERIALIZED (SELECT {dim}, t ** {mix.power}::DOUBLE / greatest((sum(t ** {mix.power}::DOUBLE) OVER ()), 1e-300) AS target"
            f" FROM (SELECT {dim}, sum(tokens)::DOUBLE AS t FROM c GROUP BY {dim}))"
        )
    step = 0
    for _ in range(mix.rounds):
        for dim in "slp":
            parts.append(
                f"w{step + 1} AS MATERIALIZED (SELECT s, l, p, tokens, CASE WHEN held > 0 THEN weight * target / held ELSE 0 END AS weight"
                f" FROM (SELECT *, sum(weight) OVER (PARTITION BY {dim}) AS held FROM w{step}) JOIN t{dim} USING ({dim}))"
            )
            step += 1
    parts.append(f"""
able AS (SELECT *, tokens / weight AS ratio FROM w{step} WHERE weight > 0),
whole AS (
  SELECT *, coalesce(sum(tokens) OVER o, 0) AS before, coalesce(sum(weight) OVER o, 0) AS held, (SELECT sum(weight) FROM able) AS everything FROM able
  WINDOW o AS (ORDER BY ratio, s, l, p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (
  SELECT arg_min(factor, ratio) AS factor FROM (
    SELECT ratio, ((SELECT sum(tokens) FROM c) * {mix.budget}::DOUBLE - before) / greatest(everything - held, 1e-12) AS factor FROM whole) WHERE factor <= ratio),
q AS (
  SELECT s, l, p, weight, CASE WHEN weight > 0 THEN least(1.0, coalesce((SELECT factor FROM f), 'inf'::DOUBLE) * weight / greatest(tokens, 1)) ELSE 0 END AS probability FROM w{step})""")
    return "WITH " + ",".join(parts) + """
SELECT doc_id, source, lang, p AS topic, n_tokens, round(weight, 9) AS weight, round(taken, 6) AS probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < taken AS selected
FROM (SELECT *, CASE WHEN n_tokens = 0 THEN 1.0::DOUBLE ELSE probability END AS taken FROM k JOIN q USING (s, l, p))"""

"""From raw documents to packed training sequences in five stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.llm import jaccard, mixing, packing, secret_scan, storage, toxicity
from ridgeline.session import table

#: Rows up to which a decision table is broadcast; longer ones join by a shuffle.
BROADCAST_ROWS = 300_000
#: Words that the packing stage's workers keep, who hold memory of earlier stages too.
CACHE_WORDS = 100_000
#: Near duplicates of the stage; the join's defaults are those of its own query.
NEAR = jaccard.Join(words=5, percent=80)


def _all(docs: DataFrame) -> list[Column]:
    """The columns, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below 0.5.

    Null and empty texts have the score of a text without patterns; rows that
    repeat an id or have none are judged each by its own text; an empty table
    stays empty; long texts are read whole, other columns pass unchanged."""
    score = toxicity.scorer(spark, *toxicity.train(docs, table(spark, sf_dir, "labels")))
    return docs.filter(score(F.coalesce("text", F.lit(""))) < 0.5)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component of texts that share 80 percent
    of their 5-word shingles; of rows that share an id, the one of least hash of
    its text.  Rows without an id, and documents without words, are linked with
    nothing and stay; an empty table stays empty; texts are read whole, other
    columns, whatever their names, pass unchanged."""
    found = jaccard.near_duplicates(docs, NEAR)
    spare = storage.materialize(found.filter("doc_id <> component_id").select("doc_id").distinct(), "spare-ids")
    kept = docs.join(_small(spare), "doc_id", "left_anti").select(_all(docs))
    again = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = storage.materialize(again, "repeated-ids")
    if again.isEmpty():
        return kept
    place = F.row_number().over(Window.partitionBy("row.doc_id").orderBy(F.xxhash64("row.text")))
    repeated = kept.join(again, "doc_id", "left_semi").select(F.struct(*_all(docs)).alias("row")).select("row", place.alias("place"))
    repeated = repeated.filter("place = 1").select("row.*")
    return kept.join(again, "doc_id", "left_anti").select(_all(docs)).unionByName(repeated)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced, n_chars to match.

    Null and empty texts hold none and pass unchanged, null n_chars with them;
    repeated rows and rows without an id are changed each; an empty table stays
    empty; other columns pass unchanged."""
    key = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    found = secret_scan.find_secrets(docs.select(key.alias("key"), "text"), id_col="key")
    found = storage.materialize(found.filter(F.size("spans") > 0).dropDuplicates(["key"]), "secrets")
    marked = docs.select(F.struct("*").alias("row"), key.alias("own")).join(_small(found), F.col("own") == F.col("key"), "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(secret_scan.redact(F.col("row.text"), F.col("spans")))
    marked = marked.select("row", text.alias("clean"), F.col("spans").isNotNull().alias("changed"))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("changed"), F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))}
    return marked.select(*[(new[c] if c in new else F.col("row.`" + c.replace("`", "``") + "`")).alias(c) for c in docs.columns])


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix selects.

    Null languages and sources are values of their own; documents without
    tokens stay; rows that repeat an id, or have none, are drawn as one; an
    empty table stays empty; other columns pass unchanged."""
    return mixing.mix_sources(docs).filter("mix.selected").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens.

    Null and empty texts are one token; repeated rows are packed each, rows
    without an id with a null one; ties in length go by id; an empty table
    gives no pieces."""
    return packing.pack(docs, cache_words=CACHE_WORDS)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix_to_targets),
    ("packing", pack_sequences),
]

#: A trained model and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again, over documents."""
    return reduce(lambda docs, stage: storage.materialize(stage[1](spark, docs, sf_dir), stage[0]), STAGES, table(spark, sf_dir, "documents"))

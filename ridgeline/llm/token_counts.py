"""Token counts with a digest cache.

Content and tokenizer version are each named by a digest.  Counts already in
the cache are joined; only distinct texts that are missing are encoded, and
their counts are appended to the cache.  Each call appends a folder of its own,
read once it is finished, so that writers do not disturb each other; what two
of them counted both is read once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import storage
from .batches import map_batches
from .tokenizing import drops_white_space, encoder, tokenizer_digest

CACHE_SCHEMA = "content binary, n_tokens long"


def normalised(text: Column, tokenizer: str) -> Column:
    """Content as the digest sees it: null is empty, and where the tokenizer
    itself drops white space, runs of ASCII white space are one space."""
    text = F.coalesce(text, F.lit(""))
    if drops_white_space(tokenizer):
        text = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return text


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(content, n_tokens) of a tokenizer version, each content once; empty
    where nothing has been written yet."""
    found = [f"{path}/{version}/{name}" for name in storage.folders(spark, f"{path}/{version}")]
    if not found:
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(*found).groupBy("content").agg(F.min("n_tokens").alias("n_tokens"))


def merge_cache(spark: SparkSession, path: str, version: str) -> None:
    """Make one folder of all that the cache has for a version.  For a time
    when no other call reads it."""
    old = storage.folders(spark, f"{path}/{version}")
    if len(old) > 1:
        read_cache(spark, path, version).write.parquet(f"{path}/{version}/{uuid.uuid4().hex}")
        for name in old:
            storage.delete(spark, f"{path}/{version}/{name}")


def encode_missing(misses: DataFrame, tokenizer: str) -> DataFrame:
    """Counts of ``misses`` (content, normal), one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for whole in batches:
            for part in K.slices(whole, "normal"):
                ids = enc.encode(part.column("normal").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("content"), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["content", "n_tokens"])

    return map_batches(misses.select("content", "normal"), run, CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count of every row of ``docs``: ``id_col``, n_bytes, n_tokens.

    ``cache_path``: folder in a shared store, made at first use, for any number
    of tokenizers and writers.  Null and empty texts count 0 tokens; repeated
    rows and rows that share an id each return a row; rows with a null id keep
    it; an empty table returns no rows.  Equal texts are encoded once, so ties
    cannot differ.  Other columns are ignored.  Texts of any length are encoded
    whole.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    rows = docs.select(
        F.col(id_col),
        F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes"),
        normalised(F.col(text_col), tokenizer).alias("normal"),
    ).withColumn("content", F.unhex(F.sha2("normal", 256)))
    # Copies go before the join, in the tasks that read them.
    fresh = rows.select("content", "normal").dropDuplicates(["content"])
    if storage.folders(spark, f"{cache_path}/{version}"):
        fresh = fresh.join(read_cache(spark, cache_path, version), "content", "left_anti")
    own = f"{cache_path}/{version}/{uuid.uuid4().hex}"
    encode_missing(fresh, tokenizer).write.parquet(own)
    if spark.read.schema(CACHE_SCHEMA).parquet(own).isEmpty():
        storage.delete(spark, own)
    counts = read_cache(spark, cache_path, version)
    return rows.select(id_col, "n_bytes", "content").join(counts, "content").select(id_col, "n_bytes", "n_tokens")


def token_report(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, cache_path: str | None = None) -> DataFrame:
    """``count_tokens`` with ``over_limit``: more than ``limit`` tokens.  The
    cache is by default the shared folder's, which later calls meet again."""
    cache_path = cache_path or f"{storage.shared_dir(docs.sparkSession)}/ridgeline-token-counts"
    return count_tokens(docs, tokenizer, cache_path).withColumn("over_limit", F.col("n_tokens") > limit)

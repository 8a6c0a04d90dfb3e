"""Containment join: how much of each small text is found in each large one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .bloom import bloom_of
from .ngrams import found_grams


def containment_join(docs: DataFrame, items: DataFrame, n: int = 8, least: float = 0.0, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, n_ngrams, n_found, share of all pairs that share an
    n-gram of ``n`` words and reach ``least``.

    n_ngrams are the distinct n-grams of the item, n_found those of them that
    the document has, and share their ratio.  Words are runs without blanks, A
    to Z in lower case.  Items are the small side: their n-grams' hashes become
    a Bloom filter, which the documents' n-grams meet where they are made, so
    that little more than true hits is shuffled; beyond the filter's bound all
    of them are.  The join is then on the n-grams' words themselves.

    Null texts and texts of fewer than ``n`` words have no n-grams.  Rows of one
    id are one text each but one document (or item): their n-grams are united.
    Rows without an id take no part.  Empty tables give no rows; other columns
    are ignored.
    """
    left, right = (t.select(F.col(c).alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL") for t, c in ((docs, doc_id), (items, item_id)))
    wanted = materialize(found_grams(right, n, hashes=True).distinct(), "item-grams").withColumnRenamed("id", "item")
    totals = wanted.groupBy("item").agg(F.count(F.lit(1)).alias("n_ngrams"))
    keys = wanted.select("h").distinct()
    # Copies of a document's n-gram go within the tasks, so a common one is a row for each document.
    found = found_grams(left, n, bloom_of(keys, "h", keys.count())).distinct()
    pairs = found.join(wanted.select("item", "gram"), "gram").groupBy("id", "item").agg(F.count(F.lit(1)).alias("n_found"))
    share = (F.col("n_found") / F.col("n_ngrams")).alias("share")
    return pairs.join(totals, "item").select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_ngrams", "n_found", share).filter(F.col("share") >= least)

"""Queries over documents, benchmark items and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import url_host
from ..operators.containment import containment_join
from ..operators.page_blocks import page_blocks as blocks
from ..session import table


def benchmark_containment(spark: SparkSession, root: str) -> DataFrame:
    """Share of each benchmark item's 8-grams that each document holds."""
    return containment_join(table(spark, root, "documents"), table(spark, root, "benchmark"))


def contaminated_items(spark: SparkSession, root: str) -> DataFrame:
    """Items that documents hold four fifths of or more: how many documents, in
    how many sources, and the largest share."""
    documents = table(spark, root, "documents")
    found = containment_join(documents, table(spark, root, "benchmark"), least=0.8)
    sources = documents.select(F.col("doc_id").alias("own"), "source")
    rows = found.join(sources, F.col("doc_id") == F.col("own"))
    return rows.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.count_distinct("source").alias("sources"), F.max("share").alias("share"))


def page_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Every block of text of every page, with density, link share and place."""
    return blocks(table(spark, root, "pages"))


def block_profile(spark: SparkSession, root: str) -> DataFrame:
    """Blocks, words and link share by host of the page and tag of the block."""
    pages = table(spark, root, "pages")
    hosts = pages.select(F.col("page_id").alias("own"), url_host("url").alias("host"))
    rows = blocks(pages).select("page_id", "tag", "n_words", "n_chars", "link_chars").join(hosts, F.col("page_id") == F.col("own"))
    sums = rows.groupBy("host", "tag").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n_words").alias("words"), F.sum("n_chars").alias("n_chars"), F.sum("link_chars").alias("link_chars"))
    return sums.select("host", "tag", "blocks", "words", (F.col("link_chars") / F.col("n_chars")).alias("link_share"))


#: Markup is beyond SQL: the queries over blocks have none.
QUERIES = (benchmark_containment, contaminated_items, page_blocks, block_profile)

_CONTAINED = """
WITH texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 1, item_id, text FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT side, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0b\\x0c\\r]+'), lambda x: x <> '') AS words FROM texts),
g AS (SELECT DISTINCT side, id, unnest(list_transform(range(greatest(len(words) - 7, 0)), lambda i: array_to_string(words[i + 1:i + 8], ' '))) AS gram FROM w),
n AS (SELECT id, count(*) AS n_ngrams FROM g WHERE side = 1 GROUP BY id),
p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_found FROM g d JOIN g i USING (gram) WHERE d.side = 0 AND i.side = 1 GROUP BY 1, 2),
contained AS (SELECT doc_id, item_id, n_ngrams, n_found, n_found / n_ngrams AS share FROM p JOIN n ON n.id = p.item_id)
"""

SQL = {
    "benchmark_containment": f"{_CONTAINED} SELECT * FROM contained",
    "contaminated_items": f"""{_CONTAINED}
SELECT item_id, count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS sources, max(share) AS share
FROM contained JOIN documents USING (doc_id) WHERE share >= 0.8 GROUP BY item_id""",
}

"""Lines that several documents share stay in the first of them alone.

Lines are exploded with their positions; a line's key is named by the MD5 of its
bytes, distinct documents are counted for each name, and the positions of the
lines to drop come back to their documents, which are put together again from
the positions that stay.  Column functions throughout.

A line that a third of all rows hold is no hot spot: names are counted first
within tasks and then by name and document, and the join back to the lines is an
inner sort-merge join of many rows with one, which Spark splits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

#: What is stripped from a line, and the letters that are lowered.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LineRule:
    """Keys of at least ``chars`` code points that at least ``documents``
    documents hold are dropped from all documents but the first."""

    chars: int = 10
    documents: int = 2


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A to Z in lower case."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_keys(texts: DataFrame, rule: LineRule) -> DataFrame:
    """(name, first): each key that reaches the rule's number of documents, and
    the smallest id that holds it."""
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.length(k) >= rule.chars))
    held = texts.filter("id IS NOT NULL").select("id", F.explode(keys).alias("key")).select("id", F.unhex(F.md5("key")).alias("name"))
    counts = held.groupBy("name").agg(F.count_distinct("id").alias("documents"), F.min("id").alias("first"))
    return storage.materialize(counts.filter(F.col("documents") >= rule.documents).select("name", "first"), "repeated-lines")


def drop_repeated_lines(docs: DataFrame, rule: LineRule = LineRule(), *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and, if asked, kept_text of
    every row.

    A null or empty text is one empty line.  A document is what shares an id:
    rows that repeat an id count once for a key, and either all or none of them
    keep its lines.  Rows without an id keep all their lines and count for no
    key.  Lines that repeat within one document only stay.  An empty table gives
    no rows; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    repeated = repeated_keys(texts, rule)
    # A row is known by its id and the digest of its text: rows equal in both are alike.
    named = texts.withColumn("digest", F.unhex(F.md5("text")))
    lines = named.filter("id IS NOT NULL").select("id", "digest", F.posexplode(F.transform(_lines(F.col("text")), line_key)).alias("place", "key"))
    lines = lines.filter(F.length("key") >= rule.chars).select("id", "digest", "place", F.unhex(F.md5("key")).alias("name"))
    lost = lines.join(repeated, "name").filter(F.col("id") != F.col("first")).groupBy("id", "digest").agg(F.collect_set("place").alias("lost"))
    lost = lost.select(F.col("id").alias("own_id"), F.col("digest").alias("own_digest"), "lost")
    # Exploding an array of one keeps the split from being repeated for every line.
    found = named.join(lost, (F.col("id") == F.col("own_id")) & (F.col("digest") == F.col("own_digest")), "left").select("id", F.explode(F.array(_lines(F.col("text")))).alias("lines"), "lost")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "lost")
    kept = F.concat_ws("\n", F.when(F.col("lost").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda p: F.col("lines")[p])))
    out = found.select(
        F.col("id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"),
        F.explode(F.array(kept)).alias("kept_text"),
    ).withColumn("kept_sha256", F.sha2("kept_text", 256))
    return out.select("doc_id", "n_lines", "n_dropped", "kept_sha256", *(["kept_text"] if keep_text else []))


#: The same in DuckDB SQL, with the default rule.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM d),
k AS (SELECT r, doc_id, line, place, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT k.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT k.*, coalesce(k.doc_id <> s.first, false) AS gone FROM k LEFT JOIN s USING (key)) k GROUP BY k.r, k.doc_id
"""

"""Best-fit-decreasing packing of token sequences.

Items of one length are alike, so best-fit decreasing is run on the histogram
of lengths (at most ``capacity`` rows) with a segment tree over remaining
capacities; each step places a run of equal items into a run of equal bins.
The plan's size depends on the capacity, not on the number of documents.
Documents then find their place by their rank among items of their length,
which Spark counts in salted groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from . import storage
from .batches import map_batches
from .tokenizing import CACHE_WORDS, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RULES = "rule_length long, rank_from long, rank_to long, per_bin long, first_bin long, base long"
#: Plans above this many rules are joined by a shuffle, not broadcast.
BROADCAST_RULES = 200_000


class CapacityTree:
    """Segment tree over capacities 0..n: which of them have open bins."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += n
            at //= 2

    def tightest(self, least: int) -> int:
        """Smallest capacity of at least ``least`` with an open bin, or -1."""
        at = least + self.size
        if self.count[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return -1
        while at < self.size:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over {length: count}.

    Rules (length, rank_from, rank_to, per_bin, first_bin, base): the item of
    that length and of rank r in [rank_from, rank_to) goes to bin first_bin +
    (r - rank_from) // per_bin at offset base + (r - rank_from) % per_bin *
    length.  The tightest open bin stays the tightest while items of the same
    length still fit it, so it takes ``per_bin`` of them in a row.
    """
    tree, runs, rules, bins = CapacityTree(capacity), {}, [], 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            runs.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted((k for k, n in histogram.items() if n), reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room < 0:
                room = capacity
                first, n = bins, -(-left // (capacity // length))
                bins += n
            else:
                first, n = runs[room].pop()
                tree.add(room, -n)
            per_bin = room // length
            full = min(n, left // per_bin)
            rest = left - full * per_bin if full < n else 0
            placed = full * per_bin + rest
            rules.append((length, rank, rank + placed, per_bin, first, capacity - room))
            put(room - per_bin * length, first, full)
            if rest:
                put(room - rest * length, first + full, 1)
            put(room, first + full + bool(rest), n - full - bool(rest))
            left -= placed
            rank += placed
    return rules


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, cache_words: int) -> DataFrame:
    """Token pieces of every document, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(tokenizer, cache_words), end_id.to_bytes(4, "little")
        for whole in batches:
            for part in K.slices(whole, "text"):
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    ids += tail
                    for k in range(0, len(ids), 4 * capacity):
                        own = ids[k : k + 4 * capacity]
                        rows.append((doc, k // (4 * capacity), k // 4, len(own) // 4, zlib.crc32(own)))
                cols = list(zip(*rows)) or [[]] * 5
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(rows, run, PIECES)


def ranked_by_length(pieces: DataFrame, salts: int) -> DataFrame:
    """``rank`` of each piece among those of its length, from 0.

    Pieces of one length are dealt over ``salts`` groups, so a very common
    length is many groups; the groups' counts give each its first rank.
    """
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = salted.withColumn("k", F.row_number().over(within) - 1)
    return numbered.join(firsts, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s"))).withColumn("rank", F.col("first") + F.col("k")).drop("l", "s", "k", "first", "salt")


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = 4096, end_id: int = 1, *, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset.  Null and empty texts are one token, the end id.  A document longer
    than ``capacity`` is cut into pieces of that length, the last one shorter;
    no text is too long.  Repeated rows are packed each; rows with a null doc_id
    keep it; ties in length are placed in the order of doc_id.  An empty table gives no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = storage.materialize(cut_pieces(docs, tokenizer, capacity, end_id, cache_words), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = best_fit_plan(histogram, capacity)
    rules = spark.createDataFrame(plan, RULES)
    if len(plan) <= BROADCAST_RULES:
        rules = F.broadcast(rules)
    salts = min(4096, max(64, sum(histogram.values()) // 100_000))
    ranked = ranked_by_length(pieces, salts)
    at = F.col("rank") - F.col("rank_from")
    hit = (F.col("length") == F.col("rule_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    return ranked.join(rules, hit).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(at / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("base") + at % F.col("per_bin") * F.col("length")).cast("long").alias("offset"),
    )

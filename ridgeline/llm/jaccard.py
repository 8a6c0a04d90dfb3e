"""Jaccard join on word n-grams by rare-first prefix filtering.

Documents of equal words are one class from the start.  Of each class's set,
ordered rarest first, only a prefix is indexed: two sets that are similar
enough share an n-gram there.  Length and positional filters apply to the
shared n-grams, a suffix filter to the pairs, and each pair left is verified
once, on the words of its texts.

``linked_pairs`` gives every link between classes.  ``near_duplicates`` gives
components, and finds them in two rounds.  First every member of an n-gram's
group is held against one leader, the member with the fewest rarer n-grams;
this ties large groups of near copies together with one pair a member.  Then
pairs whose components still differ are held against each other, in groups of
one n-gram and one band of lengths, so that no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import storage
from .batches import map_batches
from .components import components

#: Id lists up to this many rows are broadcast (8 bytes each); longer ones join by a shuffle.
BROADCAST_IDS = 500_000
#: Pairs that one copy of their more frequent text is sent for.
PARTNERS = 64
#: Least and most buckets of the suffix filter's signature, and shingles a bucket between
#: them: unlike sets of any size differ in most buckets.
BUCKETS, MOST_BUCKETS, A_BUCKET = 32, 1 << 16, 8
PROFILE = "own_id long, n_shingles long, words1 long, words2 long, prefix array<bigint>, buckets array<smallint>"


@dataclass(frozen=True)
class Join:
    """``words`` a shingle; sets link when 100 * common >= ``percent`` * union.

    ``frequent``: how many of the most frequent shingles have a known count in
    the rare-first order (12 bytes each, sent to every task).  All others come
    before them in the order of their hash; any order is right, a better one
    makes fewer candidates.
    """

    words: int = 4
    percent: int = 85
    frequent: int = 100_000


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case bytes of all texts, begin and end of their words, and the
    words before each text (n + 1 places)."""
    raw, at = K.text_bytes(part.column("own_text"))
    raw = K.LOWER[raw]
    return raw, *K.word_bounds(raw, at)


def _sets(part: pa.RecordBatch, raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, first: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text in order, text by text, and how
    many come before each text (n + 1 places)."""
    hashes, base = K.shingle_hashes(K.word_hashes(raw, begins, ends), first, words)
    doc = np.repeat(np.arange(part.num_rows), np.diff(base))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(part.num_rows + 1))


def frequent_shingles(docs: DataFrame, how: Join) -> Broadcast:
    """Hashes and counts of the shingles found most often in several documents
    of one task: a bounded aid for the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts > 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(counts[many].astype(np.int64))], names=["h", "n"])

        for whole in batches:
            for part in K.slices(whole, "own_text"):
                held.append(_sets(part, *_words(part), how.words)[0])
                if sum(map(len, held)) > 2_000_000:
                    yield flush()
        if held:
            yield flush()

    counted = map_batches(docs.select("own_text"), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted = storage.materialize(counted, "frequent")
    # Whole bands of counts, the highest first, as far as they fit: no task and
    # no driver ever holds more than how.frequent rows of them.
    band = F.floor(F.log2("n") * 8).cast("int")
    least, held = None, 0
    for row in counted.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least")).orderBy(F.desc("band")).collect():
        held += row["rows"]
        if held > how.frequent:
            break
        least = row["least"]
    rows = counted.filter(F.col("n") >= least if least is not None else F.lit(False)).toArrow().sort_by("h")
    hashes, counts = (rows[c].to_numpy().astype(np.int64) for c in ("h", "n"))
    order = np.argsort(hashes.view(K.U64))
    return docs.sparkSession.sparkContext.broadcast((hashes.view(K.U64)[order], counts[order]))


def bucket_counts(h: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many hashes of each set have the same low bits, set by set, and where
    each set's counts begin (n + 1 places).  A set has a power of two of them."""
    n = np.diff(base)
    wide = 1 << np.ceil(np.log2(np.clip(n / A_BUCKET, BUCKETS, MOST_BUCKETS))).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(wide)])
    place = np.repeat(at[:-1], n) + (h & np.repeat(wide - 1, n).astype(K.U64)).astype(np.int64)
    return np.bincount(place, minlength=at[-1]).astype(np.int16), at


def _apart(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the hashes that only one of two sets has, by their
    bucket counts; the longer ones are added up to the shorter ones' number."""
    few = min(len(x), len(y))
    x, y = (c.reshape(-1, few).sum(axis=0, dtype=np.int64) for c in (x, y))
    return int(np.abs(x - y).sum())


def profiles(docs: DataFrame, how: Join, frequent: Broadcast) -> DataFrame:
    """Set size, digest of the words, rare-first prefix and bucket counts of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = frequent.value
        for whole in batches:
            for part in K.slices(whole, "own_text"):
                raw, begins, ends, first = _words(part)
                h, base = _sets(part, raw, begins, ends, first, how.words)
                data, word_begins, word_ends = K.spaced(raw, begins, ends)
                places = np.append(word_begins, len(data))
                digest = K.digests(data, places[first[:-1]], places[first[1:]])
                n = np.diff(base)
                doc = np.repeat(np.arange(len(n)), n)
                rank = np.zeros(len(h), np.int64)
                if len(known):
                    spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[spot] == h, counts[spot], 0)
                sorted_h = h[np.lexsort((h, rank, doc))]
                size = np.where(n > 0, n - (how.percent * n + 99) // 100 + 1, 0)
                cuts = np.concatenate([[0], np.cumsum(size)])
                pick = np.arange(cuts[-1]) + np.repeat(base[:-1] - cuts[:-1], size)
                bucket, bucket_at = bucket_counts(h, base)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("own_id"), pa.array(n.astype(np.int64)),
                        pa.array(digest[:, 0]), pa.array(digest[:, 1]),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(sorted_h[pick].view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(bucket_at.astype(np.int32)), pa.array(bucket)),
                    ],
                    names=["own_id", "n_shingles", "words1", "words2", "prefix", "buckets"],
                )

    return map_batches(docs.select("own_id", "own_text"), run, PROFILE)


def _passes(x: str, y: str, percent: int) -> Column:
    """Length and positional filters for a shingle at place ``pos`` of both sets:
    as their first common one, it bounds their overlap."""
    nx, ny, px, py = (F.col(f"{t}.{c}") for c in ("n", "pos") for t in (x, y))
    most = F.least(nx - px, ny - py)
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & ((100 + percent) * most >= percent * (nx + ny))


def _suffix_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Drops pairs whose bucket counts differ by more than the sets may."""
    side = classes.select("id", "n", "buckets")
    a = side.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("buckets").alias("ba"))
    b = side.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("buckets").alias("bb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            (x, at_x), (y, at_y) = ((c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (part.column("ba"), part.column("bb")))
            apart = np.array([_apart(x[at_x[k] : at_x[k + 1]], y[at_y[k] : at_y[k + 1]]) for k in range(part.num_rows)], dtype=np.int64)
            both = part.column("na").to_numpy() + part.column("nb").to_numpy()
            yield part.select(["a", "b"]).filter(pa.array((100 + percent) * (both - apart) >= 2 * percent * both))

    return map_batches(pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ba", "bb"), run, "a long, b long").distinct()


def shingle_set(text: bytes, words: int) -> set[tuple[bytes, ...]]:
    """The set of a text, by its words themselves."""
    found = text.translate(_LOWER).split()
    return set(zip(*(found[k:] for k in range(words)))) if len(found) >= words else {tuple(found)} if found else set()


_LOWER = K.LOWER.tobytes()


def _led(pairs: DataFrame) -> DataFrame:
    """(leader, member, block) of ``pairs``: the text in more pairs leads, with
    up to about ``PARTNERS`` members in a block."""
    counts = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    counts = storage.materialize(counts, "pair-counts")
    both = pairs.join(counts.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(counts.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    first = F.col("ka") >= F.col("kb")
    led = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("leader"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("member"), F.greatest("ka", "kb").alias("k"))
    return led.select("leader", "member", F.pmod(F.xxhash64("member"), F.ceil(F.col("k") / PARTNERS)).alias("block"))


def verified(pairs: DataFrame, docs: DataFrame, how: Join) -> DataFrame:
    """(a, b, common, total) of the pairs (a, b) that link, each judged once:
    sizes of intersection and union.

    A leader's text goes once to each block of its members, which then stream
    past it.  Pairs that pass on hashes are counted on the words themselves.
    """
    led = storage.materialize(_led(storage.materialize(pairs, "pairs")), "led-pairs")
    ids = storage.materialize(led.select(F.col("leader").alias("id")).union(led.select(F.col("member").alias("id"))).distinct(), "pair-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = storage.materialize(docs.join(wanted, F.col("own_id") == F.col("id"), "left_semi").select("own_id", "own_text").distinct(), "pair-texts")
    leaders = led.select("leader", "block", F.lit(None).cast("long").alias("member"), F.col("leader").alias("id")).distinct()
    roles = leaders.unionByName(led.select("leader", "block", "member", F.col("member").alias("id")))
    streams = roles.join(texts, F.col("id") == F.col("own_id")).select("leader", "block", "member", "own_text")
    streams = streams.repartition("leader", "block").sortWithinPartitions("leader", "block", F.col("member").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for whole in batches:
            for part in K.slices(whole, "own_text"):
                h, base = _sets(part, *_words(part), how.words)
                raw, at = K.text_bytes(part.column("own_text"))
                data, found = memoryview(raw), []
                for k, (leader, block, member) in enumerate(zip(*(part.column(c).to_pylist() for c in ("leader", "block", "member")))):
                    own, text = h[base[k] : base[k + 1]], data[at[k] : at[k + 1]]
                    if member is None:
                        if group != (leader, block):
                            group, held = (leader, block), []
                        held.append((own.copy(), bytes(text)))
                        continue
                    for other, words in held:
                        if not len(own) or not len(other):
                            continue
                        common = int((other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own).sum())
                        if 100 * common >= how.percent * (len(own) + len(other) - common):
                            x, y = shingle_set(words, how.words), shingle_set(bytes(text), how.words)
                            common, total = len(x & y), len(x | y)
                            if 100 * common >= how.percent * total:
                                found.append((min(leader, member), max(leader, member), common, total))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else [[]] * 4)], names=["a", "b", "common", "total"])

    best = map_batches(streams, run, "a long, b long, common long, total long").groupBy("a", "b").agg(F.max(F.struct((F.col("common") / F.col("total")).alias("share"), "common", "total")).alias("x"))
    return storage.materialize(best.select("a", "b", "x.common", "x.total"), "links")


def _classes(docs: DataFrame, how: Join, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (own_id, own_text), their profiles, the classes of equal words
    with the least id of each, and those ids' prefixes."""
    rows = docs.select(F.col(id_col).cast("long").alias("own_id"), F.col(text_col).alias("own_text"))
    known = storage.materialize(profiles(rows, how, frequent_shingles(rows, how)), "profiles")
    live = known.filter(F.col("own_id").isNotNull() & (F.col("n_shingles") > 0))
    heads = storage.materialize(live.groupBy(*CLASS).agg(F.min("own_id").alias("id")), "classes")
    own = live.alias("k").join(heads.alias("h"), [F.col("own_id") == F.col("id"), *_same_class()], "left_semi").select(F.col("own_id").alias("id"), F.col("n_shingles").alias("n"), "prefix", "buckets")
    return rows, known, heads, storage.materialize(own, "class-profiles")


CLASS = ["n_shingles", "words1", "words2"]


def _same_class() -> list[Column]:
    return [F.col(f"k.{c}") == F.col(f"h.{c}") for c in CLASS]


def _entries(classes: DataFrame) -> DataFrame:
    return classes.select("id", "n", F.posexplode("prefix").alias("pos", "shingle"))


def _near_lengths(x: DataFrame, y: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, Column]:
    """``x`` and ``y`` as aliases, and the condition that a shingle of theirs is
    common and their lengths are near.

    Set sizes are cut into bands a little wider than the least ratio of two
    sizes that link, and x stands in its own band and both next to it: a group
    of one shingle is as many groups as its lengths have bands.
    """
    width = 1.001 * max(math.log(100 / percent), 1e-6)
    own = F.floor(F.log("n") / F.lit(width))
    x = x.withColumn("band", F.explode(F.array(own - 1, own, own + 1))).alias("x")
    y = y.withColumn("band", own).alias("y")
    return x, y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.band") == F.col("y.band")) & _passes("x", "y", percent)


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Candidates (a, b) of different components among ``members`` (shingle, id,
    n, pos, comp).  The members of a group's largest component are only held
    against the others', so a large group of copies costs a row for each text
    outside it, not for each pair."""
    sizes = members.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = sizes.groupBy("shingle").agg(F.max(F.struct("k", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    mixed = storage.materialize(mixed.select("shingle", F.col("most.comp").alias("main")), "mixed-shingles")
    members = storage.materialize(members.join(mixed, "shingle"), "mixed")
    x, y, near = _near_lengths(members.filter("comp <> main"), members, percent)
    once = (F.col("y.comp") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))
    found = x.join(y, near & (F.col("x.comp") != F.col("y.comp")) & once)
    return found.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def _between(links: DataFrame, roots: DataFrame) -> DataFrame:
    """``links`` (a, b) as links between the components that ``roots`` names."""
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias("of"), F.col("root").alias("top"))
        links = links.join(own, F.col(end) == F.col("of"), "left").withColumn(end, F.coalesce("top", end)).drop("of", "top")
    return links


def linked_pairs(docs: DataFrame, how: Join = Join(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every link between texts of different words: a < b (the least ids of
    their classes), common and total (sizes of intersection and union).

    Handles odd rows as ``near_duplicates`` does.  The number of rows, and so
    the work, grows with the links that there are.
    """
    rows, _, _, classes = _classes(docs, how, id_col, text_col)
    x, y, near = _near_lengths(_entries(classes), _entries(classes), how.percent)
    pairs = x.join(y, near & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    return verified(_suffix_filter(pairs, classes, how.percent), rows, how)


def _by_id(known: DataFrame, heads: DataFrame) -> DataFrame:
    """Links between classes that rows of one id belong to."""
    own = known.select("own_id", *CLASS).alias("k").join(heads.alias("h"), _same_class()).select("own_id", "id")
    several = own.groupBy("own_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("own_id", "a")
    return own.join(several, "own_id").filter("id > a").select("a", F.col("id").alias("b"))


def near_duplicates(docs: DataFrame, how: Join = Join(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every document under the join's links: ``id_col``,
    n_shingles, component_id (least id reachable).

    Texts without words, empty and null texts have no shingles and are linked
    with nothing: component_id is their own id.  Texts of any length count
    whole.  Repeated rows and rows that share an id are one document of the
    graph and each return a row; a tie of components goes to the least id.
    Rows with a null id are returned with a null component_id and link nothing.
    An empty table returns no rows.  Other columns are ignored.
    """
    rows, known, heads, classes = _classes(docs, how, id_col, text_col)
    entries = _entries(classes)
    # Most shingles are found in one class only: they are told by a narrow count, before anything else is.
    many = storage.materialize(entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("shingle"), "many")
    shared = storage.materialize(entries.join(many, "shingle"), "shared")
    leaders = shared.groupBy("shingle").agg(F.min_by("id", "pos").alias("id"), F.min_by("n", "pos").alias("n"), F.min("pos").alias("pos"))
    leaders = storage.materialize(leaders, "leaders")
    led = shared.alias("x").join(leaders.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & _passes("x", "y", how.percent) & (F.col("x.id") != F.col("y.id")))
    tried = storage.materialize(led.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), "tried")
    links = verified(_suffix_filter(tried, classes, how.percent), rows, how).select("a", "b")
    links = links.union(_by_id(known, heads))

    roots = storage.materialize(components(links), "roots")
    members = shared.join(roots, F.col("id") == F.col("node"), "left").select("shingle", "id", "n", "pos", F.coalesce("root", "id").alias("comp"))
    rest = _across(storage.materialize(members, "members"), how.percent).join(tried, ["a", "b"], "left_anti")
    more = verified(_suffix_filter(rest, classes, how.percent), rows, how).select("a", "b")

    named = heads.join(roots, F.col("id") == F.col("node"), "left").select(*CLASS, F.coalesce("root", "id").alias("root"))
    if not more.isEmpty():
        tops = storage.materialize(components(_between(more, roots)), "tops").select(F.col("node").alias("low"), F.col("root").alias("top"))
        named = named.join(tops, F.col("root") == F.col("low"), "left").select(*CLASS, F.coalesce("top", "root").alias("root"))
    placed = known.select("own_id", *CLASS).alias("k").join(named.alias("h"), _same_class(), "left")
    out = placed.select("k.own_id", "k.n_shingles", F.when(F.col("k.own_id").isNotNull(), F.coalesce("h.root", "k.own_id")).alias("component_id"))
    return out.withColumnRenamed("own_id", id_col)


#: The same in DuckDB SQL, with the default parameters.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 2, 2)), lambda i: array_to_string(ws[i:i+3], ' '))) AS g
  FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * common >= 85 * (na.n + nb.n - common)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, p.b FROM reach JOIN p ON reach.r = p.a)
SELECT reach.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id
FROM reach LEFT JOIN n ON reach.doc_id = n.doc_id GROUP BY reach.doc_id
"""

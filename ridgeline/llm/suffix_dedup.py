"""Exact removal of long repeated byte strings by induced suffix sorting.

Sorting a suffix for every byte would shuffle many times the text.  As in
induced sorting, only sample suffixes are sorted and the others' order is
induced from them:

1. Sample: every string of ``window`` bytes picks an anchor in it by content
   (``repeats``).  Anchors found once are done with; so are those whose bodies
   are all equal.
2. Name: the remaining bodies are grouped by anchor.
3. Sort: Spark's external sort orders the suffixes that begin at the anchors
   of each group, spilling sorted runs to disk and merging them from a priority
   queue.
4. Induce: a task reads the sorted tuples in chunks of whole groups and carries
   order and common-prefix lengths one byte to the left at a time: suffixes
   are stably ordered by the byte before, and two neighbours share one byte
   more than the least common prefix between them did.  A string repeats
   where it shares ``window`` bytes with a neighbour.

Groups with more than ``hot_group`` bodies would not fit a task.  Their anchors
are grown to the whole string, so that each string is a group of its own, named
by its 128-bit digest, which Spark counts in parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats, storage
from .batches import map_batches
from .repeats import Windows

BYTES = Windows("bytes", 200, 64)
HOT_GROUP = 2000
#: Bodies in a chunk of groups, besides the last group's.
CHUNK = 20_000
VERDICT = "name long, body long, runs array<int>"


def first_common(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows."""
    differ = left != right
    return np.where(differ.any(axis=1), differ.argmax(axis=1), left.shape[1])


class RangeLeast:
    """Least of x[begin] .. x[end - 1] for many ranges at once."""

    def __init__(self, x: np.ndarray, longest: int):
        self.levels = [x]
        reach = 1
        while 2 * reach <= longest:
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-reach], last[reach:]))
            reach *= 2

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        level = np.frexp((end - begin).astype(np.float64))[1] - 1
        out = np.empty(len(begin), dtype=self.levels[0].dtype)
        for k, table in enumerate(self.levels):
            own = level == k
            out[own] = np.minimum(table[begin[own]], table[end[own] - (1 << k)])
        return out


def induce(group: np.ndarray, raw: np.ndarray, at: np.ndarray, lead: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """Which strings of the bodies repeat within their group.

    Bodies are sorted by group and by their bytes from the anchor on; ``at``
    is where each begins in ``raw``, ``lead`` the anchor's place in it, ``n``
    its strings.  Returns a flag for each string, body after body.
    """
    size = len(group)
    base = np.concatenate([[0], np.cumsum(n)])
    flags = np.zeros(base[-1], dtype=bool)
    width = np.minimum(np.diff(at) - lead, window)
    padded = np.concatenate([raw, np.zeros(window, np.uint8)])
    right = padded[(at[:-1] + lead)[:, None] + np.arange(window)]
    common = np.zeros(size, dtype=np.int64)
    if size > 1:
        common[1:] = np.minimum(first_common(right[1:], right[:-1]), np.minimum(width[1:], width[:-1]))
        common[1:][group[1:] != group[:-1]] = 0
    del right
    order = np.arange(size)
    for step in range(int(lead.max(initial=0)) + 1):
        if step:
            active = np.flatnonzero(lead[order] >= step)
            if not len(active):
                break
            # Between neighbours that stay, the least of what lay between them.
            least = np.zeros(len(active), dtype=np.int64)
            least[1:] = np.minimum.reduceat(common, active[:-1] + 1)[: len(active) - 1] if len(active) > 1 else 0
            if len(active) > 1:
                least[-1] = common[active[-2] + 1 : active[-1] + 1].min()
            order = order[active]
            key = group[order] * 256 + raw[at[order] + lead[order] - step]
            moved = np.argsort(key, kind="stable")
            common = np.zeros(len(order), dtype=np.int64)
            same = np.flatnonzero(key[moved[1:]] == key[moved[:-1]]) + 1
            if len(same):
                begin, end = moved[same - 1] + 1, moved[same] + 1
                common[same] = np.minimum(RangeLeast(least, int((end - begin).max()))(begin, end) + 1, window)
            order = order[moved]
        place = lead[order] - step
        long = common >= window
        hit = long.copy()
        hit[:-1] |= long[1:]
        hit &= place < n[order]
        flags[base[order[hit]] + place[hit]] = True
    return flags


def as_runs(flags: np.ndarray) -> list[int]:
    """[begin, end, begin, end, ...] of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges.tolist()


def _verdicts(rows: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    name, body, runs = zip(*rows) if rows else ((), (), ())
    arrays = [pa.array(name, pa.int64()), pa.array(body, pa.int64()), pa.array(runs, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(arrays, names=["name", "body", "runs"])


def sorted_groups(bodies: DataFrame, rows: DataFrame, how: Windows) -> DataFrame:
    """Verdicts of bodies whose groups fit a task, by induced sorting."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in K.slices(whole, "own_text"):
                raw, at = K.text_bytes(part.column("own_text"))
                owner, flat = repeats.spots_of(part)
                start, n = (flat.field(k).to_numpy() for k in ("start", "n"))
                begin = (at[owner] + start).tolist()
                end = (at[owner] + start + n + how.window - 1).tolist()
                data = raw.tobytes()
                cols = [flat.field(k) for k in ("name", "body", "n", "lead")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([data[b:e] for b, e in zip(begin, end)], pa.binary())], names=["name", "body", "n", "lead", "content"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def judged(chunk: pa.Table) -> pa.RecordBatch:
            chunk = chunk.combine_chunks()
            name, body, n, lead = (chunk.column(k).to_numpy() for k in ("name", "body", "n", "lead"))
            content = chunk.column("content").to_pylist()
            at = np.concatenate([[0], np.cumsum([len(c) for c in content])]).astype(np.int64)
            group = np.cumsum(np.concatenate([[0], name[1:] != name[:-1]]))
            n = n.astype(np.int64)
            flags = induce(group, np.frombuffer(b"".join(content), np.uint8), at, lead.astype(np.int64), n, how.window)
            base = np.concatenate([[0], np.cumsum(n)])
            some = np.flatnonzero(np.add.reduceat(flags.astype(np.int64), base[:-1])).tolist()
            return _verdicts([(int(name[k]), int(body[k]), as_runs(flags[base[k] : base[k + 1]])) for k in some])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                chunk = pa.Table.from_batches(held)
                name = chunk.column("name").to_numpy()
                cut_at = int(np.searchsorted(name, name[-1]))
                if cut_at:
                    yield judged(chunk.slice(0, cut_at))
                held = chunk.slice(cut_at).to_batches()
        if held:
            yield judged(pa.Table.from_batches(held))

    cuts = repeats.cut_bodies(bodies, rows, cut, "name long, body long, n int, lead int, content binary")
    suffix = F.substring("content", F.col("lead") + 1, F.lit(how.window))
    ordered = cuts.repartition("name").sortWithinPartitions(F.col("name"), suffix)
    return map_batches(ordered, sort, VERDICT)


def counted_groups(bodies: DataFrame, rows: DataFrame, how: Windows) -> DataFrame:
    """Verdicts of bodies of hot groups, by counting their strings."""
    strings = storage.materialize(repeats.window_rows(bodies, rows, how).select("name", "body", "place", "h1", "h2"), "hot-strings")
    many = strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    places = strings.join(many, ["h1", "h2"]).groupBy("name", "body").agg(F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, body, places in zip(*(batch.column(k).to_pylist() for k in ("name", "body", "places"))):
                flags = np.zeros(max(places) + 1, dtype=bool)
                flags[places] = True
                rows.append((name, body, as_runs(flags)))
            yield _verdicts(rows)

    return map_batches(places, run, VERDICT)


def _kept(rows: DataFrame, how: Windows, keep_text: bool) -> DataFrame:
    schema = "own_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in K.slices(whole, "own_text"):
                raw, at = K.text_bytes(part.column("own_text"))
                gone = repeats.covered(part.column("runs"), at, how.window)
                sums = np.concatenate([[0], np.cumsum(gone)])
                removed = sums[at[1:]] - sums[at[:-1]]
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                first = at[:-1][np.diff(at) > 0]
                begins[first] = gone[first]
                spans = np.concatenate([[0], np.cumsum(begins)])
                left = memoryview(raw[~gone])
                ends = (at - sums[at]).tolist()
                kept = [left[b:e] for b, e in zip(ends, ends[1:])]
                arrays = [
                    pa.array(np.diff(at)), pa.array(removed), pa.array(spans[at[1:]] - spans[at[:-1]]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array([bytes(x) if keep_text else None for x in kept], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([part.column("own_id"), *arrays], names=[f.split()[0] for f in schema.split(", ")])

    return map_batches(rows, run, schema)


def remove_repeated_bytes(docs: DataFrame, how: Windows = BYTES, hot_group: int = HOT_GROUP, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Remove every byte covered by a string of ``how.window`` bytes that starts
    at another place too, in the same document or another.

    Returns ``id_col``, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and kept_bytes (null without ``keep_text``; bytes, as a cut may
    fall inside a character).  Null and empty texts have no bytes; texts of any
    length are read whole.  All places of a repeated string count alike, so
    there are no ties.  Repeated rows, and rows that share an id, repeat each
    other.  Rows with a null id take part like any other.  An empty table
    returns no rows.  Other columns are ignored.
    """
    rows = repeats.keyed(docs, id_col, text_col)
    places = repeats.occurrences(rows, how)
    again = places.groupBy("name").agg(F.count(F.lit(1)).alias("all"), F.min("body").alias("low"), F.max("body").alias("high")).filter("all > 1")
    # Written, so that the join below is of two plain shuffles, which Spark can split at a common name.
    again = storage.materialize(again.select("name", (F.col("low") != F.col("high")).alias("mixed")), "repeated-names")
    places = storage.materialize(places.join(again, "name"), "repeated-places")
    bodies = storage.materialize(repeats.merge_bodies(places.filter("mixed")), "mixed-bodies")
    sizes = bodies.groupBy("name").agg(F.count(F.lit(1)).alias("k"))
    hot_names = storage.materialize(sizes.filter(F.col("k") > hot_group).select("name"), "hot-names")
    hot = not hot_names.isEmpty()
    verdicts = sorted_groups(bodies.join(hot_names, "name", "left_anti") if hot else bodies, rows, how)
    if hot:
        verdicts = verdicts.unionByName(counted_groups(bodies.join(hot_names, "name", "left_semi"), rows, how))
    # A body that is found twice repeats as a whole, whatever its strings do elsewhere.
    once = storage.materialize(verdicts, "verdicts").join(bodies.filter("c = 1").select("name", "body"), ["name", "body"])
    whole = places.filter("NOT mixed").select("own_id", "own_key", "start", F.array(F.lit(0), "n").alias("runs"))
    twice = bodies.filter("c > 1").select("name", "body", F.array(F.lit(0), "n").alias("runs"))
    part = places.filter("mixed").join(once.unionByName(twice), ["name", "body"]).select("own_id", "own_key", "start", "runs")
    hits = whole.unionByName(part).select("own_id", "own_key", F.transform("runs", lambda x: x + F.col("start")).alias("runs"))
    return _kept(repeats.with_hits(rows, hits), how, keep_text).withColumnRenamed("own_id", id_col)


#: The same in DuckDB SQL, with the default parameters, on hexadecimal text.
SQL = r"""
WITH d AS (SELECT doc_id, lower(hex(coalesce(text, ''))) AS x FROM documents),
win AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 400)) AS h, md5(substr(x, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM d WHERE length(x) >= 400)),
hit AS (SELECT doc_id, i FROM win JOIN (SELECT h, m FROM win GROUP BY h, m HAVING count(*) > 1) USING (h, m)),
edge AS (SELECT doc_id, i, max(i + 200) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM hit),
run AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
span AS (SELECT doc_id, r, min(i) AS b, max(i) + 200 AS e FROM run GROUP BY doc_id, r),
piece AS (
  SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS prior FROM span),
part AS (SELECT p.doc_id, p.b, substr(x, 2 * prior + 1, 2 * (p.b - prior)) AS s, p.e - p.b AS removed FROM piece p JOIN d USING (doc_id)),
kept AS (SELECT doc_id, string_agg(s, '' ORDER BY b) AS s, sum(removed) AS removed, count(*) AS n FROM part GROUP BY doc_id),
last AS (SELECT doc_id, max(e) AS e FROM span GROUP BY doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(k.removed, 0)::BIGINT AS n_removed, coalesce(k.n, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k.s, '') || substr(x, 2 * coalesce(l.e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id) LEFT JOIN last l USING (doc_id)
"""

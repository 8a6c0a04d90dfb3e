"""Repeated windows across documents, found through sampled anchors.

A document is a string of symbols: its bytes, or its words.  Every window picks
an inner run of symbols, its anchor, by content alone (``kernels.anchors``), so
equal windows have equal anchors at equal places.  Neighbouring windows with
one anchor make a *body*, named by a digest of what it covers.  Only one row per
body is shuffled, about one for every 18 words or 60 bytes, instead of one per
window.

* An anchor that is found once has no repeated window.
* Where all bodies of an anchor are equal, their windows repeat together.
* Where they differ, the windows of the distinct bodies are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from . import storage
from .batches import map_batches

#: Id lists up to this many rows are broadcast (16 bytes each); longer ones join by a shuffle.
BROADCAST_IDS = 500_000

OCCURRENCES = "own_id long, own_key long, start long, n int, lead int, name long, body long"


@dataclass(frozen=True)
class Windows:
    """``units``: "bytes" or "words".  ``window`` symbols each, anchored on
    ``inner`` of them."""

    units: str
    window: int
    inner: int


@dataclass
class Content:
    """Symbols of all texts of a batch, ``at`` where each text begins among
    them, and where symbol i is in ``data``: [begins[i], ends[i])."""

    symbols: np.ndarray
    at: np.ndarray
    data: bytes | memoryview
    begins: np.ndarray
    ends: np.ndarray

    def digests(self, first: np.ndarray, count: np.ndarray | int) -> np.ndarray:
        """Of ``count`` symbols from each of ``first`` on."""
        return K.digests(self.data, self.begins[first], self.ends[first + count - 1])


def content(column: pa.Array, units: str) -> Content:
    raw, at = K.text_bytes(column)
    if units == "bytes":
        places = np.arange(len(raw) + 1)
        return Content(K.BYTE_SYMBOL[raw], at, memoryview(raw), places[:-1], places[1:])
    begins, ends, first = K.word_bounds(raw, at)
    return Content(K.word_hashes(raw, begins, ends), first, *K.spaced(raw, begins, ends))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows as (own_id, own_key, own_text).  The key tells rows of one id but
    different texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("own_id"), F.xxhash64(text).alias("own_key"), text.alias("own_text"))


def same_document(x: str, y: str) -> Column:
    """Join condition on id, null or not, and key."""
    return F.col(f"{x}.own_id").eqNullSafe(F.col(f"{y}.own_id")) & (F.col(f"{x}.own_key") == F.col(f"{y}.own_key"))


def _batch(cols: dict[str, np.ndarray | pa.Array], schema: str) -> pa.RecordBatch:
    kinds = {"long": np.int64, "int": np.int32}
    fields = [f.split() for f in schema.split(", ")]
    arrays = [x if isinstance(x := cols[k], pa.Array) else pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(kinds[t])) for k, t in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[k for k, _ in fields])


def occurrences(rows: DataFrame, how: Windows) -> DataFrame:
    """Every body of every document, in place, as a written table: texts are
    read for it once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in K.slices(whole, "own_text"):
                found = content(part.column("own_text"), how.units)
                cols = K.anchors(found.symbols, found.at, how.window, how.inner)
                text = cols.pop("text")
                cols["body"] = found.digests(found.at[text] + cols["start"], cols["n"] + how.window - 1)[:, 0]
                owner = pa.array(text)
                yield _batch(cols | {c: part.column(c).take(owner) for c in ("own_id", "own_key")}, OCCURRENCES)

    return storage.materialize(map_batches(rows, run, OCCURRENCES), "occurrences")


def merge_bodies(places: DataFrame, count: str | None = None) -> DataFrame:
    """One row per body: rows or sum of their ``count``, first place."""
    first = F.min(F.struct("own_id", "start", "own_key", "n", "lead")).alias("first")
    merged = places.groupBy("name", "body").agg((F.sum(count) if count else F.count(F.lit(1))).alias("c"), first)
    return merged.select("name", "body", "c", "first.own_id", "first.own_key", "first.start", "first.n", "first.lead")


def cut_bodies(bodies: DataFrame, rows: DataFrame, function, schema: str) -> DataFrame:
    """``function(text bytes, body places)`` over the documents that hold the
    first places of ``bodies``: yields rows of ``schema``.

    The places of a document meet its text once; the documents are found by a
    broadcast of their ids while those are few.
    """
    spots = bodies.groupBy("own_id", "own_key").agg(F.collect_list(F.struct("name", "body", "start", "n", "lead")).alias("spots"))
    spots = storage.materialize(spots, "spots")
    ids = spots.select("own_id", "own_key")
    few = ids.count() <= BROADCAST_IDS
    near = rows.alias("r").join((F.broadcast(ids) if few else ids).alias("i"), same_document("r", "i"), "left_semi").dropDuplicates(["own_id", "own_key"])
    both = near.alias("r").join(spots.alias("s"), same_document("r", "s"))
    return map_batches(both.select("r.own_id", "r.own_text", "s.spots"), function, schema)


def spots_of(part: pa.RecordBatch) -> tuple[np.ndarray, pa.StructArray]:
    """Row and fields of every spot of a batch."""
    lists = part.column("spots")
    return np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy()), lists.flatten()


def window_rows(bodies: DataFrame, rows: DataFrame, how: Windows) -> DataFrame:
    """(name, body, place, h1, h2, own_id): every window of ``bodies`` with its
    128-bit digest and the document of the body's first place."""
    schema = "name long, body long, place int, h1 long, h2 long, own_id long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in K.slices(whole, "own_text"):
                found = content(part.column("own_text"), how.units)
                owner, flat = spots_of(part)
                name, body, start, n = (flat.field(k).to_numpy() for k in ("name", "body", "start", "n"))
                row = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                hashes = found.digests(found.at[owner[row]] + start[row] + place, how.window)
                ids = part.column("own_id").take(pa.array(owner[row]))
                yield _batch({"name": name[row], "body": body[row], "place": place, "h1": hashes[:, 0], "h2": hashes[:, 1], "own_id": ids}, schema)

    return cut_bodies(bodies, rows, run, schema)


def with_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """``rows`` with ``runs``: the begin and end places of all runs of repeated
    windows in the text, one after another (null: none)."""
    by_doc = hits.groupBy("own_id", "own_key").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    return rows.alias("r").join(by_doc.alias("h"), same_document("r", "h"), "left").select("r.own_id", "r.own_text", "h.runs")


def covered(runs: pa.ListArray, at: np.ndarray, window: int) -> np.ndarray:
    """Which symbols of a batch the windows of ``runs`` cover."""
    owner = np.repeat(at[:-1], pc.fill_null(runs.value_lengths(), 0).to_numpy() // 2)
    flat = runs.flatten().to_numpy().reshape(-1, 2)
    edges = np.bincount(owner + flat[:, 0], minlength=at[-1] + 1) - np.bincount(owner + flat[:, 1] + window - 1, minlength=at[-1] + 1)
    return np.cumsum(edges)[:-1] > 0

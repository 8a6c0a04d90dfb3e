"""Removal of repeated word windows with a log-structured fingerprint index.

The index is a list of immutable runs, tables bucketed and sorted by anchor, and
the texts that they were made of.  Each batch of documents becomes a run; it is
merge-joined with the runs before it.  Where anchors agree but their
surroundings differ, the windows themselves are verified by 128-bit digests of
their words.  Runs of like size are compacted into one when there are too many.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from . import repeats, storage
from .batches import map_batches
from .repeats import Windows

WORDS = Windows("words", 50, 16)
RUN = "name long, body long, c long, own_id long, own_key long, start long, n int, lead int"
TEXT = "own_id long, own_key long, own_text string"


@dataclass
class FingerprintIndex:
    """A folder ``root`` in a shared store, by default a new one: ``runs`` of
    (name, body, c, own_id, own_key, start, n, lead), each a table of this
    session over a folder of its own, and ``texts``, tables of the indexed
    (own_id, own_key, own_text).

    An index is opened again by its ``root``, in any session; what a call that
    failed wrote half is not read.  One call writes at a time.  ``fanout``: runs
    of like size from which on they are merged, so that a row is rewritten a
    logarithmic number of times.  ``merges`` counts what this object merged.
    """

    spark: SparkSession
    root: str = ""
    buckets: int = 0
    fanout: int = 2
    merges: int = 0
    runs: dict[str, int] = field(default_factory=dict)
    texts: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = self.root or storage.new_path(self.spark, "index")
        for folder in storage.folders(self.spark, self.root):
            kind, buckets, token = folder.split("-")
            name = f"ridgeline_{kind}_{token}"
            clause = f"CLUSTERED BY (name) SORTED BY (name, body) INTO {buckets} BUCKETS" if kind == "run" else ""
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({RUN if kind == 'run' else TEXT}) USING parquet {clause} LOCATION '{self.root}/{folder}'")
            if kind == "run":
                self.runs[name] = self.spark.table(name).count()
            else:
                self.texts.append(name)

    def _write(self, rows: DataFrame, kind: str) -> str:
        token = uuid.uuid4().hex
        name, writer = f"ridgeline_{kind}_{token}", rows.write.option("path", f"{self.root}/{kind}-{self.buckets}-{token}")
        if kind == "run":
            writer = writer.bucketBy(self.buckets, "name").sortBy("name", "body")
        writer.saveAsTable(name)
        return name

    def keep(self, rows: DataFrame) -> DataFrame:
        """Write the texts of ``rows``; all texts that the index holds."""
        self.texts.append(self._write(rows.filter("own_id IS NOT NULL"), "texts"))
        return reduce(DataFrame.unionByName, map(self.spark.table, self.texts))

    def append(self, bodies: DataFrame) -> str:
        """Write one more run; ``bodies``: one row each, as ``repeats.merge_bodies`` has them."""
        name = self._write(bodies.repartition(self.buckets, "name"), "run")
        self.runs[name] = self.spark.table(name).count()
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(r) for r in self.runs]

    def _forget(self, name: str) -> None:
        """Drop a table and its folder."""
        kind, token = name.removeprefix("ridgeline_").split("_")
        for folder in storage.folders(self.spark, self.root):
            if folder.startswith(kind) and folder.endswith(token):
                storage.delete(self.spark, f"{self.root}/{folder}")
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def compact(self) -> None:
        """Merge ``fanout`` or more runs of like size: in order of their rows,
        each holds less than ``fanout`` times the one before."""
        tiers: list[list[str]] = []
        for name, rows in sorted(self.runs.items(), key=lambda r: r[1]):
            like = tiers and rows < self.fanout * max(self.runs[tiers[-1][-1]], 1)
            tiers = [*tiers[:-1], [*tiers[-1], name]] if like else [*tiers, [name]]
        for old in tiers:
            if len(old) >= self.fanout:
                self.append(repeats.merge_bodies(_united([self.spark.table(name) for name in old]), "c"))
                self.merges += 1
                for name in old:
                    del self.runs[name]
                    self._forget(name)

    def drop(self) -> None:
        """Delete all that the index wrote."""
        for name in [*self.runs, *self.texts]:
            self._forget(name)
        self.runs, self.texts = {}, []


def _united(runs: list[DataFrame]) -> DataFrame:
    """The rows of several runs.  A union of tables that are bucketed alike is
    taken by Spark 4.1.2 as bucketed too, while it lists their partitions one
    after another, so that a group over it falls apart; the bucket column is
    therefore computed anew, and groups are shuffled."""
    return reduce(DataFrame.unionByName, [r.withColumn("name", F.col("name").bitwiseXOR(F.lit(0))) for r in runs])


def _batch_hits(index: FingerprintIndex, batch: DataFrame, seen: DataFrame, how: Windows) -> DataFrame:
    """(own_id, own_key, runs): places of ``batch`` that repeat an earlier
    document's words."""
    earlier = index.tables()
    places = repeats.occurrences(batch, how)
    new = index.spark.table(index.append(repeats.merge_bodies(places)))
    names = new.select("name").distinct()
    alike = [run.join(names, "name", "left_semi") for run in earlier]
    known = _united([new.withColumn("is_new", F.lit(1))] + [a.withColumn("is_new", F.lit(0)) for a in alike])
    first = F.min(F.struct("own_id", "start", "own_key", "n", "lead")).alias("first")
    bodies = known.groupBy("name", "body").agg(F.sum("c").alias("c"), F.max("is_new").alias("is_new"), first)
    bodies = bodies.select("name", "body", "c", "is_new", "first.own_id", "first.own_key", "first.start", "first.n", "first.lead")
    bodies = storage.materialize(bodies, "batch-bodies") if earlier else bodies
    mixed = bodies.groupBy("name").agg(F.min("body").alias("low"), F.max("body").alias("high")).select("name", (F.col("low") != F.col("high")).alias("mixed"))
    mixed = storage.materialize(mixed, "batch-names")
    bodies = bodies.join(mixed, "name").filter((F.col("c") > 1) | F.col("mixed"))
    bodies = storage.materialize(bodies, "repeated-bodies")

    differ = bodies.filter("mixed")
    rows = storage.materialize(repeats.window_rows(differ, seen, how), "windows")
    firsts = rows.groupBy("h1", "h2").agg(F.min("own_id").alias("first_id"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    firsts = storage.materialize(firsts, "window-firsts")
    judged = rows.join(firsts, ["h1", "h2"]).groupBy("name", "body").agg(F.collect_list(F.struct("place", "first_id")).alias("found"))
    # A body's other copies repeat its first place, whatever its windows do elsewhere.
    judged = storage.materialize(judged, "judged-bodies")
    verdicts = bodies.filter("is_new = 1").select("name", "body", "mixed", F.col("own_id").alias("body_first")).join(judged, ["name", "body"], "left")
    verdicts = storage.materialize(verdicts, "verdicts")

    hits = places.join(verdicts, ["name", "body"])
    later = F.col("own_id") > F.col("body_first")
    hits = hits.filter(later | F.col("found").isNotNull())
    earliest = F.filter("found", lambda x: x["first_id"] < F.col("own_id"))
    single = F.flatten(F.transform(earliest, lambda x: F.array(F.col("start") + x["place"], F.col("start") + x["place"] + 1)))
    runs = F.when(later, F.array(F.col("start"), F.col("start") + F.col("n"))).otherwise(single)
    return hits.select("own_id", "own_key", runs.alias("runs")).filter("size(runs) > 0")


def _kept(rows: DataFrame, how: Windows, keep_text: bool) -> DataFrame:
    """Words kept and removed of (own_id, own_text, runs)."""
    schema = "own_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in K.slices(whole, "own_text"):
                found = repeats.content(part.column("own_text"), "words")
                gone = repeats.covered(part.column("runs"), found.at, how.window)
                size = (found.ends - found.begins + 1) * ~gone
                left = memoryview(np.frombuffer(found.data, np.uint8)[np.repeat(~gone, found.ends - found.begins + 1)])
                ends = np.concatenate([[0], np.cumsum(size)])[found.at].tolist()
                kept = [left[b : max(b, e - 1)] for b, e in zip(ends, ends[1:])]
                sums = np.concatenate([[0], np.cumsum(gone)])[found.at]
                digests = pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())
                texts = pa.array([str(x, "utf-8") if keep_text else None for x in kept], pa.string())
                arrays = [part.column("own_id"), pa.array(np.diff(found.at)), pa.array(np.diff(sums)), digests, texts]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in schema.split(", ")])

    return map_batches(rows, run, schema)


def remove_repeats(docs: DataFrame, batches: int = 3, how: Windows = WORDS, *, id_col: str = "doc_id", text_col: str = "text", index: FingerprintIndex | None = None, keep_text: bool = True) -> DataFrame:
    """Remove every word covered by a window whose words also start in a
    document with a smaller id.

    Documents enter the index in ``batches`` ranges of ids, the smaller ids
    first.  Returns ``id_col``, n_words, n_removed, kept_sha256, kept_text (kept
    words joined by one space; null without ``keep_text``).  Null and empty
    texts have no words; texts of any length are read whole.  Rows that share
    an id never repeat each other, so repeated rows and ties of ids are kept
    alike.  Rows with a null id, which is smaller than none, are kept whole
    and repeat nothing.  An empty table returns no rows.  Other columns are
    ignored.

    With ``index``, documents of earlier calls count too, and those of this
    call are added with their texts.  Results of earlier calls do not change.
    Without, an index is made for this call and its runs are dropped.
    """
    spark = docs.sparkSession
    rows = repeats.keyed(docs, id_col, text_col)
    known = rows.filter("own_id IS NOT NULL")
    # Before any run, so that a call that fails leaves no run without its texts.
    texts = index.keep(known) if index is not None else None
    held = index or FingerprintIndex(spark)
    cuts = known.approxQuantile("own_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *sorted({int(c) for c in cuts}), None]
    hits = None
    for low, high in zip(edges, edges[1:]):
        below = F.col("own_id") < high if high is not None else F.lit(True)
        batch = known.filter(below if low is None else below & (F.col("own_id") >= low))
        found = storage.materialize(_batch_hits(held, batch, known.filter(below) if texts is None else texts, how), "hits")
        hits = found if hits is None else hits.unionByName(found)
        if index is not None or high is not None:
            held.compact()
    if index is None:
        held.drop()
    return _kept(repeats.with_hits(rows, hits), how, keep_text).withColumnRenamed("own_id", id_col)


#: The same in DuckDB SQL, with the default parameters.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
hit AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS f FROM win GROUP BY h) USING (h) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, (SELECT unnest(range(0, 50)) AS k)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN left_over USING (doc_id)
"""

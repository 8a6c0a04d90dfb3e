"""Exact top-k by inner product with a paged M-tree.

Largest inner product is made smallest distance: with M the largest norm, a
vector x gets one more coordinate, sqrt(M^2 - |x|^2), and a query gets 0, so
that d(q, x)^2 = |q|^2 + M^2 - 2 q.x in a metric space.

The tree's top level is a bounded set of routing objects.  Every vector goes to
the nearest; a region's vectors are dealt over pages of bounded size, so that a
region that holds a third of all rows is many pages.  A page is a row: nodes
with their routing object, covering radius and distance to the page's routing
object, and entries with their distance to the node's.

Search is best first: each query is first held against its own region, which
bounds its k-th distance; then it visits only the regions that this bound
reaches.  Inside a page nodes are taken nearest first, and stored distances
skip nodes and entries by the triangle inequality before anything is computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .batches import map_batches
from ..session import ship_package

#: Slack for rounding: nothing within it of a bound is skipped.
SLACK = 1e-6
PAGE = "page string, region int, radius double, ids binary, vectors binary, routes binary, node_radius binary, node_parent binary, node_ends binary, entry_parent binary"


@dataclass(frozen=True)
class Tree:
    """``regions``: routing objects at the top, from a sample of ``sample``
    vectors.  ``page``: rows of a page, on average.  ``node``: entries of a
    node, on average.  ``block``: queries that meet a page at once."""

    regions: int = 128
    sample: int = 4096
    page: int = 1024
    node: int = 16
    block: int = 1024


def _dist(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def _spread(x: np.ndarray, most: int) -> np.ndarray:
    """Indices of up to ``most`` rows, each the farthest from those before."""
    chosen = [0]
    far = _dist(x, x[:1])[:, 0]
    while len(chosen) < min(most, len(x)):
        k = int(far.argmax())
        if far[k] <= SLACK:
            break
        chosen.append(k)
        far = np.minimum(far, _dist(x, x[k : k + 1])[:, 0])
    return np.array(chosen)


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of the vectors whose components are all finite."""
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    kept = rows.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(F.coalesce(finite, F.lit(False)))
    return kept.select(F.col(id_col).cast("long").alias("id"), scaled.alias("v"))


def _stack(column: pa.Array, dim: int) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]) if len(column) else np.zeros(1, np.int64)
    flat = column.flatten().to_numpy()
    if len(column) and (np.diff(ends) == dim).all():
        return flat.reshape(len(column), dim).astype(np.float64)
    out = np.zeros((len(column), dim))
    for k in range(len(column)):
        out[k, : ends[k + 1] - ends[k]] = flat[ends[k] : ends[k + 1]]
    return out


def build_pages(vectors: DataFrame, tops: np.ndarray, dim: int, top: float, how: Tree) -> tuple[DataFrame, dict[int, float]]:
    """The pages, and each region's covering radius."""
    shared = vectors.sparkSession.sparkContext.broadcast(tops)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _lifted(_stack(batch.column("v"), dim), top)
            far = _dist(x, shared.value)
            region = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("v"), pa.array(region.astype(np.int32)), pa.array(far[np.arange(len(x)), region])], names=["id", "v", "region", "parent"]
            )

    placed = storage.materialize(map_batches(vectors, assign, "id long, v array<double>, region int, parent double"), "placed")
    sizes = placed.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("parent").alias("radius")).collect()  # at most how.regions rows
    parts = F.create_map(*[F.lit(x) for r in sizes for x in (r["region"], -(-r["n"] // how.page))])
    page = F.concat_ws(":", F.col("region").cast("string"), F.pmod(F.xxhash64("id"), parts[F.col("region")]).cast("string"))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros((len(rows), dim))
        for k, own in enumerate(rows["v"]):
            v[k, : len(own)] = own
        x, region = _lifted(v, top), int(rows["region"].iloc[0])
        routes = x[_spread(x, max(1, len(x) // how.node))]
        near = _dist(x, routes)
        node = near.argmin(axis=1)
        order = np.lexsort((near[np.arange(len(x)), node], node))
        node, x, parent = node[order], x[order], near[order, node[order]]
        ends = np.searchsorted(node, np.arange(len(routes)), side="right")
        radius = np.array([parent[b:e].max() if e > b else 0.0 for b, e in zip(np.concatenate([[0], ends[:-1]]), ends)])
        up = _dist(routes, shared.value[region : region + 1])[:, 0]
        ids = rows["id"].to_numpy(dtype=np.int64)[order]
        packed = [ids, x[:, :dim], routes, radius, up, ends.astype(np.int64), parent]
        return pd.DataFrame([[rows["page"].iloc[0], region, float(rows["parent"].max()), *(np.ascontiguousarray(a).tobytes() for a in packed)]], columns=[f.split()[0] for f in PAGE.split(", ")])

    ship_package(vectors.sparkSession)
    pages = placed.withColumn("page", page).groupBy("page").applyInPandas(build, PAGE)
    return storage.materialize(pages, "pages"), {r["region"]: r["radius"] for r in sizes}


class PageSearch:
    """Best-first search of one page for a block of queries."""

    def __init__(self, page: dict, tops: np.ndarray, dim: int, top: float, k: int):
        self.ids = np.frombuffer(page["ids"], np.int64)
        self.x = np.frombuffer(page["vectors"], np.float64).reshape(-1, dim)
        self.routes = np.frombuffer(page["routes"], np.float64).reshape(-1, dim + 1)
        self.radius, self.up, self.parent = (np.frombuffer(page[c], np.float64) for c in ("node_radius", "node_parent", "entry_parent"))
        self.ends = np.frombuffer(page["node_ends"], np.int64)
        self.above, self.top, self.k = tops[page["region"]], top, k
        #: Pairs of a query and an entry whose score was computed.
        self.computed = 0

    def run(self, qid: np.ndarray, q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query index, id, score) of up to k best entries of each query within
        ``bound``, its k-th distance so far."""
        lifted = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        norms, bound = (q * q).sum(axis=1), bound.copy()
        above = _dist(lifted, self.above[None, :])[:, 0]
        best = np.full((len(q), 0), -np.inf)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # Without computing: a node cannot be nearer than its stored distances say.
        stored = np.abs(above[:, None] - self.up[None, :]) - self.radius[None, :]
        for node in np.argsort(stored.min(axis=0, initial=np.inf), kind="stable"):
            begin, end = (self.ends[node - 1] if node else 0), self.ends[node]
            rows = np.flatnonzero(stored[:, node] <= bound + SLACK)
            if end == begin or not len(rows):
                continue
            away = _dist(lifted[rows], self.routes[node : node + 1])[:, 0]
            near = away - self.radius[node] <= bound[rows] + SLACK
            rows, away = rows[near], away[near]
            if not len(rows):
                continue
            # Entries are in order of their stored distance: those within reach of any query are a slice.
            reach = bound[rows] + SLACK
            low = begin + np.searchsorted(self.parent[begin:end], (away - reach).min())
            high = begin + np.searchsorted(self.parent[begin:end], (away + reach).max(), side="right")
            if high <= low:
                continue
            score = q[rows] @ self.x[low:high].T
            self.computed += score.size
            distance = np.sqrt(np.maximum(norms[rows][:, None] + self.top - 2 * score, 0))
            keep = (distance <= reach[:, None]) & (self.ids[None, low:high] != qid[rows][:, None])
            r, c = np.nonzero(keep)
            found.append((rows[r], self.ids[low + c], score[r, c]))
            own = np.full((len(q), high - low), -np.inf)
            own[rows] = np.where(keep, score, -np.inf)
            best = np.concatenate([best, own], axis=1)
            if best.shape[1] > self.k:
                best = -np.partition(-best, self.k - 1, axis=1)[:, : self.k]
            if best.shape[1] == self.k:
                worst = best.min(axis=1)
                bound = np.minimum(bound, np.where(np.isfinite(worst), np.sqrt(np.maximum(norms + self.top - 2 * worst, 0)), np.inf))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        row, ids, score = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        first = np.searchsorted(row, np.arange(len(q)))
        keep = np.arange(len(row)) - first[row] < self.k
        return row[keep], ids[keep], score[keep]


def visit(visits: DataFrame, pages: DataFrame, tops, dim: int, top: float, k: int, counter: Accumulator | None = None) -> DataFrame:
    """Candidates of ``visits`` (region, query, v, bound, block) on all pages of
    their regions: query, id, score.

    A page is sent once to the task that reads it, and blocks of queries are
    sent to the page.
    """
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    homes = pages.select("page", "region")
    blocks = visits.join(homes, "region").repartition(tasks, "page").groupBy("page", "block").agg(F.collect_list(F.struct("query", "v", "bound")).alias("asked"))
    schema = "query long, id long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                page = {c: batch.column(c)[row].as_py() for c in batch.schema.names if c not in ("asked", "page", "block")}
                asked = batch.column("asked").slice(row, 1).flatten()
                qid, q, bound = asked.field("query").to_numpy(), _stack(asked.field("v"), dim), asked.field("bound").to_numpy()
                search = PageSearch(page, tops.value, dim, top, k)
                at, ids, score = search.run(qid, q, bound)
                if counter is not None:
                    counter.add(search.computed)
                yield pa.RecordBatch.from_arrays([pa.array(qid[at]), pa.array(ids), pa.array(score)], names=["query", "id", "score"])

    return map_batches(blocks.join(pages.repartition(tasks, "page"), "page"), run, schema)


def best(candidates: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return candidates.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(rows: DataFrame, asked: Column, k: int = 20, how: Tree = Tree(), *, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0, counter: Accumulator | None = None) -> DataFrame:
    """The ``k`` rows of largest integer inner product for every row that
    ``asked`` selects: query_id, rank, vec_id, score.

    Ties go to the smaller id.  A query is not its own candidate; rows of its
    id are its own.  Repeated rows count once; rows of one id with different
    vectors are each a candidate, and their queries share the id's ranks.  Rows with a null id, a null
    vector, or null or non-finite components take no part; shorter vectors are
    continued with zeros.  Fewer candidates than ``k`` give fewer rows; an empty
    table none.  Other columns are ignored.

    ``counter``, an accumulator of the caller, is raised by the pairs of query
    and entry that were computed (more where tasks ran twice).  How many that
    are depends on the data: bounds skip what lies in other clusters, and
    nothing where all vectors are about as far from each other.
    """
    spark = rows.sparkSession
    vectors = storage.materialize(integer_vectors(rows, id_col, vector_col, scale).dropDuplicates(), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(square).alias("top")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, top = int(facts["dim"]), float(facts["top"])
    # A bounded sample for the routing objects: how.sample rows.
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(how.sample).select("v").collect()
    padded = np.zeros((len(sample), dim))
    for at, r in enumerate(sample):
        padded[at, : len(r["v"])] = r["v"]
    lifted = _lifted(padded, top)
    tops = lifted[_spread(lifted, min(how.regions, max(1, facts["n"] // 256)))]
    pages, radii = build_pages(vectors, tops, dim, top, how)
    shared = spark.sparkContext.broadcast(tops)
    cover = np.array([radii.get(r, -np.inf) for r in range(len(tops))])

    queries = vectors.join(rows.filter(asked).select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Regions that a query's bound reaches; without a bound, its own."""
        for batch in batches:
            q = _stack(batch.column("v"), dim)
            bound = batch.column("bound").to_numpy(zero_copy_only=False)
            far = _dist(np.concatenate([q, np.zeros((len(q), 1))], axis=1), shared.value)
            least = np.where(np.isfinite(cover), far - cover, np.inf)
            home = np.where(np.isfinite(cover), far, np.inf).argmin(axis=1)
            own = np.zeros_like(far, dtype=bool)
            own[np.arange(len(q)), home] = True
            go = np.where(np.isnan(bound)[:, None], own, ~own & (least <= np.nan_to_num(bound, nan=np.inf)[:, None] + SLACK))
            at, region = np.nonzero(go)
            limits = np.where(np.isnan(bound), np.inf, bound)[at]
            cols = [batch.column("query").take(pa.array(at)), batch.column("v").take(pa.array(at)), pa.array(limits), pa.array(region.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["query", "v", "bound", "region"])

    def visits(asking: DataFrame) -> DataFrame:
        found = map_batches(asking.select("query", "v", "bound"), reached, "query long, v array<double>, bound double, region int")
        return found.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))

    asking = storage.materialize(queries.select(F.col("id").alias("query"), "v"), "queries").withColumn("bound", F.lit(float("nan")))
    blocks = max(1, -(-asking.count() // how.block))
    near = storage.materialize(best(visit(visits(asking), pages, shared, dim, top, k, counter), k).drop("rank"), "near")
    norms = asking.select("query", "v", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("q2"))
    full = near.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
    limit = F.when(F.col("n") == k, F.sqrt(F.greatest(F.col("q2") + top - 2 * F.col("worst"), F.lit(0.0)))).otherwise(float("inf"))
    bounded = norms.join(full, "query", "left").select("query", "v", limit.alias("bound"))
    rest = visit(visits(bounded), pages, shared, dim, top, k, counter)
    return best(near.union(rest), k).select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), F.col("score").cast("long").alias("score"))


#: The same in DuckDB SQL, with the default parameters and queries.
SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""

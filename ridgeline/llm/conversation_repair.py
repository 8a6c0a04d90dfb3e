"""Faults of conversations and the cheapest edits that give them a legal order.

Turns are sorted once over all conversations, which gives each a place; a
conversation's turns of 2^12 places are a chunk, so that one of any length is
many bounded groups.  A chunk is a string of symbols; the tables of
``repair_tables`` turn it into a map from the cost vector behind it to the one
before it.  Maps of a conversation's chunks are composed from the right, in a
tree whose groups are bounded as well, and the states at their starts from the
left.  With both, every chunk can be traced for itself.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage
from .batches import map_batches
from .repair_tables import INITIALS, STATES, Costs, tables
from ..session import ship_package

BLANKS = " \t\n\x0b\x0c\r"
ENDINGS = ".!?"
MAPS = "conv_id long, at long, before binary, leave binary"
SPOTS = "conv_id long, at long, behind int, state int, last boolean"
EDITS = "conv_id long, place long, step int, turn long, edit string, role string, text string, fault string"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
FAULTS = ("blank", "duplicate", "truncated")


@dataclass(frozen=True)
class Repair:
    """Prices of edits, and the bits of a place inside a chunk; as many chunks
    make a node of the tree."""

    costs: Costs = field(default_factory=Costs)
    chunk_bits: int = 12


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults set by crc32("conv_id:turn") % 20: 0 is dropped, 1 loses
    its text, 2 its sentence ends, 3 is repeated, 4 becomes the user's.  Nulls
    count as one space, but for the null conv_id and turn of a row, which stay."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    hit = F.crc32(name) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    text = F.when(hit == 1, "").when(hit == 2, F.translate(text, ENDINGS, "")).otherwise(text)
    one = F.struct("conv_id", "turn", F.when(hit == 4, "user").otherwise(role).alias("role"), text.alias("text"))
    return rows.filter(hit != 0).select(F.explode(F.when(hit == 3, F.array(one, one)).otherwise(F.array(one))).alias("row")).select("row.*")


def _symbol(role: Column, text: Column) -> Column:
    """The symbol of a turn that repeats none; see ``repair_tables``."""
    body = F.trim(text, F.lit(BLANKS))
    place = F.lit(len(INITIALS))
    for k, c in enumerate(INITIALS):
        place = F.when(F.substring(role, 1, 1) == c, k).otherwise(place)
    cut = (~F.substring(body, -1, 1).isin(*ENDINGS)).cast("int")
    return F.when(body == "", 0).otherwise(1 + 2 * place + cut)


def _sorted_turns(rows: DataFrame) -> DataFrame:
    """Turns in the order of (conv_id, turn, role, digest of the text), nulls
    first; ``place`` rises with it.  Equal rows are told apart by where they were
    read, so that many of them are many tasks' work too."""
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    same = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text")
    turns = turns.select("*", _symbol(F.col("role"), F.col("text")).alias("plain"), F.unhex(F.md5(same)).alias("same"), F.md5("text").alias("digest"), F.monotonically_increasing_id().alias("read"))
    ordered = turns.orderBy("conv_id", "turn", "role", "digest", "read").drop("digest", "read")
    return storage.materialize(ordered.withColumn("place", F.monotonically_increasing_id()), "turns")


def _chunks(turns: DataFrame, how: Repair) -> DataFrame:
    """(conv_id, at, symbols): a byte for each turn of a chunk, in order."""
    slim = turns.select("conv_id", "place", "same", "plain")
    # Only what repeats is joined back; a text that a third of the turns share is one row here.
    firsts = slim.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).filter("n > 1").select("same", "first")
    symbol = F.when(F.col("place") > F.col("first"), 0).otherwise(F.col("plain"))
    marked = slim.join(firsts, "same", "left").select("conv_id", F.shiftright("place", how.chunk_bits).alias("at"), F.struct("place", symbol.alias("symbol")).alias("turn"))
    grouped = marked.groupBy("conv_id", "at").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    digits = F.array_join(F.transform("turns", lambda t: t["symbol"].cast("string")), "")
    return storage.materialize(grouped.select("conv_id", "at", F.encode(digits, "US-ASCII").alias("symbols")), "chunks")


def _symbols(column: bytes) -> np.ndarray:
    return np.frombuffer(column, np.uint8) - ord("0")


def _maps(chunks: DataFrame, costs: Costs) -> DataFrame:
    """A chunk's map of vectors and states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables(costs)
        for batch in batches:
            found = [known.through(_symbols(s)) for s in batch.column("symbols").to_pylist()]
            cols = [batch.column("conv_id"), batch.column("at"), pa.array([f[0].astype(np.int16).tobytes() for f in found], pa.binary()), pa.array([f[2].astype(np.int8).tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "at", "before", "leave"])

    return map_batches(chunks, run, MAPS)


def _spots(maps: DataFrame, how: Repair) -> DataFrame:
    """For each chunk of (conv_id, at, before, leave): the vector ``behind`` it,
    the ``state`` at its start, and whether it is its conversation's last."""
    ship_package(maps.sparkSession)
    maps = storage.materialize(maps, "maps")
    parent = F.shiftright("at", how.chunk_bits)
    if maps.groupBy("conv_id").count().filter("count > 1").isEmpty():
        return maps.select("conv_id", "at", F.lit(0).alias("behind"), F.lit(0).alias("state"), F.lit(True).alias("last"))

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        before, leave = None, None
        for b, e in zip(reversed(rows["before"].tolist()), reversed(rows["leave"].tolist())):
            b, e = np.frombuffer(b, np.int16), np.frombuffer(e, np.int8).reshape(-1, STATES)
            if before is None:
                before, leave = b, e
            else:
                leave = np.take_along_axis(leave, e[before].astype(np.int64), axis=1)
                before = b[before]
        return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1], "at": rows["up"].iloc[:1], "before": [before.tobytes()], "leave": [leave.tobytes()]})

    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        v, behind = int(rows["up_behind"].iloc[0]), []
        for b in reversed(rows["before"].tolist()):
            behind.append(v)
            v = int(np.frombuffer(b, np.int16)[v])
        behind.reverse()
        q, states = int(rows["up_state"].iloc[0]), []
        for e, v in zip(rows["leave"].tolist(), behind):
            states.append(q)
            q = int(np.frombuffer(e, np.int8).reshape(-1, STATES)[v, q])
        last = [False] * (len(rows) - 1) + [bool(rows["up_last"].iloc[0])]
        return pd.DataFrame({"conv_id": rows["conv_id"], "at": rows["at"], "behind": behind, "state": states, "last": last})

    nodes = maps.withColumn("up", parent)
    above = _spots(nodes.groupBy("conv_id", "up").applyInPandas(compose, MAPS), how)
    above = above.select(F.col("conv_id").alias("up_conv"), F.col("at").alias("up_at"), F.col("behind").alias("up_behind"), F.col("state").alias("up_state"), F.col("last").alias("up_last"))
    joined = nodes.join(above, F.col("conv_id").eqNullSafe(F.col("up_conv")) & (F.col("up") == F.col("up_at")))
    return joined.groupBy("conv_id", "up").applyInPandas(spread, SPOTS)


def _stream(rows: DataFrame, how: Repair) -> DataFrame:
    """Turns of ``rows`` after a header for each chunk: (conv_id, at, place,
    kind, turn, role, text, plain, symbols, behind, state, last)."""
    turns = _sorted_turns(rows)
    chunks = _chunks(turns, how)
    many = chunks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("conv_id").alias("own"))
    split = chunks.join(many, F.col("conv_id").eqNullSafe(F.col("own")), "left_semi")
    spots = storage.materialize(_spots(_maps(split, how.costs), how), "spots")
    spots = spots.select(F.col("conv_id").alias("own"), F.col("at").alias("own_at"), "behind", "state", "last")
    # A conversation of one chunk starts with nothing and ends behind it.
    placed = chunks.join(spots, F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("at") == F.col("own_at")), "left")
    headers = placed.select(
        "conv_id", "at", F.shiftleft("at", how.chunk_bits).alias("place"), F.lit(0).alias("kind"), "symbols", F.coalesce("behind", F.lit(0)).alias("behind"), F.coalesce("state", F.lit(0)).alias("state"), F.coalesce("last", F.lit(True)).alias("last"),
    )
    body = turns.select("conv_id", F.shiftright("place", how.chunk_bits).alias("at"), "place", F.lit(1).alias("kind"), "turn", "role", "text", "plain")
    return headers.unionByName(body, allowMissingColumns=True)


class _Walk:
    """Turns of a sorted stream with their symbols and edits; only a chunk's are
    held at a time."""

    def __init__(self, costs: Costs):
        self.tables, self.ahead = tables(costs), deque()

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(kind, conv_id, place, turn, role, text, fault, edits)."""
        names = ("kind", "conv_id", "place", "turn", "role", "text", "plain", "symbols", "behind", "state", "last")
        for batch in batches:
            for kind, conv, place, turn, role, text, plain, symbols, behind, state, last in zip(*(batch.column(c).to_pylist() for c in names)):
                if kind == 0:
                    found = _symbols(symbols)
                    self.ahead.extend(zip(found.tolist(), self.tables.trace(found, behind, state, last)))
                elif kind == 1:
                    symbol, edits = self.ahead.popleft()
                    fault = (FAULTS[0] if not plain else FAULTS[1]) if not symbol else FAULTS[2] if symbol % 2 == 0 else None
                    yield kind, conv, place, turn, role, text, fault, edits
                else:
                    yield kind, conv, place, turn, role, text, None, ()


def repaired_turns(rows: DataFrame, how: Repair = Repair()) -> DataFrame:
    """The edits of all conversations: conv_id, place, step, turn, edit, role,
    text and the fault of the turn (null: none).

    Without the rows whose edit is D, and in the order of place and step, they
    are the repaired conversations.  Edits of one place are of one turn; inserted
    turns (I) have an empty text.  Chunks are traced apart, so a long
    conversation is the work of many tasks.  Nulls and ties as in
    ``repair_report``; ids without turns have no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _Walk(how.costs)

        def each():
            for batch in batches:
                out = []
                for _, conv, place, turn, role, text, fault, edits in walk.rows(iter([batch])):
                    for step, (letter, new) in enumerate(edits):
                        insert = letter == "I"
                        out.append((conv, place, step, None if insert else turn, letter, new or role, "" if insert else text, None if insert else fault))
                yield out

        for out in each():
            if out:
                columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in EDITS.split(", ")])

    return map_batches(_stream(rows, how).repartition("conv_id", "at").sortWithinPartitions("conv_id", "at", "kind", "place"), run, EDITS)


class _Report:
    """A conversation's figures, from its turns one after another."""

    def __init__(self, conv: int | None, costs: Costs):
        self.conv, self.costs = conv, costs
        self.counts, self.illegal, self.cost, self.audit = dict.fromkeys(FAULTS, 0), 0, 0, []
        self.least = self.most = self.seen = self.initial = None
        self.turns, self.empty, self.sha = 0, True, hashlib.sha256()

    def add(self, turn: int | None, role: str, text: str, fault: str | None, edits: list) -> None:
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.turns += turn != self.seen
            self.most = self.seen = turn
        self.illegal += self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        if fault:
            self.counts[fault] += 1
        for letter, new in edits:
            self.audit.append(letter)
            self.cost += {"I": self.costs.insert, "D": self.costs.delete, "R": self.costs.rerole}.get(letter, 0)
            if letter in "KR" and fault == FAULTS[2]:
                self.cost += self.costs.truncated
            if letter != "D":
                own = "" if letter == "I" else text
                self.sha.update((("" if self.empty else "\n") + f"{new or role}:{own}").encode())
                self.empty = False

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *(self.counts[f] for f in FAULTS), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def repair_report(rows: DataFrame, how: Repair = Repair(), every: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of every conversation of ``rows`` (conv_id, turn, role,
    text), and of ids that only ``every`` names.

    A null conv_id is a conversation; null turns come first and count for no
    gap; null roles and texts are one space.  Turns of one number are ordered by
    role and the MD5 of the text; rows equal in all are copies, the first of which is no
    duplicate.  A role is known by its first letter, kept as it is, and one of
    no known letter can only be changed or deleted.  No turns: zeros, an empty
    audit and the digest of nothing.  Other columns are ignored.

    A digest of one text is one task's work: a conversation's turns stream
    through one, which holds a chunk's edits and the audit so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Report | None = None
        names = [f.split()[0] for f in REPORT.split(", ")]
        kinds = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]

        def pack(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names=names)

        done: list[tuple] = []
        for kind, conv, _, turn, role, text, fault, edits in _Walk(how.costs).rows(batches):
            if now is None or now.conv != conv:
                if now is not None:
                    done.append(now.row())
                now = _Report(conv, how.costs)
                if len(done) >= 1000:
                    yield pack(done)
                    done = []
            if kind == 1:
                now.add(turn, role, text, fault, edits)
        if now is not None:
            done.append(now.row())
            yield pack(done)

    stream = _stream(rows, how)
    if every is not None:
        ids = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        stream = stream.unionByName(ids.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit(-1).alias("kind")), allowMissingColumns=True)
    return map_batches(stream.repartition("conv_id").sortWithinPartitions("conv_id", "place", "kind"), run, REPORT)


#: The same after ``damaged``, in DuckDB SQL.
SQL = r"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
hit AS (
  SELECT *, xor(list_reduce(list_transform(range(length(name)), lambda i: ord(substr(name, i::INT + 1, 1))::BIGINT),
    lambda c, b: list_reduce(range(8), lambda s, k: xor(s >> 1, (s & 1) * 3988292384), xor(c, b)), 4294967295::BIGINT), 4294967295) % 20 AS h FROM named),
rows AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
    trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS initial FROM rows),
turns AS (
  SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate FROM placed),
marked AS (
  SELECT *, NOT blank AND NOT duplicate AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM turns),
inserts(q, q2, letters, price, added) AS (VALUES
  (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 2, chr(10) || 'user:'), (1, 2, 'I', 2, chr(10) || 'user:'), (3, 2, 'I', 2, chr(10) || 'user:'),
  (2, 3, 'I', 2, chr(10) || 'assistant:'), (0, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:')),
uses(q, q2, letter, initial, role, price) AS (VALUES
  (0, 0, 'D', NULL, NULL, 3), (1, 1, 'D', NULL, NULL, 3), (2, 2, 'D', NULL, NULL, 3), (3, 3, 'D', NULL, NULL, 3),
  (0, 1, 'K', 's', NULL, 0), (0, 2, 'K', 'u', NULL, 0), (1, 2, 'K', 'u', NULL, 0), (2, 3, 'K', 'a', NULL, 0), (3, 2, 'K', 'u', NULL, 0),
  (0, 2, 'R', NULL, 'user', 2), (1, 2, 'R', NULL, 'user', 2), (2, 3, 'R', NULL, 'assistant', 2), (3, 2, 'R', NULL, 'user', 2)),
steps AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit, '' AS body FROM conversations
  UNION ALL
  SELECT conv_id, i, q, cost, audit, body FROM (
    SELECT m.conv_id, m.i, u.q2 AS q, s.cost + n.price + u.price + CASE WHEN m.truncated AND u.letter <> 'D' THEN 1 ELSE 0 END AS cost, s.audit || n.letters || u.letter AS audit,
      s.body || n.added || CASE WHEN u.letter = 'D' THEN '' ELSE chr(10) || coalesce(u.role, m.role) || ':' || m.text END AS body
    FROM steps s JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.i = s.i + 1 JOIN inserts n ON n.q = s.q
    JOIN uses u ON u.q = n.q2 AND (u.letter = 'D' OR NOT (m.blank OR m.duplicate) AND (u.letter = 'R' OR u.initial = m.initial)))
  QUALIFY row_number() OVER (PARTITION BY conv_id, i, q ORDER BY cost, audit) = 1),
ends AS (
  SELECT s.conv_id, s.cost + n.price AS cost, s.audit || n.letters AS audit, s.body || n.added AS body
  FROM (SELECT *, max(i) OVER (PARTITION BY conv_id) AS top FROM steps) s JOIN inserts n ON n.q = s.q WHERE s.i = s.top AND n.q2 IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + n.price, s.audit || n.letters) = 1),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
    count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM marked GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, e.cost::BIGINT AS cost, e.audit, sha256(substr(e.body, 2)) AS repaired_sha256
FROM ends e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""

"""Sequences of events of one key within a time, found on a stream.

An event of the last step is held, with those of the earlier steps, until the
watermark passes it: from then on nothing that could precede it is accepted any
more, so what is found does not depend on the order in which rows came, nor on
how they were cut into batches, as long as none is later than allowed.  Its
event-time timer then closes it.  Spark drops rows behind the watermark of the
batch before; ``LateRows`` counts them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from . import run_to_end
from ..session import ship_package

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


Event = tuple[int, int, int]


@dataclass(frozen=True)
class Steps:
    """Event types in their order; the first and the last event are at most
    ``seconds`` apart.  Rows may be ``late_seconds`` behind the latest one."""

    types: tuple[str, ...] = ("view", "click", "purchase")
    seconds: int = 3600
    late_seconds: int = 3600


def chains(events: Iterable[Event], steps: int, micros: int) -> Iterator[list[Event]]:
    """For each event (time, id, step) of the last step, in their order, those that
    lead to it: each the latest of its step before the next one.  None where one
    is missing or the first is too far back; no other choice could be nearer.
    One pass over the events in order, however many of them are last steps."""
    nearest: list[list[Event] | None] = [None] * steps
    # Of one time and id, none precedes another: later steps are taken first.
    for event in sorted(events, key=lambda e: (e[0], e[1], -e[2])):
        before = nearest[event[2] - 1] if event[2] else []
        if before is None:
            continue
        nearest[event[2]] = [*before, event]
        if event[2] == steps - 1 and event[0] - nearest[-1][0][0] <= micros:
            yield nearest[-1]


def chain(events: Iterable[Event], last: Event, steps: int, micros: int) -> list[Event] | None:
    """The one of ``chains`` that leads to ``last``, or None."""
    before = [e for e in events if e[:2] < last[:2] and e[2] < steps - 1]
    return next(chains([*before, last], steps, micros), None)


class _Matcher(StatefulProcessor):
    """A key's events, as far back as a later last step may need them.

    Each call to the state and its timers is a message to the executor, so the
    rows of a batch are one value, and a key has one timer for all that the
    watermark passed, not one for each event.
    """

    def __init__(self, steps: Steps):
        self.last, self.micros = len(steps.types) - 1, steps.seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "packed binary")

    def _keep(self, events: list[Event]) -> None:
        """Sets the timer of ``events``: the first last step's time, or when none of them has a use any more."""
        ends = [e[0] for e in events if e[2] == self.last]
        self.handle.registerTimer(-(-min(ends) // 1000) if ends else -(-(max(e[0] for e in events) + self.micros) // 1000) + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = [(at, own, step) for _, _, at, own, step in rows]
        self.events.appendValue((_packed(fresh),))
        self._keep(fresh)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # A batch may pass many last steps of a key; its first timer closes them all.
        until = timerValues.getCurrentWatermarkInMs() * 1000
        events = [e for (packed,) in self.events.get() for e in _unpacked(packed)]
        for found in chains((e for e in events if e[0] <= until), self.last + 1, self.micros):
            yield Row(key=key[0], ids=[e[1] for e in found], first=found[0][0], last=found[-1][0])
        kept = [e for e in events if e[0] > until or (e[2] != self.last and e[0] >= until - self.micros)]
        if kept:
            self.events.put([(_packed(kept),)])
            self._keep(kept)
        else:
            self.events.clear()

    def close(self) -> None:
        pass


def _packed(events: list[Event]) -> bytes:
    return np.array(events, dtype="<i8").tobytes()


def _unpacked(packed: bytes) -> list[Event]:
    return [tuple(e) for e in np.frombuffer(packed, dtype="<i8").reshape(-1, 3).tolist()]


class LateRows(StreamingQueryListener):
    """Rows that came behind the watermark, by query; add it to
    ``spark.streams`` before the query starts."""

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:
        self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        own = str(event.progress.id)
        self.dropped[own] = self.dropped.get(own, 0) + sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def sequences(events: DataFrame, steps: Steps = Steps(), *, key: str = "user_id", id_col: str = "event_id", type_col: str = "event_type", time: str = "ts") -> DataFrame:
    """key, ids, first, last (microseconds) of each closed sequence of a stream.

    Events of one time are in the order of their ids.  An event may be part of
    several sequences, but ends at most one: the nearest.  Rows with a null key,
    id, type or time, and of other types, take no part.  A key's state goes back
    as far as ``seconds`` and ``late_seconds``; a key is one task's work.
    """
    ship_package(events.sparkSession)
    step = F.array_position(F.array(*[F.lit(t) for t in steps.types]), F.col(type_col))
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(time).cast("timestamp").alias("ts"), F.col(id_col).cast("long").alias("id"), (step.cast("int") - 1).alias("step"))
    rows = rows.filter("key IS NOT NULL AND ts IS NOT NULL AND id IS NOT NULL AND step >= 0").withWatermark("ts", f"{steps.late_seconds} seconds")
    rows = rows.select("key", "ts", F.unix_micros("ts").alias("at"), "id", "step")
    return rows.groupBy("key").transformWithState(_Matcher(steps), "key long, ids array<long>, first long, last long", "Append", "EventTime")


def closed_sequences(spark: SparkSession, events: DataFrame, steps: Steps = Steps(), path: str | None = None, **columns: str) -> DataFrame:
    """Run ``sequences`` over what a stream's source holds and read the result.
    With a ``path`` a later call goes on where the last one ended."""
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        return run_to_end(spark, sequences(events, steps, **columns), "sequences", path)
    finally:
        spark.conf.set(_STORE, before)

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql.streaming import StreamingQueryListener

from ridgeline.streaming.patterns import LateRows, Steps, chain, chains, closed_sequences

START = datetime(2024, 1, 1)
SCHEMA = "user_id long, event_id long, event_type string, ts timestamp_ntz"
STEPS = Steps(("view", "click", "purchase"), seconds=600, late_seconds=300)


def by_hand(rows, steps=STEPS):
    """Closed sequences by trying every triple and taking the latest one."""
    until = max(r[3] for r in rows) - timedelta(seconds=steps.late_seconds)
    out = set()
    for user, own, kind, ts in rows:
        if kind != steps.types[-1] or ts > until:
            continue
        triples = [
            ((c[3], c[1]), (v[3], v[1])) for c in rows if c[0] == user and c[2] == steps.types[1] and (c[3], c[1]) < (ts, own)
            for v in rows if v[0] == user and v[2] == steps.types[0] and (v[3], v[1]) < (c[3], c[1])
        ]
        if triples:
            click, view = max(triples)
            if ts - view[0] <= timedelta(seconds=steps.seconds):
                out.add((user, view[1], click[1], own))
    return out


def made(seed, n, users=4):
    rng = random.Random(seed)
    return [(rng.randrange(users), k, rng.choice(["view", "click", "purchase", "error"]), START + timedelta(seconds=20 * (k // 2), microseconds=rng.choice([0, 1, 999_999]))) for k in range(n)]


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def put(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{number:03d}")
    time.sleep(1.1)  # files are read in the order of their times


def found(df):
    return {(r.key, *r.ids) for r in df.collect()}


def test_rows_out_of_order_and_a_restart(spark, tmp_path):
    rows = made(1, 240)
    # Up to 100 seconds behind: within what the watermark allows.
    sent = sorted(rows, key=lambda r: (r[3] + timedelta(seconds=random.Random(r[1]).randrange(100)), r[1]))
    put(spark, f"{tmp_path}/in", 0, sent[:80])
    put(spark, f"{tmp_path}/in", 1, sent[80:150])
    first = found(closed_sequences(spark, stream(spark, f"{tmp_path}/in"), STEPS, f"file://{tmp_path}/out"))
    assert first == by_hand(sent[:150])
    put(spark, f"{tmp_path}/in", 2, sent[150:] + [(None, 1, "view", START), (1, None, "view", START + timedelta(days=1))])
    second = closed_sequences(spark, stream(spark, f"{tmp_path}/in"), STEPS, f"file://{tmp_path}/out")
    assert found(second) == by_hand(rows) > first and second.count() == len(by_hand(rows))


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    rows = [(1, 1, "view", START), (1, 2, "click", START + timedelta(seconds=5)), (2, 3, "error", START)]
    put(spark, f"{tmp_path}/in", 0, rows)
    put(spark, f"{tmp_path}/in", 1, [(1, 4, "view", START + timedelta(days=1))])
    # A batch drops what is older than the watermark of the batch before it.
    put(spark, f"{tmp_path}/in", 2, [(2, 9, "view", START + timedelta(days=1))])
    put(spark, f"{tmp_path}/in", 3, [(1, 5, "purchase", START + timedelta(seconds=9)), (1, 6, "click", START + timedelta(days=1, seconds=1))])
    put(spark, f"{tmp_path}/in", 4, [(1, 7, "purchase", START + timedelta(days=1, seconds=2)), (9, 8, "view", START + timedelta(days=3))])
    late = LateRows()
    spark.streams.addListener(late)
    try:
        got = found(closed_sequences(spark, stream(spark, f"{tmp_path}/in"), STEPS))
        for _ in range(50):
            if sum(late.dropped.values()):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(late)
    assert got == {(1, 4, 6, 7)} and sum(late.dropped.values()) == 1


class Timers(StreamingQueryListener):
    """Timers that each batch registered."""

    def __init__(self):
        self.registered = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.registered[event.progress.batchId] = sum(o.customMetrics["numRegisteredTimers"] for o in event.progress.stateOperators)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def test_a_key_of_a_batch_has_one_timer(spark, tmp_path):
    rows = made(2, 600, 3)
    # The second batch passes only some of the first one's purchases; what is due later stays and is found then.
    put(spark, f"{tmp_path}/in", 0, rows[:300])
    put(spark, f"{tmp_path}/in", 1, rows[300:])
    # Two batches later the keys are empty: timers that are left find nothing.
    put(spark, f"{tmp_path}/in", 2, [(9, 9_000, "view", START + timedelta(days=1))])
    put(spark, f"{tmp_path}/in", 3, [(9, 9_001, "view", START + timedelta(days=2))])
    timers = Timers()
    spark.streams.addListener(timers)
    try:
        got = closed_sequences(spark, stream(spark, f"{tmp_path}/in"), STEPS)
        for _ in range(50):
            if len(timers.registered) >= 4:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(timers)
    want = by_hand(rows + [(9, 9_001, "view", START + timedelta(days=2))])
    assert found(got) == want and got.count() == len(want) > 100
    # One for a key's rows of a batch and at most one for what each timer leaves, not one for each of 150 purchases.
    assert timers.registered[0] == 3 and max(timers.registered.values()) <= 8


def test_many_last_steps_are_one_pass():
    events = [(2 * k, k, k % 3) for k in range(300_000)]
    found_ = list(chains(reversed(events), 3, 100))
    assert len(found_) == 100_000 and found_[-1] == events[-3:]
    # Of one time and id, none precedes another.
    assert list(chains([(1, 1, 0), (1, 1, 1), (2, 1, 2), (2, 2, 1), (2, 3, 2)], 3, 100)) == [[(1, 1, 0), (2, 2, 1), (2, 3, 2)]]


@pytest.mark.parametrize("seed", range(6))
def test_the_nearest_chain_is_found_if_any_is(seed):
    rows = made(seed, 60, 1)
    kinds = {t: k for k, t in enumerate(STEPS.types)}
    events = [(int((r[3] - START) / timedelta(microseconds=1)), r[1], kinds[r[2]]) for r in rows if r[2] in kinds]
    got = {(0, *(e[1] for e in c)) for end in events if end[2] == 2 and (c := chain(events, end, 3, 600_000_000))}
    assert got == by_hand(rows + [(1, 999, "error", START + timedelta(days=9))])

import random
from datetime import datetime, timedelta

import pytest

from ridgeline.sources.history import History

DAY = timedelta(days=1)
START = datetime(2024, 1, 1)
SCHEMA = "k long, valid_from timestamp, v string, w int"


class Plain:
    """The same by a dictionary of points for each recorded time."""

    def __init__(self):
        self.states = []

    def merge(self, changes, at):
        points = dict(self.states[-1][1]) if self.states else {}
        new = {}
        for k, valid, v, w in changes:
            if k is not None and valid is not None:
                new[k, valid] = max(new.get((k, valid), (v, w)), (v, w), key=lambda p: (p[0] is not None, p[0] or "", p[1] is not None, p[1] or 0))
        self.states.append((at, points | new))

    def as_of(self, valid, known):
        points = [p for at, p in self.states if at <= known][-1]
        out = {}
        for (k, since), values in sorted(points.items()):
            if since <= valid:
                out[k] = (*values, since)
        return out


def changes_of(seed, n):
    rng = random.Random(seed)
    return [(rng.choice([1, 2, 3, 4, 5, 6, None]), START + DAY * rng.randrange(20) if rng.random() > 0.05 else None, rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for _ in range(n)]


def read(history, valid, known=None):
    found = history.as_of(valid, known).collect()
    assert len({r.k for r in found}) == len(found)
    return {r.k: (r.v, r.w, r.valid_from) for r in found}


@pytest.fixture
def history(spark, tmp_path):
    return History(spark, f"file://{tmp_path}/h", ["k"], ["v", "w"], buckets=4)


def files(tmp_path):
    return {str(f.relative_to(tmp_path)) for f in (tmp_path / "h").rglob("*.parquet")}


def test_as_of_reads_equal_brute_force(spark, history):
    plain = Plain()
    for load in range(4):
        made = changes_of(load, 14)
        history.merge(spark.createDataFrame(made, SCHEMA), START + 100 * DAY + load * DAY)
        plain.merge(made, START + 100 * DAY + load * DAY)
    for load in range(4):
        for valid in (START - DAY, START + 3 * DAY, START + 11 * DAY, START + 60 * DAY):
            known = START + 100 * DAY + load * DAY + DAY / 2
            assert read(history, valid, known) == plain.as_of(valid, known)
    assert read(history, START + 9 * DAY) == plain.as_of(START + 9 * DAY, START + 200 * DAY)
    rows = history.read().collect()
    assert not [r for r in rows if r.recorded_to is not None and r.recorded_to <= r.recorded_from]


def test_a_merge_run_again_writes_nothing(spark, history, tmp_path):
    made = spark.createDataFrame(changes_of(7, 20), SCHEMA)
    assert history.merge(made, START)
    before = files(tmp_path)
    assert history.merge(made, START) == [] and history.merge(made, START + DAY) == [] and files(tmp_path) == before


def test_untouched_files_keep_their_names(spark, history, tmp_path):
    history.merge(spark.createDataFrame([(k, START, "a", 1) for k in range(30)], SCHEMA), START)
    before = files(tmp_path)
    assert len(before) == 4
    touched = history.merge(spark.createDataFrame([(7, START + DAY, "b", 2), (8, START, "a", 1)], SCHEMA), START + DAY)
    after = files(tmp_path)
    assert len(touched) == 1 and len(before & after) == 3 and all(f"bucket_={touched[0]}/" in f for f in before ^ after)
    assert read(history, START + 2 * DAY)[7] == ("b", 2, START + DAY) and read(history, START + 2 * DAY, START)[7] == ("a", 1, START)


def test_corrections_within_one_recorded_time_and_refusals(spark, history):
    history.merge(spark.createDataFrame([(1, START, "a", 1)], SCHEMA), START + DAY)
    history.merge(spark.createDataFrame([(1, START, "b", 1)], SCHEMA), START + DAY)
    assert read(history, START) == {1: ("b", 1, START)} and history.read().count() == 1
    with pytest.raises(ValueError):
        history.merge(spark.createDataFrame([(1, START, "c", 1)], SCHEMA), START)
    assert history.merge(spark.createDataFrame([], SCHEMA), START + 2 * DAY) == []


def test_without_a_merge_there_is_nothing_to_read(spark, history):
    with pytest.raises(ValueError):
        history.as_of(START)
    assert history.merge(spark.createDataFrame([(None, START, "a", 1)], SCHEMA), START) == [] and history.read() is None

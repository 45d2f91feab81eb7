"""Streams in event time: windows, timers, late rows, restarts."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from lectern.session import scratch_path
from lectern.streaming import eventtime, rollups
from tests.lms import event, tables

START = 1704690000  # 2024-01-08 00:00 in Bogota
DAY = 86400
DELAY = 2 * DAY


def _batches():
    """Three arrivals out of order within the delay; the last two also bring rows behind the watermark."""
    rng = random.Random(3)
    rows = []
    for n in range(240):
        at = START + rng.randrange(9 * DAY)
        user = 1 if rng.random() < 0.4 else rng.randint(2, 5)
        rows.append(event(n, user, rng.choice([2, 3]), at, contextlevel=70, contextinstanceid=rng.choice([None, 9, 10]), target=rng.choice(["course", "module"])))
    rows += [dict(rows[k], id=1000 + k) for k in range(10)]  # ties
    first = [r for r in rows if r["timecreated"] < START + 4 * DAY]
    second = [r for r in rows if START + 4 * DAY <= r["timecreated"] < START + 6 * DAY]
    third = [r for r in rows if r["timecreated"] >= START + 6 * DAY]
    # Within the delay: a day late. Behind it: four days late.
    second += [r for r in first if START + 3 * DAY <= r["timecreated"] and r["id"] % 4 == 0]
    third += [r for r in first if r["timecreated"] < START + 2 * DAY and r["id"] % 5 == 0]
    first = [r for r in first if r not in second and r not in third]
    end = [event(5000, 1, 2, START + 13 * DAY)]  # moves the watermark past everything before
    return [first, second, third, end]


def _arrive(spark, folder, rows):
    tables(spark, mdl_logstore_standard_log=rows).log.coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture(scope="module")
def streamed(spark, settings):
    """The three tables after four runs with a stop between each, before and after late rows are brought in."""
    folder = scratch_path(spark, "arriving")
    arrivals = eventtime.Arrivals(spark, scratch_path(spark, "arrivals"), DELAY)
    store = rollups.Store(spark, scratch_path(spark, "tables"))
    seen, staged = [], []
    for rows in _batches():
        _arrive(spark, folder, rows)
        seen += rows
        log = spark.readStream.schema(tables(spark).log.schema).parquet(folder)
        eventtime.run(log, settings, arrivals, store, tuple(eventtime.RUNS))
        staged.append(spark.read.parquet(arrivals.path("staged")).count())
    t = tables(spark, mdl_logstore_standard_log=seen)
    before = {job: store.read(job).collect() for job in eventtime.RUNS}
    for _ in range(2):
        for job in eventtime.RUNS:
            eventtime.repair(t, settings, arrivals, store, job)
    after = {job: store.read(job).collect() for job in eventtime.RUNS}
    return t, arrivals, before, after, staged


def _want(rows, columns):
    return sorted(tuple(str(r[c]) for c in columns) for r in rows)


def _closed(df):
    """Days that the watermark has passed: all but the one of the last event."""
    return df.filter(F.col("fecha") < "2024-01-19")


def _late_ids(spark, arrivals):
    return {r.id for r in arrivals.late().collect()}


def test_late_rows_are_those_behind_the_watermark(spark, settings, streamed):
    _, arrivals, _, _, _ = streamed
    limit, late = None, set()
    for rows in _batches():
        late |= {r["id"] for r in rows if limit is not None and r["timecreated"] <= limit}
        limit = max([limit or 0, *(r["timecreated"] - DELAY for r in rows)])
    assert late and _late_ids(spark, arrivals) == late


@pytest.mark.parametrize("job", ["login_day", "traffic_hour"])
def test_stream_equals_batch_of_staged_rows_and_after_repair_of_all(spark, settings, streamed, job):
    t, arrivals, before, after, _ = streamed
    columns = [c for c in rollups.BUILDERS[job](t, settings).columns]
    late = _late_ids(spark, arrivals)
    on_time = rollups._with_log(t, t.log.filter(~F.col("id").isin(*late)))
    want = _closed(rollups.BUILDERS[job](on_time, settings)).collect()
    assert _want(before[job], columns) == _want(want, columns)
    want = _closed(rollups.BUILDERS[job](t, settings)).collect()
    assert _want(after[job], columns) == _want(want, columns)


def test_time_on_task_equals_batch_for_rows_out_of_order(spark, settings, streamed):
    t, arrivals, before, after, _ = streamed
    keys = ["fecha", "userid", "courseid", "modulo"]

    def sums(rows):
        found = {}
        for r in rows:
            key = tuple(str(r[c]) for c in keys)
            found[key] = found.get(key, 0) + r.segundos
        return found

    late = _late_ids(spark, arrivals)
    on_time = rollups._with_log(t, t.log.filter(~F.col("id").isin(*late)))
    assert sums(before["instance_time_day"]) == sums(_closed(rollups.instance_time_day(on_time, settings)).collect())
    assert sums(after["instance_time_day"]) == sums(_closed(rollups.instance_time_day(t, settings)).collect())


def test_state_shrinks_when_the_watermark_passes(spark, settings):
    folder, arrivals = scratch_path(spark, "arriving"), eventtime.Arrivals(spark, scratch_path(spark, "arrivals"), 3600)
    store = rollups.Store(spark, scratch_path(spark, "tables"))
    held = []
    for n, rows in enumerate([[event(i, i, 2, START + i) for i in range(1, 60)], [event(100, 1, 2, START + DAY)], [event(101, 1, 2, START + 2 * DAY)]]):
        _arrive(spark, folder, rows)
        eventtime.receive(spark.readStream.schema(tables(spark).log.schema).parquet(folder), settings, arrivals)
        query = eventtime.run_traffic_hour(arrivals, store)
        held.append(max(sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress[-1:]))
    assert held[0] >= 59 and held[-1] < 10
    assert store.read("traffic_hour").filter(F.col("fecha") == "2024-01-08").agg(F.sum("usuarios_unicos")).first()[0] == 59


def test_a_batch_that_runs_again_changes_nothing(spark, settings):
    arrivals = eventtime.Arrivals(spark, scratch_path(spark, "arrivals"), DELAY)
    rows = eventtime.shaped(tables(spark, mdl_logstore_standard_log=[event(1, 5, 2, START), event(2, None, 2, START), event(3, 5, None, START)]).log, settings)
    for _ in range(2):
        arrivals.take(rows, 0)
    assert spark.read.parquet(arrivals.path("staged")).count() == 1
    assert arrivals.late().count() == 0 and arrivals.newest(0) is None and arrivals.newest(1) is not None
    store = rollups.Store(spark, scratch_path(spark, "tables"))
    each = eventtime._added(store, "login_day")
    day = eventtime.login_days(spark.read.parquet(arrivals.path("staged")))
    each(day, 0)
    each(day, 0)
    assert [r.ingresos for r in store.read("login_day").collect()] == [1]


def test_the_delay_covers_an_hour(spark):
    with pytest.raises(ValueError):
        eventtime.Arrivals(spark, "/nowhere", timedelta(minutes=5).seconds)


class _State:
    """A list state that counts what is asked of it."""

    def __init__(self, calls):
        self.rows, self.calls = [], calls

    def get(self):
        self.calls.append("get")
        return iter(self.rows)

    def appendValue(self, row):
        self.calls.append("append")
        self.rows = [*self.rows, row]

    def put(self, rows):
        self.calls.append("put")
        self.rows = list(rows)

    def clear(self):
        self.calls.append("clear")
        self.rows = []


class _Handle:
    def __init__(self):
        self.calls, self.timers, self.states = [], set(), {}

    def getListState(self, name, schema):
        return self.states.setdefault(name, _State(self.calls))

    def registerTimer(self, when):
        self.calls.append("timer")
        self.timers.add(when)


def test_calls_to_the_state_store_do_not_grow_with_pairs():
    import pandas as pd

    class Clock:
        def __init__(self, passed):
            self.getCurrentWatermarkInMs = lambda: passed

    def run(pairs):
        rng = random.Random(7)
        rows = [(n, rng.randrange(pairs), 2, rng.choice([None, 9]), rng.randrange(3 * DAY)) for n in range(4 * pairs)]
        frame = pd.DataFrame(rows, columns=["id", "userid", "courseid", "contextinstanceid", "timecreated"])
        frame["at"] = pd.to_datetime(frame["timecreated"], unit="s")
        handle, found = _Handle(), {}
        for part, passed in ((frame[frame["timecreated"] < 2 * DAY], DAY + DAY // 2), (frame[frame["timecreated"] >= 2 * DAY], 5 * DAY)):
            machine = eventtime.GapMachine()  # a new one for each micro-batch, as in a task
            machine.init(handle)
            assert not list(machine.handleInputRows((0,), iter([part]), Clock(0)))
            for _ in sorted(t for t in handle.timers if t <= passed * 1000):
                for out in machine.handleExpiredTimer((0,), Clock(passed * 1000), None):
                    for r in out.itertuples():
                        key = (str(r.fecha), r.userid, None if pd.isna(r.modulo) else r.modulo)
                        found[key] = found.get(key, 0) + r.segundos
        want = {}
        rows.sort(key=lambda r: (r[1], r[4], r[0]))
        for r, then in zip(rows, [*rows[1:], None]):
            same = then is not None and then[1] == r[1] and then[4] // DAY == r[4] // DAY
            key = (f"1970-01-0{1 + r[4] // DAY}", r[1], r[3])
            want[key] = want.get(key, 0) + (min(1800, then[4] - r[4]) if same else 0)
        assert found == want
        assert not any(s.rows for s in handle.states.values())
        return len(handle.calls)

    assert run(2000) == run(20) < 40

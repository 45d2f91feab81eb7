"""Summary tables: job, backfill, late data, streaming."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lectern.operators import access
from lectern.session import scratch_path
from lectern.streaming import rollups, streams
from tests.lms import event, tables

MIDNIGHT = 1704690000  # 2024-01-08 00:00 in Bogota


def _store(spark):
    return rollups.Store(spark, scratch_path(spark, "store"))


def test_months_cover_the_range():
    got = list(rollups.months(date(2023, 12, 15), date(2024, 2, 3)))
    assert got == [
        (date(2023, 12, 15), date(2023, 12, 31)),
        (date(2024, 1, 1), date(2024, 1, 31)),
        (date(2024, 2, 1), date(2024, 2, 3)),
    ]


def test_day_ranges_group_consecutive_days():
    days = [date(2024, 1, d) for d in (1, 2, 3, 7, 9, 10)]
    got = [(a.day, b.day) for a, b in rollups.day_ranges(days)]
    assert got == [(1, 3), (7, 7), (9, 10)]
    assert list(rollups.day_ranges([])) == []


def test_days_split_at_local_midnight(spark, settings):
    t = tables(spark, mdl_logstore_standard_log=[event(1, 5, 2, MIDNIGHT - 1), event(2, 5, 2, MIDNIGHT)])
    days = sorted(str(r.fecha) for r in rollups.login_day(t, settings).collect())
    assert days == ["2024-01-07", "2024-01-08"]


def test_daily_job_is_idempotent_and_repairs_late_days(spark, settings):
    store = _store(spark)
    first = [event(n, 5, 2, MIDNIGHT + n * 3600) for n in range(60)]
    t = tables(spark, mdl_logstore_standard_log=first)
    rollups.run_daily(t, settings, store, "login_day", date(2024, 1, 10), date(2024, 1, 1))
    assert store.last_full_date("login_day") == date(2024, 1, 9)
    late = [*first, event(100, 6, 2, MIDNIGHT + 5), event(101, 6, 2, MIDNIGHT + 90000)]
    t = tables(spark, mdl_logstore_standard_log=late)
    for _ in range(2):
        rollups.run_daily(t, settings, store, "login_day", date(2024, 1, 11), date(2024, 1, 1))
        got = sorted((str(r.fecha), r.userid, r.ingresos) for r in store.read("login_day").collect())
        assert got == [
            ("2024-01-08", 5, 24), ("2024-01-08", 6, 1), ("2024-01-09", 5, 24), ("2024-01-09", 6, 1), ("2024-01-10", 5, 12),
        ]
    assert store.last_full_date("login_day") == date(2024, 1, 10)
    assert store.last_full_date("other") is None


def test_report_from_rollup_equals_raw_report(spark, settings):
    store = _store(spark)
    rows = [event(n, 1 + n % 4, 2 + n % 3, MIDNIGHT + n * 5000) for n in range(300)]
    t = tables(spark, mdl_logstore_standard_log=rows)
    rollups.backfill(t, settings, store, "login_day", date(2024, 1, 8), date(2024, 2, 10))
    raw = access.course_access(t, settings, "2024-01-10", "2024-01-15", target=None)
    rolled = rollups.access_from_rollup(store, "2024-01-10", "2024-01-15")
    columns = sorted(raw.columns)
    assert sorted(map(tuple, raw.select(columns).collect())) == sorted(map(tuple, rolled.select(columns).collect()))


def _days(store, job="login_day"):
    return sorted((str(r.fecha), r.userid, r.ingresos) for r in store.read(job).collect())


def test_late_rows_are_counted_however_late(spark, settings):
    store = _store(spark)
    day = 86400
    rows = [event(n, 5, 2, MIDNIGHT + n * day) for n in range(20)]
    rollups.run_daily(tables(spark, mdl_logstore_standard_log=rows), settings, store, "login_day", date(2024, 1, 28), date(2024, 1, 1))
    rows += [event(100, 6, 2, MIDNIGHT + 60), event(101, 6, 2, MIDNIGHT - 30 * day)]
    for _ in range(2):
        t = tables(spark, mdl_logstore_standard_log=rows)
        rollups.run_daily(t, settings, store, "login_day", date(2024, 1, 28), date(2024, 1, 1))
        assert _days(store)[:2] == [("2024-01-08", 5, 1), ("2024-01-08", 6, 1)]
        assert len(_days(store)) == 21  # nothing before the start of history


def test_days_that_lose_their_events_are_emptied(spark, settings):
    store = _store(spark)
    both = [event(1, 5, 2, MIDNIGHT), event(2, 5, 2, MIDNIGHT + 86400)]
    for rows in (both, both[:1]):
        t = tables(spark, mdl_logstore_standard_log=rows)
        rollups.run_daily(t, settings, store, "login_day", date(2024, 1, 10), date(2024, 1, 8))
    assert _days(store) == [("2024-01-08", 5, 1)]


def test_watermark_never_falls_nor_leaps(spark, settings):
    store = _store(spark)
    t = tables(spark, mdl_logstore_standard_log=[event(1, 5, 2, MIDNIGHT)])
    rollups.run_daily(t, settings, store, "login_day", date(2024, 1, 20), date(2024, 1, 1))
    for since, until, want in ((1, 5, 19), (25, 28, 19), (18, 22, 22)):
        rollups.backfill(t, settings, store, "login_day", date(2024, 1, since), date(2024, 1, until))
        assert store.last_full_date("login_day") == date(2024, 1, want)


def test_tables_without_rows_can_be_read(spark, settings):
    store = _store(spark)
    t = tables(spark, mdl_logstore_standard_log=[])
    assert rollups.access_from_rollup(store).collect() == []
    rollups.run_daily(t, settings, store, "login_day", date(2024, 1, 20), date(2024, 1, 1))
    assert rollups.access_from_rollup(store).collect() == []
    assert store.last_full_date("login_day") == date(2024, 1, 19)


def test_stream_replace_rebuilds_touched_days(spark, settings):
    root = scratch_path(spark, "arrivals")
    store, checkpoint = _store(spark), scratch_path(spark, "cp")
    arrived = []
    schema = tables(spark).log.schema
    for rows in ([event(1, 5, 2, MIDNIGHT)], [event(2, 5, 2, MIDNIGHT + 30), event(3, 6, 2, MIDNIGHT + 90000)]):
        arrived += rows
        tables(spark, mdl_logstore_standard_log=rows).log.coalesce(1).write.mode("append").parquet(root)
        t = tables(spark, mdl_logstore_standard_log=arrived)
        log = spark.readStream.schema(schema).parquet(root)
        streams.replace_job(log, t, settings, store, ("login_day", "traffic_hour"), checkpoint)
    got = sorted((str(r.fecha), r.userid, r.ingresos) for r in store.read("login_day").collect())
    assert got == [("2024-01-08", 5, 2), ("2024-01-09", 6, 1)]
    assert store.read("traffic_hour").agg(F.sum("usuarios_unicos")).first()[0] == 2


@pytest.mark.parametrize("job", sorted(rollups.BUILDERS))
def test_builders_read_only_their_days(spark, settings, job):
    rows = [
        event(n, 5, 2, MIDNIGHT + n * 43200, contextlevel=70, contextinstanceid=9, ip="1") for n in range(8)
    ]
    t = tables(
        spark,
        mdl_logstore_standard_log=rows,
        mdl_user=[{"id": 5, "deleted": 0}],
        mdl_course_modules=[{"id": 9, "course": 2, "module": 1, "instance": 1}],
        mdl_modules=[{"id": 1, "name": "wiki"}],
    )
    part = rollups.BUILDERS[job](t, settings, "2024-01-09", "2024-01-10")
    whole = rollups.BUILDERS[job](t, settings).filter(F.col("fecha").between("2024-01-09", "2024-01-10"))
    assert sorted(map(str, part.collect())) == sorted(map(str, whole.collect()))
    assert part.count() > 0

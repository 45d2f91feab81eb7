"""Changes to summary tables are whole or absent; late rows are added without a look at their day."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from lectern.session import scratch_path
from lectern.streaming import rollups, versions
from tests.lms import event, tables

MIDNIGHT = 1704690000  # 2024-01-08 00:00 in Bogota
DAY = 86400


def _store(spark):
    return rollups.Store(spark, scratch_path(spark, "store"))


def _log(spark, rows):
    return tables(spark, mdl_logstore_standard_log=rows)


def _days(store, job="login_day"):
    return sorted((str(r.fecha), r.userid, r.ingresos) for r in store.read(job).collect())


ROWS = [event(n, 5, 2, MIDNIGHT + n * 3600) for n in range(60)]
TODAY, HISTORY = date(2024, 1, 11), date(2024, 1, 1)
WANT = [("2024-01-08", 5, 24), ("2024-01-09", 5, 24), ("2024-01-10", 5, 12)]


@pytest.mark.parametrize("step", ["_write", "put_new"])
def test_a_run_that_dies_leaves_the_old_state(spark, settings, monkeypatch, step):
    """Killed after some rows are written, or right before the rename: readers see whole old days."""
    store = _store(spark)
    rollups.run_daily(_log(spark, ROWS[:30]), settings, store, "login_day", TODAY, HISTORY)
    old, mark = _days(store), store.last_run("login_day")
    reader = store.read("login_day")
    owner = versions.Change if step == "_write" else versions.Folder
    whole, calls = getattr(owner, step), []

    def dies(self, *args):
        calls.append(args)
        if step == "_write":
            whole(self, *args)
        raise RuntimeError("killed")

    monkeypatch.setattr(owner, step, dies)
    with pytest.raises(RuntimeError):
        rollups.run_daily(_log(spark, ROWS), settings, store, "login_day", TODAY, HISTORY)
    monkeypatch.undo()
    assert calls and _days(store) == old and store.last_run("login_day") == mark
    rollups.run_daily(_log(spark, ROWS), settings, store, "login_day", TODAY, HISTORY)
    assert _days(store) == WANT
    # A reader that began before the change still sees the old days, whole.
    assert sorted((str(r.fecha), r.userid, r.ingresos) for r in reader.collect()) == old


def test_old_versions_expire_but_not_those_of_unfinished_runs(spark, settings):
    store = _store(spark)
    table = store.table("login_day")
    t = _log(spark, ROWS)
    for _ in range(4):
        change = table.change()
        rollups.run_range(t, settings, change, "login_day", date(2024, 1, 8), date(2024, 1, 10), 59)
        change.commit()
    assert table.expire() == []  # all are younger than the grace period
    gone = table.expire(keep=2, grace_seconds=0)
    assert len(gone) == 2 and len(table.folder.names("data")) == 2
    assert len([n for n in table.folder.names("manifest") if n.endswith(".json")]) == 2
    assert _days(store) == WANT


def test_two_writers_both_count(spark, settings):
    store = _store(spark)
    table = store.table("login_day")
    t = _log(spark, ROWS)
    one, two = table.change(), table.change()
    rollups.run_range(t, settings, one, "login_day", date(2024, 1, 8), date(2024, 1, 8), 59)
    rollups.run_range(t, settings, two, "login_day", date(2024, 1, 9), date(2024, 1, 10), 59)
    one.commit()
    assert not table.folder.put_new("manifest/000000000001.json", "taken")
    assert two.commit().number == 2
    assert _days(store) == WANT


@pytest.mark.parametrize("job", sorted(rollups.MERGED))
def test_late_rows_are_added_to_untouched_days(spark, settings, job):
    store = _store(spark)
    modules = {"mdl_course_modules": [{"id": 9, "course": 2, "module": 1, "instance": 1}], "mdl_modules": [{"id": 1, "name": "wiki"}]}

    def log(rows):
        return tables(spark, mdl_logstore_standard_log=[dict(r, contextlevel=70, contextinstanceid=9) for r in rows], **modules)

    rows = [event(n, 5, 2, MIDNIGHT + n * DAY // 2) for n in range(40)]
    rollups.run_daily(log(rows), settings, store, job, date(2024, 1, 28), HISTORY)
    base = {k: list(d.versions) for k, d in store.table(job).manifest().days.items() if d.versions}
    rows += [event(100 + n, 5 + n % 3, 2, MIDNIGHT + 60 + n * 7) for n in range(9)]
    for again in range(2):
        t = log(rows)
        rollups.run_daily(t, settings, store, job, date(2024, 1, 28), HISTORY)
        days = store.table(job).manifest().days
        assert days["2024-01-08"].versions[:1] == base["2024-01-08"] and len(days["2024-01-08"].versions) == 2
        assert days["2024-01-12"].versions == base["2024-01-12"]
        columns = store.read(job).columns
        want = rollups.BUILDERS[job](t, settings).select(columns).filter(F.col("fecha") < "2024-01-28")
        assert sorted(map(str, store.read(job).collect())) == sorted(map(str, want.collect()))


def test_days_built_since_the_last_run_do_not_count_late_rows_twice(spark, settings):
    store = _store(spark)
    rows = [event(n, 5, 2, MIDNIGHT + n * DAY) for n in range(20)]
    rollups.run_daily(_log(spark, rows), settings, store, "login_day", date(2024, 1, 28), HISTORY)
    rows.append(event(100, 6, 2, MIDNIGHT + 60))
    t = _log(spark, rows)
    rollups.backfill(t, settings, store, "login_day", date(2024, 1, 8), date(2024, 1, 9))
    rollups.run_daily(t, settings, store, "login_day", date(2024, 1, 28), HISTORY)
    assert _days(store)[:2] == [("2024-01-08", 5, 1), ("2024-01-08", 6, 1)]


def test_many_versions_are_put_together(spark, settings):
    store = _store(spark)
    rows = [event(n, 5, 2, MIDNIGHT + n * DAY) for n in range(20)]
    for k in range(rollups.MOST_VERSIONS + 1):
        rows.append(event(100 + k, 5, 2, MIDNIGHT + 60 + k))
        rollups.run_daily(_log(spark, rows), settings, store, "login_day", date(2024, 1, 28), HISTORY)
    assert len(store.table("login_day").manifest().days["2024-01-08"].versions) == 1
    assert _days(store)[0] == ("2024-01-08", 5, rollups.MOST_VERSIONS + 2)


def test_a_swap_leaves_what_came_meanwhile(spark, settings):
    store = _store(spark)
    table = store.table("login_day")
    t = _log(spark, ROWS[:24])
    for k in range(2):
        change = table.change()
        change.add(rollups.login_day(t, settings), upto=k)
        change.commit()
    old = table.manifest().days
    swap = table.change()
    swap.swap(rollups.merged("login_day", table.rows(old)), old)
    late = table.change()
    late.add(rollups.login_day(t, settings), upto=3)
    late.commit()
    swap.commit()
    assert len(table.manifest().days["2024-01-08"].versions) == 2
    assert _days(store) == [("2024-01-08", 5, 72)]


def test_bitmaps_unite_days(spark, settings):
    store = _store(spark)
    users = [1, 2, 40_000, 2**31 + 5]
    rows = [event(n, users[n % 4], 2 + n % 2, MIDNIGHT + n * 9000) for n in range(200)]
    t = _log(spark, rows)
    for job in ("users_bitmap_day", "login_day"):
        rollups.backfill(t, settings, store, job, date(2024, 1, 8), date(2024, 1, 31))
    for since, until in ((None, None), ("2024-01-10", "2024-01-12"), ("2025-01-01", None)):
        bits = rollups.unique_users_from_bitmaps(store, since, until).orderBy("courseid").collect()
        rows_ = rollups.unique_users_from_rollup(store, since, until).orderBy("courseid").collect()
        assert list(map(tuple, bits)) == list(map(tuple, rows_))


def test_bitmaps_read_a_tenth_of_the_rows(spark, settings):
    store = _store(spark)
    t = _log(spark, [event(n, 1 + n % 40, 2, MIDNIGHT + n * 600) for n in range(2000)])
    for job in ("users_bitmap_day", "login_day"):
        rollups.backfill(t, settings, store, job, date(2024, 1, 8), date(2024, 1, 31))
    assert 10 * store.read("users_bitmap_day").count() <= store.read("login_day").count()

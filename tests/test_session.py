"""Bounds on what one task holds."""

from checks import joins
from lectern.session import SHARE_BYTES, START, TASK_BYTES, prepare, size_of, widen
from lectern.sources import LmsTables
from tests.lms import event, tables


def test_sizes_of_settings():
    assert [size_of(x) for x in ("67108864b", "64MB", "8m", "256k", "12", "1g", "3 KiB")] == [64 << 20, 64 << 20, 8 << 20, 256 << 10, 12, 1 << 30, 3 << 10]


def test_bounds_are_lowered_and_never_raised(spark):
    other = spark.newSession()
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    other.conf.set(key, "8m")
    prepare(other)
    assert other.conf.get(key) == "8m"
    assert all(size_of(other.conf.get(k)) <= most for k, most in TASK_BYTES.items())


def test_modules_without_events_do_not_meet_in_one_task(spark):
    """No join of the query has keys that are NULL for all modules without events, and rows equal a plain reading."""
    found = joins._modules_with_events(
        tables(
            spark,
            mdl_course_modules=[dict(id=i, course=2, module=1, instance=i, deletioninprogress=0) for i in range(40)],
            mdl_modules=[dict(id=1, name="wiki")],
            mdl_user=[dict(id=5, deleted=0, suspended=0), dict(id=6, deleted=1, suspended=0)],
            mdl_logstore_standard_log=[event(n, u, 2, 1704690000 + n, contextlevel=70, contextinstanceid=m) for n, (u, m) in enumerate([(5, 1), (5, 1), (6, 1), (6, 3), (7, 3), (5, 99)])],
        )
    )
    rows = sorted((r.module_id, r.timecreated or 0, r.live_user or 0) for r in found.collect())
    at = 1704690000
    events = [(1, at, 5), (1, at + 1, 5), (1, at + 2, 0), (3, at + 3, 0), (3, at + 4, 0)]
    assert rows == sorted(events + [(i, 0, 0) for i in range(40) if i not in (1, 3)])
    text = found._jdf.queryExecution().optimizedPlan().toString()
    # Users are looked up below the join with modules, and that is no outer join, which could not split hot modules.
    assert not [x for x in text.splitlines() if "Join LeftOuter" in x and "module_id" in x]


def test_shuffles_start_with_partitions_for_what_is_read(spark, tmp_path, monkeypatch):
    """A user's rows are dealt over more partitions than the session has, in step with the tables read, and
    each table counts once."""
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "3")
    ids = other.range(5000).selectExpr("id", "id as course")
    for name in ("mdl_quiz", "mdl_chat"):
        ids.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    size = sum(f.stat().st_size for f in (tmp_path / "mdl_quiz").glob("*.parquet"))
    monkeypatch.setattr("lectern.session.SHARE_BYTES", size // 20)

    def dealt(df):
        return df.groupBy("course").count()._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1].split(")")[0]

    found = LmsTables.from_parquet(other, str(tmp_path))
    for turn in range(2):
        assert dealt(found.quiz).endswith(f", {other.conf.get(START)}")
        assert 20 <= int(other.conf.get(START)) <= 22
        LmsTables.from_parquet(other, str(tmp_path)).quiz
    found.chat
    assert 40 <= int(other.conf.get(START)) <= 43
    assert sorted(r["count"] for r in found.quiz.groupBy("course").count().collect()) == [1] * 5000


def test_more_partitions_of_the_session_stay(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "50")
    widen(other, 7 * SHARE_BYTES)
    assert other.conf.get(START, None) is None
    widen(other, 60 * SHARE_BYTES + 1)
    assert other.conf.get(START) == "61"
    widen(other, 7 * SHARE_BYTES)
    assert other.conf.get(START) == "61"
    other.conf.set("spark.sql.shuffle.partitions", "80")
    widen(other, 7 * SHARE_BYTES)
    assert other.conf.get(START) == "80"


def test_partitions_that_skew_splitting_leaves_whole_are_small(spark):
    """A hot key below the threshold is sorted by one task, so the threshold is no more than twice what a task reads."""
    other = spark.newSession()
    prepare(other)
    most = size_of(other.conf.get("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"))
    assert most <= 2 * size_of(other.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))

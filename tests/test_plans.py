"""What the plans must and must not contain."""

import pytest

from checks import all_checks
from lectern.operators import access, tools
from lectern.plans.reports import REPORTS
from lectern.sources import LmsTables
from tests.conftest import SMALL
from tests.lms import event, stored, tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_reports_have_no_cross_join_or_python(spark, settings, name):
    text = plan(REPORTS[name](stored(spark), None, settings))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "SinglePartition", "Expand"):
        assert word not in text


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_reports_work_without_broadcast(spark, settings, name):
    """Beyond the broadcast threshold every join has a shuffled form."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = REPORTS[name](stored(spark), None, settings)
        assert "Broadcast" not in plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_unset_filters_add_nothing(spark, settings):
    t = stored(spark)
    none = REPORTS["registro_usuarios"](t, {}, settings)
    blank = REPORTS["registro_usuarios"](t, {"nivel": " ", "regional": ""}, settings)
    assert none._jdf.queryExecution().optimizedPlan().sameResult(blank._jdf.queryExecution().optimizedPlan())


def test_log_scan_is_pruned_and_filtered(spark, settings):
    text = plan(access.course_access(stored(spark), settings))
    assert "EqualTo(action,viewed)" in text and "EqualTo(target,course)" in text
    assert "eventname" not in text.split("ReadSchema")[1]


def test_preview_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(all_checks()["preview_top50"].run(spark, SMALL))


def _final_plan(df) -> str:
    df.collect()
    return plan(df)


def test_hot_pair_is_split(spark, settings):
    """One user and course hold most of the log: the validity join splits them."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "12",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    users = 200
    logs = spark.range(60_000).selectExpr(
        "id",
        f"case when id % 3 = 0 then 1 else 1 + id % {users} end as userid",
        "2L as courseid",
        "70 as contextlevel",
        "pmod(id, 50) as contextinstanceid",
        "cast(null as string) eventname", "cast(null as string) component", "'viewed' as action", "'course' as target",
        "cast(null as string) objecttable", "cast(null as bigint) objectid", "cast(null as string) ip",
        "cast(null as string) origin", "1704700000 + id as timecreated",
    ).repartition(6)
    small = tables(
        spark,
        mdl_course=[{"id": 2, "shortname": "m", "fullname": "x"}],
        mdl_enrol=[{"id": 1, "courseid": 2, "status": 0}],
        mdl_user=[{"id": n, "deleted": 0} for n in range(1, users + 1)],
        mdl_user_enrolments=[{"id": n, "enrolid": 1, "userid": n, "status": 0} for n in range(1, users + 1)],
    )
    t = LmsTables(spark, lambda name: logs if name == "mdl_logstore_standard_log" else small.table(name))
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        seen = tools.valid_module_users(t, tools.Period())
        text = _final_plan(seen)
        assert "skew=true" in text
        # 1/3 of all rows land on user 1; every user still has its modules once.
        assert seen.filter("userid = 1").count() == 50
        days = access.unique_user_days(access.valid_access(t, settings))
        assert "skew=true" in _final_plan(days)
        assert days.count() == users
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_event_ties_do_not_matter(spark, settings):
    t = tables(
        spark,
        mdl_user=[{"id": 8, "firstname": "A", "lastname": "B"}, {"id": 9, "firstname": "C", "lastname": None}],
        mdl_logstore_standard_log=[
            event(2, 9, None, 5, eventname=r"\core\event\user_created", objectid=4),
            event(1, 8, None, 5, eventname=r"\core\event\user_created", objectid=4),
            event(3, 7, None, 6, eventname=r"\core\event\user_created", objectid=5),
        ],
    )
    from lectern.operators import people

    got = {r.created_userid: r.creator_name for r in people.creators(t).collect()}
    assert got == {4: "A B", 5: " "}


NARROWING = {
    "registro_usuarios": {"codigo_ficha": "12"},
    "matriculas_lms": {"nombre_ficha": "a"},
    "fichas_programas": {"nivel": "t"},
    "uso_herramientas": {"codigo_ficha": "12"},
    "participacion_herramientas": {"nombres_apellidos": "a"},
    "tiempo_permanencia": {"codigo_ficha": "12"},
    "sesiones_online": {"nombre_ficha": "a"},
}
FACT_COLUMNS = ("contextlevel", "enrolid", "timestart", "bigbluebuttonbnid")


def _facts_under_semi_join(df) -> tuple[int, int]:
    """Fact scans of the optimized plan, and those with a semi join above them and no aggregate between."""
    found = kept = 0
    above: list[tuple[int, str]] = []
    for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, x) for d, x in above if d < depth]
        if "Relation" in line and any(c in line for c in FACT_COLUMNS):
            found += 1
            for _, x in reversed(above):
                if x.startswith("Aggregate") or x.startswith("Window"):
                    break
                if x.startswith("Join LeftSemi"):
                    kept += 1
                    break
        above.append((depth, line.lstrip(" :+-")))
    return found, kept


@pytest.mark.parametrize("name", sorted(NARROWING))
def test_filters_reach_the_facts(spark, settings, name):
    t = stored(spark)
    _, plain = _facts_under_semi_join(REPORTS[name](t, None, settings))
    found, kept = _facts_under_semi_join(REPORTS[name](t, NARROWING[name], settings))
    assert found and kept > plain


@pytest.mark.parametrize("params", [None, {"codigo_ficha": "12"}], ids=["whole", "filtered"])
def test_time_report_reads_the_log_once(spark, settings, params):
    """Gaps and view times come from one scan of the log."""
    text = plan(REPORTS["tiempo_permanencia"](stored(spark), params, settings))
    assert len([x for x in text.splitlines() if "FileScan" in x and "eventname" not in x and "timecreated" in x and "action" in x]) == 1


CATALOGUE = ("cat_trafico_diario", "cat_uso_herramientas", "cat_tiempo_herramienta", "cat_sesiones_log", "cat_sesiones_bbb")


@pytest.mark.parametrize("key", CATALOGUE)
def test_catalogue_joins_labels_after_the_last_aggregation(spark, key):
    """No row expansion, and no course label below the aggregations of the facts."""
    lines = plan(all_checks()[key].over(stored(spark))).splitlines()
    assert not any("Expand" in x for x in lines)
    grouped = [x for x in lines if "HashAggregate" in x and ("sum(n" in x or "sum(seconds" in x)]
    assert grouped and not any("fullname" in x or "prog_name" in x for x in grouped)

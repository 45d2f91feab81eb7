"""Merged enrolment spans give the same answers as testing every enrolment."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import access, enrolments
from tests.lms import event, tables


def _valid(e, methods, users, log):
    return (
        e["userid"] == log["userid"]
        and methods[e["enrolid"]] == (log["courseid"], 0)
        and e["status"] == 0
        and log["userid"] in users
        and (not e["timestart"] or e["timestart"] <= log["timecreated"])
        and (not e["timeend"] or e["timeend"] >= log["timecreated"])
    )


@pytest.mark.parametrize("seed", range(4))
def test_valid_access_equals_brute_force(spark, settings, seed):
    rng = random.Random(seed)
    base = settings.floor_epoch
    methods = {i: (2 + i % 3, int(i == 5)) for i in range(1, 7)}
    users = [
        {"id": i, "deleted": int(i == 4), "suspended": None if i == 2 else int(i == 5)} for i in range(1, 7)
    ]
    live = {u["id"] for u in users if not u["deleted"] and not u["suspended"]}

    def instant():
        return rng.choice([None, 0, *(base + rng.randrange(60) for _ in range(6))])

    enrolled = [
        {"id": n, "enrolid": rng.randint(1, 6), "userid": rng.randint(1, 6), "status": int(rng.random() < 0.2),
         "timestart": instant(), "timeend": instant()}
        for n in range(150)
    ]
    logs = [event(n, rng.randint(0, 6), rng.randint(1, 5), base + rng.randrange(60)) for n in range(600)]
    t = tables(
        spark,
        mdl_enrol=[{"id": i, "courseid": c, "status": s} for i, (c, s) in methods.items()],
        mdl_user_enrolments=enrolled,
        mdl_user=users,
        mdl_course=[{"id": i, "shortname": "P_1_V_1_" if i == 2 else "m", "fullname": "x"} for i in range(1, 5)],
        mdl_logstore_standard_log=logs,
    )
    expected = sorted(
        (e["userid"], e["courseid"], e["timecreated"])
        for e in logs
        if e["userid"] > 0 and 1 < e["courseid"] < 5 and any(_valid(x, methods, live, e) for x in enrolled)
    )
    got = access.valid_access(t, settings).select("userid", "course_id", "timecreated").collect()
    assert sorted(map(tuple, got)) == expected


def test_spans_are_disjoint_and_touching_ones_merge(spark):
    rows = [(10, 20), (21, 30), (15, 18), (40, 50), (45, 60), (62, 70), (5, 5)]
    t = tables(
        spark,
        mdl_enrol=[{"id": 1, "courseid": 2, "status": 0}],
        mdl_user=[{"id": 1, "deleted": 0, "suspended": 0}],
        mdl_user_enrolments=[
            {"id": n, "enrolid": 1, "userid": 1, "status": 0, "timestart": a, "timeend": b}
            for n, (a, b) in enumerate(rows)
        ]
        + [{"id": 99, "enrolid": 1, "userid": 1, "status": 0, "timestart": 90, "timeend": 80}],
    )
    spans = enrolments.spans(t).orderBy("span_start").select("span_start", "span_end").collect()
    assert [tuple(r) for r in spans] == [(5, 5), (10, 30), (40, 60), (62, 70)]


@pytest.mark.parametrize(
    "start, end, valid",
    [(100, 200, True), (0, 0, True), (None, None, True), (150, 150, True), (151, 0, False), (0, 149, False), (None, 150, True)],
)
def test_validity_bounds_are_inclusive(spark, start, end, valid):
    from lectern.functions.times import valid_at

    df = spark.createDataFrame([(start, end)], "a bigint, b bigint")
    assert df.select(valid_at(F.col("a"), F.col("b"), F.lit(150))).first()[0] is valid


def test_role_counts_outer_counts_both_sides(spark):
    """A person active in one of two methods is both active and inactive."""
    t = tables(
        spark,
        mdl_enrol=[{"id": 1, "courseid": 2, "status": 0}, {"id": 2, "courseid": 2, "status": 0}],
        mdl_user_enrolments=[{"id": 1, "enrolid": 1, "userid": 7, "status": 0}],
        mdl_context=[{"id": 20, "contextlevel": 50, "instanceid": 2}, {"id": 30, "contextlevel": 50, "instanceid": 3}],
        mdl_role=[{"id": 5, "shortname": "student", "name": ""}],
        mdl_role_assignments=[
            {"id": 1, "userid": 7, "contextid": 20, "roleid": 5},
            {"id": 2, "userid": 8, "contextid": 20, "roleid": 5},
            {"id": 3, "userid": 8, "contextid": 30, "roleid": 5},
        ],
    )
    got = {r.course_id: (r.students_active, r.students_inactive) for r in enrolments.role_counts_outer(t).collect()}
    assert got == {2: (1, 2), 3: (0, 1)}

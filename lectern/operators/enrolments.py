"""Enrolment relations per user and course."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.times import OPEN_END, OPEN_START, epoch_range, overlaps, unset, valid_at
from lectern.operators import people
from lectern.settings import Settings
from lectern.sources import LmsTables

PAIR = ["userid", "course_id"]


def rows(t: LmsTables) -> DataFrame:
    """User enrolments with the course and state of their method."""
    methods = t.enrol.select(
        F.col("id").alias("enrolid"), F.col("courseid").alias("course_id"), F.col("status").alias("method_status")
    )
    return t.user_enrolments.join(methods, "enrolid")


def any_active(t: LmsTables) -> DataFrame:
    return (
        rows(t)
        .groupBy(*PAIR)
        .agg(F.when(F.bool_or(F.col("status") == 0), "Activa").otherwise("Suspendida").alias("enrolment_state"))
    )


def by_user_status(t: LmsTables) -> DataFrame:
    return (
        rows(t)
        .groupBy(*PAIR)
        .agg(F.when(F.bool_or(F.col("status") == 0), "Activo").otherwise("Inactivo").alias("group_state"))
    )


def in_period(t: LmsTables, since: str | None, until: str | None, s: Settings) -> DataFrame:
    r = rows(t)
    test = overlaps(
        F.col("timestart"), F.col("timecreated"), F.col("timeend"), epoch_range(since, until, s.report_tz)
    )
    if test is not None:
        r = r.filter(test)
    return r.groupBy(*PAIR).agg(
        F.min(F.coalesce(F.nullif("timestart", F.lit(0)), "timecreated")).alias("first_start"),
        F.when(F.bool_or(unset(F.col("timeend"))), F.lit(0)).otherwise(F.max("timeend")).alias("last_end"),
        F.when(F.bool_or((F.col("status") == 0) & (F.col("method_status") == 0)), "Activo")
        .otherwise("Suspendido")
        .alias("enrolment_state"),
        F.when(F.bool_or(F.col("method_status") == 0), "Activo").otherwise("Inactivo").alias("method_state"),
    )


def valid_now(t: LmsTables, s: Settings) -> DataFrame:
    """Whether a present user holds an enrolment that is valid at report time."""
    users = people.present_users(t).select(F.col("id").alias("userid"), "suspended")
    # The user table joins the aggregated pairs, not the raw enrolments.
    open_now = (F.col("status") == 0) & (F.col("method_status") == 0) & valid_at(
        F.col("timestart"), F.col("timeend"), F.lit(s.now())
    )
    return (
        rows(t)
        .groupBy(*PAIR)
        .agg(F.bool_or(open_now).alias("open_now"))
        .join(users, "userid")
        .select(
            *PAIR,
            F.when(F.col("open_now") & (F.col("suspended") == 0), "Activo")
            .otherwise("Inactivo")
            .alias("valid_state"),
        )
    )


def with_dates(t: LmsTables) -> DataFrame:
    return (
        rows(t)
        .groupBy(*PAIR)
        .agg(
            F.when(F.bool_or((F.col("status") == 0) & (F.col("method_status") == 0)), "Activo")
            .otherwise("Inactivo")
            .alias("group_state"),
            F.min("timecreated").alias("first_enrolled"),
            F.max("timemodified").alias("last_changed"),
            F.min(F.nullif("timestart", F.lit(0))).alias("first_start"),
            F.max(F.nullif("timeend", F.lit(0))).alias("last_end"),
        )
    )


def spans(t: LmsTables) -> DataFrame:
    """Disjoint time spans in which a live user is validly enrolled in a course.

    Overlapping and touching enrolments are merged, so an event falls into at
    most one span: the validity test becomes an inner join that cannot repeat
    log rows, and a user-course pair with many enrolments costs a few spans.
    Enrolments sharing a start collapse map-side before the window sees them.
    """
    active = (
        rows(t)
        .filter((F.col("status") == 0) & (F.col("method_status") == 0))
        .select(
            *PAIR,
            F.when(unset(F.col("timestart")), F.lit(OPEN_START)).otherwise(F.col("timestart")).alias("start"),
            F.when(unset(F.col("timeend")), F.lit(OPEN_END)).otherwise(F.col("timeend")).alias("end"),
        )
        .filter(F.col("end") >= F.col("start"))
        .join(people.live_users(t), "userid", "left_semi")
        .groupBy(*PAIR, "start")
        .agg(F.max("end").alias("end"))
    )
    in_order = Window.partitionBy(*PAIR).orderBy("start")
    reach = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + 1), 1).otherwise(0)
    return (
        active.withColumn("reach", reach)
        .withColumn("span", F.sum(opens).over(in_order))
        .groupBy(*PAIR, "span")
        .agg(F.min("start").alias("span_start"), F.max("end").alias("span_end"))
        .drop("span")
    )


def role_counts(t: LmsTables, s: Settings) -> DataFrame:
    """Per course: distinct teachers and students, active and inactive.

    People are deduplicated per course first; the counting step then works on
    partial sums, so a course holding most of the people does not fill a task.
    """
    kind = F.when(F.col("shortname").isin(*people.TEACHERS), "teacher").when(
        F.col("shortname") == people.STUDENT, "student"
    )
    persons = (
        people.course_assignments(t)
        .select(*PAIR, kind.alias("kind"))
        .distinct()
        .join(valid_now(t, s), PAIR)
    )

    def count(who: str, state: str):
        return F.count_if((F.col("kind") == who) & (F.col("valid_state") == state))

    return persons.groupBy("course_id").agg(
        count("teacher", "Activo").alias("teachers_active"),
        count("student", "Activo").alias("students_active"),
        count("teacher", "Inactivo").alias("teachers_inactive"),
        count("student", "Inactivo").alias("students_inactive"),
    )


def role_counts_outer(t: LmsTables) -> DataFrame:
    """Variant: role holders are tested against every enrolment method.

    A person counts as inactive when some method of the course does not enrol
    them actively, which includes having no enrolment at all, and as active
    when some method does; with several methods a person may be both.
    """
    kind = F.when(F.col("shortname").isin(*people.TEACHERS), "teacher").when(
        F.col("shortname") == people.STUDENT, "student"
    )
    methods = t.enrol.groupBy(F.col("courseid").alias("course_id")).agg(F.count("id").alias("n_methods"))
    active = F.coalesce(F.col("status"), F.lit(1)) == 0
    held = (
        rows(t)
        .groupBy(*PAIR)
        .agg(
            F.count_distinct("enrolid").alias("n_held"),
            F.bool_or(active).alias("any_active"),
            F.bool_or(~active).alias("any_inactive"),
        )
    )
    persons = (
        people.course_assignments(t)
        .select(*PAIR, kind.alias("kind"))
        .distinct()
        .join(held, PAIR, "left")
        .join(methods, "course_id", "left")
        .withColumn("active", F.coalesce("any_active", F.lit(False)))
        .withColumn(
            "inactive",
            F.col("n_held").isNull() | F.col("any_inactive") | (F.col("n_held") < F.col("n_methods")),
        )
    )

    def count(who: str, flag: str):
        return F.count_if((F.col("kind") == who) & F.col(flag))

    return persons.groupBy("course_id").agg(
        count("teacher", "active").alias("teachers_active"),
        count("student", "active").alias("students_active"),
        count("teacher", "inactive").alias("teachers_inactive"),
        count("student", "inactive").alias("students_inactive"),
    )

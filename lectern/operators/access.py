"""Relations over the event log: course access, logins, valid access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.times import at_hour, epoch_range, in_epoch_range, local_date, local_ts
from lectern.operators import courses, enrolments, people
from lectern.operators.skew import join_hot
from lectern.settings import Settings
from lectern.sources import LmsTables

PAIR = ["userid", "course_id"]
LOGGED_IN = r"\core\event\user_loggedin"
COURSE_VIEWED = r"\core\event\course_viewed"


def log_between(t: LmsTables, since: str | None, until: str | None, tz: str) -> DataFrame:
    """Log rows of an inclusive range of local days.

    The range test is on the raw epoch, so it reaches the scan. If the log is
    stored partitioned by ``event_date`` (UTC day), whole partitions are pruned.
    """
    lo, hi = bounds = epoch_range(since, until, tz)
    log = t.log
    test = in_epoch_range(F.col("timecreated"), bounds)
    if test is not None:
        log = log.filter(test)
    if "event_date" in log.columns:
        if lo is not None:
            log = log.filter(F.col("event_date") >= F.to_date(F.timestamp_seconds(F.lit(lo))))
        if hi is not None:
            log = log.filter(F.col("event_date") <= F.to_date(F.timestamp_seconds(F.lit(hi - 1))))
    return log


def of_course_users(log: DataFrame) -> DataFrame:
    """Events of identified users inside a course."""
    return log.filter((F.col("userid") > 0) & F.col("courseid").isNotNull()).withColumnRenamed(
        "courseid", "course_id"
    )


def course_access(
    t: LmsTables,
    s: Settings,
    since: str | None = None,
    until: str | None = None,
    hour: str | None = None,
    target: str | None = "course",
) -> DataFrame:
    """Views per user and course: distinct days, events, first and last time."""
    views = of_course_users(log_between(t, since, until, s.report_tz)).filter(F.col("action") == "viewed")
    if target is not None:
        views = views.filter(F.col("target") == target)
    if hour is not None:
        views = views.filter(at_hour(F.col("timecreated"), s.report_tz, hour))
    return views.groupBy(*PAIR).agg(
        F.count_distinct(local_date(F.col("timecreated"), s.report_tz)).alias("access_days"),
        F.count("*").alias("accesses"),
        F.min("timecreated").alias("first_access"),
        F.max("timecreated").alias("last_access"),
    )


def is_course_view() -> Column:
    return (F.col("eventname") == COURSE_VIEWED) | (
        (F.col("component") == "core") & (F.col("target") == "course") & (F.col("action") == "viewed")
    )


def course_views(t: LmsTables, s: Settings, since: str | None = None, until: str | None = None) -> DataFrame:
    return (
        of_course_users(log_between(t, since, until, s.report_tz))
        .filter(is_course_view())
        .groupBy(*PAIR)
        .agg(F.count("id").alias("accesses"), F.max("timecreated").alias("last_access"))
    )


def distinct_view_times(
    t: LmsTables, s: Settings, since: str | None = None, until: str | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """Distinct view times per user and course, of the given ``pairs`` or of all."""
    views = of_course_users(log_between(t, since, until, s.report_tz)).filter(F.col("action") == "viewed")
    if pairs is not None:
        views = views.join(pairs, PAIR, "left_semi")
    return (
        views.groupBy(*PAIR)
        .agg(F.count_distinct("timecreated").alias("accesses"), F.max("timecreated").alias("last_access"))
    )


def login_rows(t: LmsTables, s: Settings, since: str | None = None, until: str | None = None) -> DataFrame:
    """Login events with their local time; the address is defaulted here."""
    return (
        log_between(t, since, until, s.report_tz)
        .filter((F.col("eventname") == LOGGED_IN) & (F.col("userid") > 0))
        .select(
            "userid",
            X.blank_to(F.col("ip"), "No disponible").alias("ip"),
            "timecreated",
            local_ts(F.col("timecreated"), s.report_tz).alias("login_at"),
        )
    )


def profiles(t: LmsTables) -> DataFrame:
    """Country and city of present users, defaulted."""
    return people.present_users(t).select(
        F.col("id").alias("userid"),
        X.blank_to(F.col("country"), "No definido").alias("country"),
        X.blank_to(F.col("city"), "No definido").alias("city"),
    )


def login_events(t: LmsTables, s: Settings, since: str | None = None, until: str | None = None) -> DataFrame:
    return login_rows(t, s, since, until).join(profiles(t), "userid")


def valid_access(
    t: LmsTables,
    s: Settings,
    since: str | None = None,
    until: str | None = None,
    origin: str | None = None,
) -> DataFrame:
    """Views by live users while validly enrolled, with course origin and day.

    Users, enrolments and course origin are folded into the span relation
    first, so the log is shuffled once, by user and course, with hot pairs spread.
    """
    homes = courses.origins(t)
    if origin is not None:
        homes = homes.filter(F.col("origin") == origin)
    spans = enrolments.spans(t).join(homes, "course_id")
    views = (
        log_between(t, since, until, s.report_tz)
        .filter(
            (F.col("userid") > 0) & (F.col("action") == "viewed") & (F.col("timecreated") >= s.floor_epoch)
        )
        .select("userid", F.col("courseid").alias("course_id"), "timecreated")
    )
    return (
        join_hot(views, spans)
        .filter(F.col("timecreated").between(F.col("span_start"), F.col("span_end")))
        .select("origin", local_date(F.col("timecreated"), s.report_tz).alias("day"), *PAIR, "timecreated")
    )


def unique_user_days(valid: DataFrame) -> DataFrame:
    return valid.select("origin", "day", "userid").distinct()


PERIODS = {"Día": "day", "Mes": "month", "Año": "year"}


def by_period(days: DataFrame, span: str) -> DataFrame:
    """Replace the day by the first day of its month or year."""
    unit = PERIODS[span]
    period = F.col("day") if unit == "day" else F.trunc("day", unit)
    return days.withColumn("period", period)

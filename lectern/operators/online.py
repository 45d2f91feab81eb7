"""Online sessions: attendance, start and recording marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.filters import any_contains, ilike_any
from lectern.operators import people
from lectern.sources import LmsTables

# Words of the session log that mean joining or starting.
JOIN_WORDS = ("Join", "joined", "Attended")
START_WORDS = ("Create", "created", "Start", "started")


def joins(log: Column, userid: Column) -> Column:
    return (userid > 0) & ilike_any(log, JOIN_WORDS)


def _of_sessions(rows: DataFrame, only: DataFrame | None) -> DataFrame:
    """Rows of the given sessions (column session_id), or all."""
    if only is None:
        return rows
    return rows.join(only.withColumnRenamed("session_id", "bigbluebuttonbnid"), "bigbluebuttonbnid", "left_semi")


def stats(t: LmsTables, identified_only: bool = False, only: DataFrame | None = None) -> DataFrame:
    """Per session: join events, distinct users who joined, started mark."""
    rows = _of_sessions(t.bigbluebuttonbn_logs, only)
    if identified_only:
        rows = rows.filter(F.col("userid") > 0)
    joined = joins(F.col("log"), F.col("userid"))
    return rows.groupBy(F.col("bigbluebuttonbnid").alias("session_id")).agg(
        F.count_if(joined).alias("joins"),
        F.count_distinct(F.when(joined, F.col("userid"))).alias("users"),
        F.bool_or(ilike_any(F.col("log"), START_WORDS)).alias("started"),
    )


def recorded(t: LmsTables, only: DataFrame | None = None) -> DataFrame:
    """Sessions with a recording whose status is not negative (unset counts as 0)."""
    return (
        _of_sessions(t.bigbluebuttonbn_recordings, only)
        .filter(F.coalesce("status", F.lit(0)) >= 0)
        .select(F.col("bigbluebuttonbnid").alias("session_id"))
        .distinct()
    )


def participants(t: LmsTables) -> DataFrame:
    return t.bigbluebuttonbn_logs.select(F.col("bigbluebuttonbnid").alias("session_id"), "userid").distinct()


def with_role(t: LmsTables, role: str, raw: bool, exact: bool = False) -> DataFrame:
    """Sessions where somebody took part who holds the role in the course."""
    text = any_contains([F.col("shortname"), F.col("role_name")], role, raw)
    holders = (
        people.course_assignments(t)
        .filter(F.col("shortname") == role if exact else text)
        .select("userid", "course_id")
        .distinct()
    )
    homes = t.bigbluebuttonbn.select(F.col("id").alias("session_id"), F.col("course").alias("course_id"))
    return (
        participants(t).join(homes, "session_id").join(holders, ["userid", "course_id"], "left_semi")
        .select("session_id").distinct()
    )


def with_person(t: LmsTables, test: Column) -> DataFrame:
    """Sessions where somebody took part whose user row passes the test."""
    who = t.user.filter(test).select(F.col("id").alias("userid"))
    return participants(t).join(who, "userid", "left_semi").select("session_id").distinct()


def identity_test(value: str, raw: bool, username_only: bool = False) -> Column:
    known = F.coalesce(F.nullif("idnumber", F.lit("")), "username")
    return any_contains([F.col("username")] if username_only else [known, F.col("username")], value, raw)


def name_test(value: str, raw: bool) -> Column:
    return any_contains([X.full_name(F.col("firstname"), F.col("lastname"))], value, raw)

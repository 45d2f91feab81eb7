"""Estimated time on task from the gaps between log events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import labels as L
from lectern.operators import access, people, tools
from lectern.operators.skew import join_hot
from lectern.settings import Settings
from lectern.sources import LmsTables

PAIR = ["userid", "course_id"]

# Fixed value: a gap counts for at most 30 minutes.
MAX_GAP = 1800


def events(t: LmsTables, s: Settings, since: str | None = None, until: str | None = None, *more: str) -> DataFrame:
    return access.of_course_users(access.log_between(t, since, until, s.report_tz)).select(
        "id", *PAIR, "contextlevel", "contextinstanceid", "timecreated", *more
    )


def next_event(rows: DataFrame, keys: list[str], slice_seconds: int) -> DataFrame:
    """Add ``next_time``: time of the key's next event by (time, id).

    The plain window would put all events of one key into one task. Here the
    key is cut into time slices: inside a slice a window finds the next event,
    and only the last event of each slice (with the slice's first time) goes
    through a second window over the slices. No task ever sorts more than one
    slice of a key, or one row per slice.
    """
    cut = rows.withColumn("slice", F.call_function("div", F.col("timecreated"), F.lit(slice_seconds)))
    within = Window.partitionBy(*keys, "slice").orderBy("timecreated", "id")
    whole = within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = cut.withColumn("next_time", F.lead("timecreated").over(within)).withColumn(
        "slice_first", F.min("timecreated").over(whole)
    )
    inner = seen.filter(F.col("next_time").isNotNull())
    across = Window.partitionBy(*keys).orderBy("slice")
    last = seen.filter(F.col("next_time").isNull()).withColumn("next_time", F.lead("slice_first").over(across))
    return inner.unionByName(last).drop("slice", "slice_first")


def capped_gap(now: Column, following: Column) -> Column:
    """Seconds until the next event, at most 30 minutes; the last event counts 0."""
    gap = following - now
    return F.when(following.isNull(), F.lit(0)).otherwise(F.least(F.lit(MAX_GAP), F.greatest(F.lit(0), gap)))


def gaps(t: LmsTables, s: Settings, since: str | None = None, until: str | None = None) -> DataFrame:
    """Events with the time of the next event and the capped gap."""
    return next_event(events(t, s, since, until), PAIR, s.gap_slice_seconds).withColumn(
        "seconds", capped_gap(F.col("timecreated"), F.col("next_time"))
    )


def instance_of(strict_context: bool = False) -> Column:
    """Context instance that an event's time is booked on.

    A course-level event carries the course id as its instance, which can
    equal a module id; ``strict_context`` counts such events as course time.
    """
    instance = F.col("contextinstanceid")
    return F.when(F.col("contextlevel") == people.MODULE, instance) if strict_context else instance


def instance_seconds(
    rows: DataFrame, keys: list[str], slice_seconds: int, instance: Column, viewed: Column | None = None
) -> DataFrame:
    """Capped gap seconds per key and context instance (``module_id``).

    With ``viewed``, a test of rows, also the distinct times of such rows (``accesses``, each counted on the
    instance of the first row that has it) and the last of them (``last_access``).

    Same slicing as ``next_event``, but summed early: inside a slice the gaps
    are added up per instance, and only these sums travel to the second
    window, which adds the gap from a slice's last event to the next slice.
    """
    cut = rows.select(
        *keys,
        "id",
        "timecreated",
        instance.alias("module_id"),
        F.call_function("div", F.col("timecreated"), F.lit(slice_seconds)).alias("slice"),
        *([] if viewed is None else [F.when(viewed, F.col("timecreated")).alias("view_time")]),
    )
    within = Window.partitionBy(*keys, "slice").orderBy("timecreated", "id")
    following = F.col("following")
    more: list[Column] = []
    if viewed is not None:
        # Rows of one time lie in one slice, next to each other.
        earlier = F.max("view_time").over(within.rowsBetween(Window.unboundedPreceding, -1))
        cut = cut.withColumn("new_view", F.col("view_time") > F.coalesce(earlier, F.col("view_time") - 1))
        more = [F.count_if("new_view").alias("accesses"), F.max("view_time").alias("last_access")]
    summed = (
        cut.withColumn("following", F.lead("timecreated").over(within))
        .groupBy(*keys, "slice", "module_id")
        .agg(
            F.sum(capped_gap(F.col("timecreated"), following)).alias("seconds"),
            F.min("timecreated").alias("first_time"),
            F.max(F.when(following.isNull(), F.col("timecreated"))).alias("slice_last"),
            *more,
        )
    )
    # Earliest time in any later slice of the key: a running minimum, newest first.
    later = Window.partitionBy(*keys).orderBy(F.col("slice").desc()).rangeBetween(Window.unboundedPreceding, -1)
    tail = F.when(F.col("slice_last").isNotNull(), capped_gap(F.col("slice_last"), F.col("next_first")))
    return (
        summed.withColumn("next_first", F.min("first_time").over(later))
        .withColumn("seconds", F.col("seconds") + F.coalesce(tail, F.lit(0)))
        .groupBy(*keys, "module_id")
        .agg(F.sum("seconds").alias("seconds"), *_views(summed))
    )


def _views(df: DataFrame) -> list[Column]:
    """Sums of the view measures, where a relation has them."""
    return [F.sum("accesses").alias("accesses"), F.max("last_access").alias("last_access")] if "accesses" in df.columns else []


def per_instance(
    t: LmsTables,
    s: Settings,
    since: str | None = None,
    until: str | None = None,
    only: DataFrame | None = None,
    strict_context: bool = False,
    views: bool = False,
) -> DataFrame:
    """Seconds per user, course and context instance; with ``views`` also distinct view times, from the same pass."""
    rows = events(t, s, since, until, *(["action"] if views else []))
    if only is not None:
        rows = join_hot(rows, only.select(*PAIR), "left_semi")
    viewed = F.col("action") == "viewed" if views else None
    return instance_seconds(rows, PAIR, s.gap_slice_seconds, instance_of(strict_context), viewed)


def module_kinds(t: LmsTables) -> DataFrame:
    return tools.modules(t, deleting="all").select("module_id", "module_name", "forum_type")


def per_tool(t: LmsTables, instances: DataFrame) -> DataFrame:
    """Seconds per user, course and tool; sums first, module lookup after."""
    return (
        instances.join(module_kinds(t), "module_id", "left")
        .withColumn("tool", L.time_tool_class(F.col("module_name"), F.col("forum_type")))
        .groupBy(*PAIR, "tool")
        .agg(F.sum("seconds").alias("seconds"), *_views(instances))
    )


# Printed tool columns and the classes that feed them.
PIVOT: dict[str, tuple[str, ...]] = {
    "wiki": ("wiki",),
    "surveys": ("feedback", "survey"),
    "forums": ("foro",),
    "quizzes": ("quiz",),
    "blogs": ("blog",),
    "assignments": ("assign",),
    "scorm": ("scorm",),
    "sessions": ("bigbluebuttonbn",),
    "chats": ("chat",),
    "attendance": ("asistencia",),
}


def pivoted(tool_seconds: DataFrame) -> DataFrame:
    """Total seconds and the seconds of each printed tool, per user and course."""

    def cell(name: str, classes: tuple[str, ...]) -> Column:
        return F.sum(F.when(F.col("tool").isin(*classes), F.col("seconds")).otherwise(0)).alias(f"sec_{name}")

    return tool_seconds.groupBy(*PAIR).agg(
        F.sum("seconds").alias("sec_total"), *[cell(name, classes) for name, classes in PIVOT.items()], *_views(tool_seconds)
    )

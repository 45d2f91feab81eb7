"""Activity tools: who took part in what, per user and course.

Every relation has the columns (userid, course_id, total). Rows are counted per
activity and user first, with a map-side combine; only these counts look up the
course of their activity and are added up per user and course. So a lookup that
is too big to broadcast shuffles counts, never raw rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import labels as L
from lectern.functions.times import epoch_range, in_epoch_range
from lectern.operators import access, enrolments, people
from lectern.operators.courses import SITE_COURSE
from lectern.operators.skew import join_hot
from lectern.settings import Settings
from lectern.sources import LmsTables

PAIR = ["userid", "course_id"]

# Log actions that count as taking part in a package.
SCORM_ACTIONS = ("viewed", "launched", "submitted", "completed", "updated")


class Period:
    """Inclusive range of local days as an epoch filter."""

    def __init__(self, since: str | None = None, until: str | None = None, tz: str = "America/Bogota"):
        self.since, self.until, self.tz = since, until, tz
        self.bounds = epoch_range(since, until, tz)

    def only(self, df: DataFrame, epoch: Column) -> DataFrame:
        test = in_epoch_range(epoch, self.bounds)
        return df if test is None else df.filter(test)


def _courses_of(activities: DataFrame, key: str) -> DataFrame:
    return activities.select(F.col("id").alias(key), F.col("course").alias("course_id"))


def _total(df: DataFrame) -> DataFrame:
    return df.groupBy(*PAIR).agg(F.sum("n").alias("total"))


def _counted(rows: DataFrame, key: str, activities: DataFrame) -> DataFrame:
    """Row counts per user and course of the activity they belong to."""
    counts = rows.groupBy(key, "userid").agg(F.count("*").alias("n"))
    return _total(counts.join(_courses_of(activities, key), key))


def _distinct_activities(rows: DataFrame, key: str, activities: DataFrame) -> DataFrame:
    """Distinct activities per user and course; an activity has one course."""
    per_activity = rows.select(key, "userid").distinct().withColumn("n", F.lit(1))
    return _total(per_activity.join(_courses_of(activities, key), key))


def forum_counts(t: LmsTables, p: Period) -> DataFrame:
    """Posts and replies per user, course and forum type, from one pass."""
    posts = (
        p.only(t.forum_posts, F.col("created"))
        .groupBy("discussion", "userid")
        .agg(
            F.count("*").alias("posts"),
            F.count_if(F.col("parent") > 0).alias("replies"),
            F.count_if(F.col("parent") == 0).alias("openings"),
        )
    )
    places = t.forum_discussions.select(F.col("id").alias("discussion"), "forum").join(
        t.forum.select(F.col("id").alias("forum"), F.col("course").alias("course_id"), "type"), "forum"
    )
    return (
        posts.join(places, "discussion")
        .groupBy(*PAIR, "type")
        .agg(*[F.sum(m).alias(m) for m in ("posts", "replies", "openings")])
    )


def _forum_total(counts: DataFrame, test: Column, measure: str) -> DataFrame:
    return (
        counts.filter(test & (F.col(measure) > 0))
        .groupBy(*PAIR)
        .agg(F.sum(measure).alias("total"))
    )



def blogs(t: LmsTables, p: Period) -> DataFrame:
    return _forum_total(forum_counts(t, p), (F.col("type") == "blog") & (F.col("userid") > 0), "posts")


def blog_openings(t: LmsTables, p: Period) -> DataFrame:
    """Variant: first posts of blog discussions only, any user."""
    return _forum_total(forum_counts(t, p), F.col("type") == "blog", "openings")


def forums(t: LmsTables, p: Period) -> DataFrame:
    test = ~F.col("type").isin("news", "blog") & (F.col("userid") > 0)
    return _forum_total(forum_counts(t, p), test, "posts")


def forum_replies(t: LmsTables, p: Period) -> DataFrame:
    return _forum_total(forum_counts(t, p), ~F.col("type").isin("news", "blog"), "replies")


def announcements(t: LmsTables, p: Period) -> DataFrame:
    return _forum_total(forum_counts(t, p), F.col("type") == "news", "posts")


def discussions_opened(t: LmsTables, p: Period) -> DataFrame:
    """Variant: discussions started, by the discussion's own user."""
    forums_ = t.forum.filter(~F.col("type").isin("news", "blog"))
    return _counted(p.only(t.forum_discussions, F.col("timemodified")), "forum", forums_)


def quizzes(t: LmsTables, p: Period) -> DataFrame:
    done = t.quiz_attempts.filter((F.col("state") == "finished") & (F.col("timefinish") > 0))
    return _counted(p.only(done, F.col("timefinish")), "quiz", t.quiz)


def assignments(t: LmsTables, p: Period, statuses: tuple[str, ...] = ("submitted",)) -> DataFrame:
    sent = t.assign_submission.filter(F.col("status").isin(*statuses))
    when = F.coalesce(F.nullif("timemodified", F.lit(0)), "timecreated")
    return _distinct_activities(p.only(sent, when), "assignment", t.assign)


def survey_parts(t: LmsTables, p: Period) -> DataFrame:
    feedback = _counted(p.only(t.feedback_completed, F.col("timemodified")), "feedback", t.feedback)
    survey = _counted(p.only(t.survey_answers, F.col("time")), "survey", t.survey)
    return feedback.unionByName(survey)


def surveys(t: LmsTables, p: Period) -> DataFrame:
    return survey_parts(t, p).groupBy(*PAIR).agg(F.sum("total").alias("total"))


def is_wiki_edit() -> Column:
    return (F.col("component") == "mod_wiki") & (
        F.col("eventname").ilike("%page_updated%") | F.col("action").isin("created", "updated")
    )


def is_scorm_use() -> Column:
    return (F.col("component") == "mod_scorm") & (
        F.col("action").isin(*SCORM_ACTIONS) | F.col("eventname").ilike("%scorm%")
    )


def scorm_item() -> Column:
    return F.coalesce("contextinstanceid", "objectid", "id")


def _log(t: LmsTables, p: Period) -> DataFrame:
    return access.of_course_users(access.log_between(t, p.since, p.until, p.tz))


def wikis(t: LmsTables, p: Period) -> DataFrame:
    return _log(t, p).filter(is_wiki_edit()).groupBy(*PAIR).agg(F.count("id").alias("total"))


def scorm(t: LmsTables, p: Period) -> DataFrame:
    return _log(t, p).filter(is_scorm_use()).groupBy(*PAIR).agg(F.count_distinct(scorm_item()).alias("total"))


def sessions(t: LmsTables, p: Period) -> DataFrame:
    seen = t.bigbluebuttonbn_logs.filter(F.col("userid") > 0)
    return _distinct_activities(p.only(seen, F.col("timecreated")), "bigbluebuttonbnid", t.bigbluebuttonbn)


def chats(t: LmsTables, p: Period) -> DataFrame:
    said = t.chat_messages.filter(F.col("userid") > 0)
    return _counted(p.only(said, F.col("timestamp")), "chatid", t.chat)


def log_measures(t: LmsTables, p: Period) -> DataFrame:
    """Views, wiki edits and packages used, from a single scan of the log."""
    view, wiki, package = access.is_course_view(), is_wiki_edit(), is_scorm_use()
    return (
        _log(t, p)
        .filter(view | wiki | package)
        .groupBy(*PAIR)
        .agg(
            F.count_if(view).alias("accesses"),
            F.max(F.when(view, F.col("timecreated"))).alias("last_access"),
            F.count_if(wiki).alias("wikis"),
            F.count_distinct(F.when(package, scorm_item())).alias("scorm"),
        )
    )


# Printed order of the participation measures.
MEASURES = (
    "accesses", "wikis", "surveys", "forums", "replies", "quizzes", "blogs", "assignments", "scorm",
    "sessions", "chats", "announcements",
)


def stacked(parts: list[DataFrame], measures: tuple[str, ...]) -> DataFrame:
    """Measures of several relations per user and course: one union, one aggregation.

    Each part brings only its own columns; the others are NULL there and add
    nothing to the sums.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    sums = [F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures]
    last = [F.max("last_access").alias("last_access")] if "last_access" in rows.columns else []
    return rows.groupBy(*PAIR).agg(*sums, *last)


def participation(t: LmsTables, p: Period, creations: bool = False) -> DataFrame:
    """All measures per user and course: one union and one aggregation.

    With ``creations`` forums count discussions opened and blogs count their
    first posts, instead of all posts.
    """
    talk = ~F.col("type").isin("news", "blog")
    blog, news = F.col("type") == "blog", F.col("type") == "news"
    identified = F.col("userid") > 0
    posts = F.col("posts")
    forum = {
        "replies": F.when(talk, F.col("replies")),
        "blogs": F.when(blog, F.col("openings")) if creations else F.when(blog & identified, posts),
        "announcements": F.when(news, posts),
    }
    if not creations:
        forum["forums"] = F.when(talk & identified, posts)
    parts = [
        log_measures(t, p),
        forum_counts(t, p).select(*PAIR, *[c.alias(n) for n, c in forum.items()]),
        quizzes(t, p).withColumnRenamed("total", "quizzes"),
        assignments(t, p).withColumnRenamed("total", "assignments"),
        survey_parts(t, p).withColumnRenamed("total", "surveys"),
        sessions(t, p).withColumnRenamed("total", "sessions"),
        chats(t, p).withColumnRenamed("total", "chats"),
    ]
    if creations:
        parts.append(discussions_opened(t, p).withColumnRenamed("total", "forums"))
    return stacked(parts, MEASURES)


# -- activity modules ---------------------------------------------------------


def modules(t: LmsTables, deleting: str = "unset is kept") -> DataFrame:
    """Course modules with module name, forum type and reporting class.

    ``deleting`` says which modules stay: "all", those not being deleted with an
    unset mark counting as not ("unset is kept"), or only those marked 0 ("marked").
    """
    cm = t.course_modules
    if deleting == "unset is kept":
        cm = cm.filter(F.coalesce("deletioninprogress", F.lit(0)) == 0)
    elif deleting == "marked":
        cm = cm.filter(F.col("deletioninprogress") == 0)
    kinds = t.modules.select(F.col("id").alias("module"), F.col("name").alias("module_name"))
    forum_types = t.forum.select(
        F.col("id").alias("instance"), F.col("type").alias("forum_type"), F.lit("forum").alias("module_name")
    )
    return (
        cm.select(F.col("id").alias("module_id"), F.col("course").alias("course_id"), "module", "instance")
        .join(kinds, "module")
        # A forum id equals the instance number of many other modules; the
        # module name is part of the key so only forums find a type.
        .join(forum_types, ["instance", "module_name"], "left")
        .select(
            "module_id",
            "course_id",
            "module_name",
            "forum_type",
            L.tool_class(F.col("module_name"), F.col("forum_type")).alias("tool"),
        )
    )


def module_events(t: LmsTables, p: Period, hour: str | None = None, identified: bool = True) -> DataFrame:
    """Module-level log rows (context level 70)."""
    log = access.log_between(t, p.since, p.until, p.tz).filter(F.col("contextlevel") == people.MODULE)
    if identified:
        log = log.filter(F.col("userid") > 0)
    if hour is not None:
        log = log.filter(access.at_hour(F.col("timecreated"), p.tz, hour))
    return log.select(
        "userid",
        F.col("courseid").alias("course_id"),
        F.col("contextinstanceid").alias("module_id"),
        "timecreated",
    )


def valid_module_users(t: LmsTables, p: Period, hour: str | None = None) -> DataFrame:
    """Distinct (course, module, user) with an event while validly enrolled."""
    spans = enrolments.spans(t)
    return (
        join_hot(module_events(t, p, hour), spans)
        .filter(F.col("timecreated").between(F.col("span_start"), F.col("span_end")))
        .select("course_id", "module_id", "userid")
        .distinct()
    )


def tool_usage(t: LmsTables, s: Settings, p: Period, hour: str | None = None, simple: bool = False) -> DataFrame:
    """Per course and tool: distinct users and distinct modules.

    Counting per (course, tool) and pivoting afterwards keeps the plan free of
    the row expansion that twenty filtered distinct counts would need.
    """
    cm = modules(t, "marked" if simple else "unset is kept").filter(F.col("course_id") != SITE_COURSE)
    items = cm.groupBy("course_id", "tool").agg(F.count_distinct("module_id").alias("items"), F.lit(0).alias("users"))
    if simple:
        seen = module_events(t, p, hour, identified=False).select("course_id", "module_id", "userid").distinct()
    else:
        seen = valid_module_users(t, p, hour)
    users = (
        seen.join(cm.select("course_id", "module_id", "tool"), ["course_id", "module_id"])
        .select("course_id", "tool", "userid")
        .distinct()
        .groupBy("course_id", "tool")
        .agg(F.lit(0).alias("items"), F.count("userid").alias("users"))
    )
    return (
        items.unionByName(users)
        .groupBy("course_id", "tool")
        .agg(F.sum("users").alias("users"), F.sum("items").alias("items"))
    )


USAGE_TOOLS = (
    "wiki", "encuesta", "evaluacion", "evidencia", "blog", "anuncio", "foro", "scorm", "sesion", "chat",
)


def usage_pivot(usage: DataFrame) -> DataFrame:
    """One row per course with users and items of each tool."""

    def cell(tool: str, measure: str) -> Column:
        return F.sum(F.when(F.col("tool") == tool, F.col(measure)).otherwise(0)).alias(f"{tool}_{measure}")

    return usage.groupBy("course_id").agg(
        *[cell(tool, measure) for tool in USAGE_TOOLS for measure in ("users", "items")]
    )

"""The tables cut down to the courses and users that a report's filters keep.

A filtered report is joined with its facts at the end; without this the facts of all
other courses would be counted first. The semi joins stand on the raw rows,
before any aggregation. A report without such filters reads the plain tables.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import people
from lectern.sources import LmsTables

# Columns that name the course and the user of a row.
KEYS: dict[str, tuple[str | None, str | None]] = {
    "mdl_logstore_standard_log": ("courseid", "userid"),
    "mdl_logstore_dense": ("courseid", "userid"),
    "mdl_enrol": ("courseid", None),
    "mdl_user_enrolments": (None, "userid"),
    "mdl_role_assignments": (None, "userid"),
    "mdl_course_modules": ("course", None),
    "mdl_forum_posts": (None, "userid"),
    "mdl_forum_discussions": (None, None),
    "mdl_quiz": ("course", None),
    "mdl_quiz_attempts": (None, "userid"),
    "mdl_assign": ("course", None),
    "mdl_assign_submission": (None, "userid"),
    "mdl_feedback": ("course", None),
    "mdl_feedback_completed": (None, "userid"),
    "mdl_survey": ("course", None),
    "mdl_survey_answers": (None, "userid"),
    "mdl_chat": ("course", None),
    "mdl_chat_messages": (None, "userid"),
    "mdl_wiki": ("course", None),
    "mdl_bigbluebuttonbn": ("course", None),
    "mdl_bigbluebuttonbn_logs": (None, "userid"),
}


def is_set(p: Mapping, names: Iterable[str]) -> bool:
    return any(p.get(name) is not None for name in names)


def narrowed(t: LmsTables, courses: DataFrame | None = None, users: DataFrame | None = None) -> LmsTables:
    """Tables with only the rows of ``courses`` (column course_id) and ``users`` (column userid)."""
    if courses is None and users is None:
        return t

    def load(name: str) -> DataFrame:
        df = t.table(name)
        course, user = KEYS.get(name, (None, None))
        if courses is not None and course is not None:
            df = df.join(courses.select(F.col("course_id").alias(course)), course, "left_semi")
        if courses is not None and name == "mdl_context":
            at_course = F.col("contextlevel") == people.COURSE
            kept = courses.select(F.col("course_id").alias("instanceid"))
            df = df.filter(~at_course).unionByName(df.filter(at_course).join(kept, "instanceid", "left_semi"))
        if users is not None and user is not None:
            df = df.join(users.select(F.col("userid").alias(user)), user, "left_semi")
        return df

    return t.derived(load)

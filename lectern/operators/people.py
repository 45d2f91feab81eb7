"""User relations: roles, creators, profile fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.sources import LmsTables

# Context levels and the profile field names of a document.
SYSTEM, CATEGORY, COURSE, MODULE = 10, 40, 50, 70
TEACHERS = ("teacher", "editingteacher")
STUDENT = "student"
DOCUMENT_TYPE_FIELDS = ("tipo_documento", "tipodocumento", "tipo_doc", "tipoidentificacion", "tipo_identificacion")
DOCUMENT_FIELDS = ("documento", "numero_documento", "identificacion", "cedula", "numero_identificacion")


def role_label() -> Column:
    return F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("shortname"))


def contexts(t: LmsTables, *levels: int) -> DataFrame:
    """Contexts of the given levels; the literal test reaches the scan."""
    c = t.context
    if levels:
        c = c.filter(F.col("contextlevel").isin(*levels))
    return c.select(F.col("id").alias("contextid"), "contextlevel", F.col("instanceid").alias("course_id"))


def roles(t: LmsTables) -> DataFrame:
    return t.role.select(F.col("id").alias("roleid"), "shortname", role_label().alias("role_name"))


def assigned(t: LmsTables) -> DataFrame:
    return t.role_assignments.select("userid", "contextid", "roleid")


def course_assignments(t: LmsTables) -> DataFrame:
    """(user, course, role) of course-level role assignments."""
    return (
        assigned(t)
        .join(contexts(t, COURSE).drop("contextlevel"), "contextid")
        .join(roles(t), "roleid")
        .select("userid", "course_id", "shortname", "role_name")
    )


def _joined(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Sorted, comma-joined distinct role names per key.

    The sets are built map-side first, and a set holds at most as many entries
    as there are roles, however many assignments a key has.
    """

    def listing(column: str) -> Column:
        return F.array_join(F.sort_array(F.collect_set(column)), ", ")

    return (
        pairs.groupBy(*keys)
        .agg(listing("role_name").alias("role_names"), listing("shortname").alias("role_shortnames"))
    )


def roles_by_user_course(t: LmsTables) -> DataFrame:
    return _joined(course_assignments(t), ["userid", "course_id"])


def roles_by_user(t: LmsTables, *levels: int) -> DataFrame:
    """Roles of a user in any context, or only in the given context levels."""
    pairs = assigned(t)
    if levels:
        pairs = pairs.join(contexts(t, *levels).select("contextid"), "contextid")
    return _joined(pairs.join(roles(t), "roleid"), ["userid"])


def creators(t: LmsTables) -> DataFrame:
    """Who created each user: actor of the earliest creation event."""
    first = (
        t.log.filter((F.col("eventname") == r"\core\event\user_created") & F.col("objectid").isNotNull())
        .groupBy(F.col("objectid").alias("created_userid"))
        .agg(F.min_by("userid", F.struct("timecreated", "id")).alias("creator_id"))
    )
    names = t.user.select(F.col("id").alias("creator_id"), "firstname", "lastname")
    return first.join(names, "creator_id", "left").select(
        "created_userid", X.full_name(F.col("firstname"), F.col("lastname")).alias("creator_name")
    )


def profile_documents(t: LmsTables) -> DataFrame:
    """Document type and number from the custom profile fields."""
    fields = t.user_info_field.filter(
        F.col("shortname").isin(*DOCUMENT_TYPE_FIELDS, *DOCUMENT_FIELDS)
    ).select(F.col("id").alias("fieldid"), "shortname")

    def value(names: tuple[str, ...]) -> Column:
        return F.max(F.when(F.col("shortname").isin(*names), F.col("data")))

    found = (
        t.user_info_data.join(fields, "fieldid")
        .groupBy("userid")
        .agg(value(DOCUMENT_TYPE_FIELDS).alias("document_type"), value(DOCUMENT_FIELDS).alias("document"))
    )
    return found


def live_users(t: LmsTables) -> DataFrame:
    """Users neither deleted nor suspended (no mark counts as not suspended)."""
    return t.user.filter((F.col("deleted") == 0) & (F.coalesce("suspended", F.lit(0)) == 0)).select(
        F.col("id").alias("userid")
    )


def present_users(t: LmsTables) -> DataFrame:
    return t.user.filter(F.col("deleted") == 0)

"""Course relations: parsed names, origin, labels, region and centre."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import labels as L
from lectern.functions import text as X
from lectern.settings import Settings
from lectern.sources import LmsTables

# Fixed value: the site itself is stored as course 1 and is never reported.
SITE_COURSE = 1


def real_courses(t: LmsTables) -> DataFrame:
    return t.course.filter(F.col("id") != SITE_COURSE)


def parsed(t: LmsTables) -> DataFrame:
    """Courses with the codes held in their full and short names."""
    full, short = F.col("fullname"), F.col("shortname")
    return real_courses(t).select(
        F.col("id").alias("course_id"),
        "idnumber",
        "shortname",
        "fullname",
        "category",
        "visible",
        "startdate",
        "enddate",
        F.col("timecreated").alias("course_created"),
        X.program_code(full).alias("program_code"),
        X.program_name(full).alias("program_name"),
        X.region_code(short).alias("region_code"),
        X.center_code(short).alias("center_code"),
        X.modality_letter(short).alias("letter"),
        X.version(short).alias("version"),
    )


def origins(t: LmsTables) -> DataFrame:
    return real_courses(t).select(
        F.col("id").alias("course_id"), L.origin(F.col("shortname").rlike(X.INTEGRATED)).alias("origin")
    )


def with_places(courses: DataFrame, t: LmsTables) -> DataFrame:
    """Region and centre names by code.

    The lookups run at course grain, before any fact is joined. There is no
    broadcast hint: Spark broadcasts the two dimensions while they are under
    its size threshold and shuffles them otherwise.
    """
    regions = t.regionales.select(F.col("rgn_id"), F.col("nombre").alias("region_found"))
    centers = t.centros.select(F.col("sed_id"), F.col("nombre").alias("center_found"))
    joined = courses.join(
        regions, F.col("region_code").try_cast("bigint") == F.col("rgn_id"), "left"
    ).join(centers, F.col("center_code").try_cast("bigint") == F.col("sed_id"), "left")
    # *_name is NULL when neither a name nor a code is known: such rows never
    # match a text filter, while the printed label falls back to "undefined".
    return (
        joined.withColumn(
            "region_name", F.coalesce("region_found", F.concat(F.lit("Regional "), F.col("region_code")))
        )
        .withColumn("center_name", F.coalesce("center_found", F.concat(F.lit("Centro "), F.col("center_code"))))
        .drop("rgn_id", "sed_id", "region_found", "center_found")
    )


def described(t: LmsTables, s: Settings) -> DataFrame:
    """Everything the reports print or filter about a course, one row each."""
    c = with_places(parsed(t), t)
    return c.select(
        "*",
        L.origin(F.col("shortname").rlike(X.INTEGRATED)).alias("origin"),
        L.level(F.col("letter")).alias("level"),
        L.modality(F.col("letter")).alias("modality"),
        L.course_state(F.col("visible"), F.col("startdate"), F.col("enddate"), s.now()).alias("course_state"),
        X.or_undefined(F.col("program_code")).alias("program_code_label"),
        X.or_undefined(F.col("version")).alias("version_label"),
        F.coalesce(F.nullif(F.col("program_name"), F.lit("")), F.col("fullname")).alias("program_title"),
        X.or_undefined(F.col("region_name")).alias("region"),
        X.or_undefined(F.col("center_name")).alias("center"),
        X.or_undefined(F.col("center_code")).alias("center_code_label"),
    )


def seeds(t: LmsTables) -> DataFrame:
    """Active programme seeds of both kinds, tagged with their course category."""

    def one(df: DataFrame, category: int) -> DataFrame:
        return df.filter(F.col("status_seed") == "A").select(
            F.lit(category).cast("bigint").alias("seed_category"),
            F.col("code").cast("string").alias("seed_code"),
            "program_type",
            "education_level",
            "prog_name",
            "design_version",
            "seed_version",
            "current_version",
            F.col("modality").alias("seed_modality"),
            "lms_id",
        )

    return one(t.table("seeds"), 4).unionByName(one(t.table("seeds_induction"), 6))


def seeded(t: LmsTables) -> DataFrame:
    """Courses of the analyst catalogue: older programme code, joined to seeds.

    Several seeds may share a code; the course row then repeats, as in SQL.
    """
    c = real_courses(t).select(
        F.col("id").alias("course_id"),
        "idnumber",
        "fullname",
        "category",
        "visible",
        "startdate",
        "enddate",
        F.col("timecreated").alias("course_created"),
        X.short_program_code(F.col("shortname")).alias("short_code"),
        X.region_code(F.col("shortname")).alias("region_code"),
        X.center_code(F.col("shortname")).alias("center_code"),
    )
    s = seeds(t)
    on = (c["short_code"] == s["seed_code"]) & (c["category"] == s["seed_category"])
    return c.join(s, on, "left").withColumn(
        "seed_version_label",
        X.or_undefined(
            F.coalesce(*[F.col(v).cast("string") for v in ("current_version", "design_version", "seed_version")])
        ),
    )

"""Analyst catalogue: twelve reports without parameters.

Their rules differ from the current reports: programme data come from the
seeds, any view counts as access, and rows are not merged per user and course.
Events are counted per course and user, or finer, before course attributes and
seeds are joined, so wide text never travels with the log itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import labels as L
from lectern.functions import text as X
from lectern.functions.filters import ilike_any
from lectern.functions.times import local_date, local_ts, ratio_2dp, stamp, stamp_or
from lectern.operators import access, courses, enrolments, people, timeontask, tools
from lectern.operators.skew import join_hot
from lectern.plans import catalogue_columns as C
from lectern.plans.columns import printed
from lectern.plans.reports import down, up
from lectern.settings import Settings
from lectern.sources import LmsTables

PAIR = ["userid", "course_id"]

# Text that marks video sessions in the log.
VIDEO_COMPONENTS = ("bigbluebutton", "zoom", "teams", "webex")
VIDEO_EVENTS = ("bigbluebutton", "zoom", "meeting", "session")


def _home(t: LmsTables, s: Settings) -> DataFrame:
    """Courses with seed data and the labels shared by the catalogue."""
    start, end = F.col("startdate"), F.col("enddate")
    return courses.seeded(t).select(
        "*",
        X.or_undefined(F.col("education_level")).alias("level"),
        X.or_undefined(F.col("seed_modality")).alias("modality"),
        X.or_undefined(F.col("region_code")).alias("region"),
        X.or_undefined(F.col("center_code")).alias("center"),
        X.or_undefined(F.coalesce("short_code", "seed_code")).alias("program_code"),
        X.or_undefined(F.col("prog_name")).alias("program"),
        F.col("seed_version_label").alias("version"),
        L.course_state(F.col("visible"), start, end, s.now()).alias("course_state"),
        stamp(start, s.report_tz).alias("start_text"),
        stamp_or(end, s.report_tz, L.UNSET_DATE).alias("end_text"),
        stamp_or(end, s.report_tz, L.UNSET_DATE, null_is_unset=False).alias("end_text_zero"),
    )


HEAD = ("idnumber", "fullname", "level", "modality", "region", "center", "program_code", "program")


def _grouped(rows: DataFrame, own: str, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that share all labels get one short id.

    Returns (``own``, gid) to join with facts, one row for each row of ``rows``, and (gid, labels)
    to join after the last aggregation, so that no label travels with the facts.
    """
    marked = rows.select(own, F.unhex(F.md5(F.to_json(F.struct(*labels)))).alias("gid"), *labels)
    return marked.select(own, "gid"), marked.drop(own).dropDuplicates(["gid"])


def _added(parts: list[DataFrame], keys: list[str], measures: dict) -> DataFrame:
    """Relations of the same grain side by side; sums without a row are 0, and NULL keys meet."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    sums = [m for m, how in measures.items() if how is F.sum]
    return rows.groupBy(*keys).agg(*[how(m).alias(m) for m, how in measures.items()]).na.fill(0, sums)


def _persons(t: LmsTables) -> DataFrame:
    return people.present_users(t).select(
        F.col("id").alias("userid"),
        "username",
        "email",
        "lastaccess",
        X.full_name(F.col("firstname"), F.col("lastname")).alias("person"),
    )


def _role_text(t: LmsTables) -> DataFrame:
    return people.roles_by_user_course(t).select(*PAIR, "role_names")


def _role_or_none() -> Column:
    return F.coalesce("role_names", F.lit("Sin rol asignado"))


# -- 0 --------------------------------------------------------------------------


def dashboard_totals(t: LmsTables) -> DataFrame:
    """One row of totals; each figure is its own aggregate, stacked and pivoted."""
    users = t.user
    present = F.col("deleted") == 0
    active = present & (F.col("suspended") == 0)

    def figure(df: DataFrame, **tests: Column) -> DataFrame:
        """One-row counts turned into (name, n) rows."""
        row = df.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])
        return row.unpivot([], list(tests), "name", "n")

    def everything(df: DataFrame, name: str) -> DataFrame:
        return figure(df, **{name: F.lit(True)})

    kind = F.when(F.col("shortname").isin(*people.TEACHERS), "teacher").when(
        F.col("shortname") == people.STUDENT, "student"
    )
    holders = (
        people.assigned(t)
        .join(people.roles(t), "roleid")
        .select("userid", kind.alias("kind"))
        .filter(F.col("kind").isNotNull())
        .distinct()
        .join(users.select(F.col("id").alias("userid"), "deleted", "suspended"), "userid")
    )
    known = users.select(F.col("id").alias("userid"))
    used = (
        people.assigned(t)
        .join(known, "userid", "left_semi")
        .select("contextid")
        .distinct()
        .join(people.contexts(t, people.COURSE), "contextid")
        .select("course_id")
        .distinct()
        .join(courses.real_courses(t).select(F.col("id").alias("course_id"), "visible"), "course_id")
    )
    seen = t.log.select("userid").distinct().join(known, "userid", "left_semi")
    teacher, student = F.col("kind") == "teacher", F.col("kind") == "student"
    figures = [
        figure(users, users=present, users_active=active),
        figure(
            holders,
            teachers=teacher & present,
            teachers_active=teacher & active,
            students=student & present,
            students_active=student & active,
        ),
        figure(used, courses=F.lit(True), courses_active=F.col("visible") == 1),
        everything(seen, "users_seen"),
        everything(t.assign, "assigns"),
        everything(t.quiz, "quizzes"),
        everything(t.feedback, "feedbacks"),
        figure(
            t.forum,
            forums=~F.col("type").isin("news", "blog"),
            blogs=(F.col("type") == "blog") | F.col("name").ilike("Blog%"),
        ),
        everything(t.wiki, "wikis"),
    ]
    rows = reduce(DataFrame.unionByName, figures)
    one = rows.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in C.DASHBOARD])
    return printed(one, C.DASHBOARD)


# -- 1 --------------------------------------------------------------------------


def registro_usuarios(t: LmsTables, s: Settings) -> DataFrame:
    """One row per enrolment, with access counts of the user in the course."""
    # One entry per pair first; the many enrolment rows are joined to it once.
    known = access.course_access(t, s, target=None).join(_role_text(t), PAIR, "full")
    rows = enrolments.rows(t).select(F.col("id").alias("enrolment_id"), *PAIR)
    df = (
        join_hot(rows, known, "left")
        .join(_home(t, s), "course_id")
        .join(_persons(t).join(people.profile_documents(t), "userid", "left"), "userid")
    )
    df = df.select(
        "*",
        _role_or_none().alias("role_text"),
        stamp_or(F.col("first_access"), s.report_tz, "Sin acceso").alias("first_access_text"),
        stamp_or(F.col("lastaccess"), s.report_tz, "Sin acceso").alias("last_lms_access"),
    )
    df = df.withColumns(
        {
            "document_type": X.or_undefined(F.col("document_type")),
            "document": F.coalesce("document", "username"),
            "access_days": F.coalesce("access_days", F.lit(0)),
            "accesses": F.coalesce("accesses", F.lit(0)),
        }
    )
    return printed(df.orderBy(up("fullname"), up("role_text"), up("person"), "enrolment_id"), C.REGISTRO)


# -- 2 --------------------------------------------------------------------------


def ingresos(t: LmsTables, s: Settings) -> DataFrame:
    """Views by year, month, ISO week, hour band, address and access origin."""
    at = local_ts(F.col("timecreated"), s.report_tz)
    keys = ["year", "month", "week", "hour", "ip", "origin"]
    per_user = (
        t.log.filter((F.col("userid") > 0) & (F.col("action") == "viewed"))
        .select(
            "userid",
            F.year(at).alias("year"),
            F.month(at).alias("month"),
            F.weekofyear(at).alias("week"),
            F.date_format(at, "HH:00:00").alias("hour"),
            F.coalesce("ip", F.lit("Sin IP")).alias("ip"),
            F.coalesce("origin", F.lit("Sin origen")).alias("origin"),
        )
        .groupBy("userid", *keys)
        .agg(F.count("*").alias("n"))
    )
    # One row per user and key now, so counting rows counts users.
    df = (
        per_user.join(people.present_users(t).select(F.col("id").alias("userid")), "userid", "left_semi")
        .groupBy(*keys)
        .agg(F.sum("n").alias("events"), F.count("*").alias("users"))
    )
    for name in ("system", "browser", "country", "city"):
        df = df.withColumn(name, F.lit(L.NOT_IN_LOG))
    order = [down("year"), down("month"), down("week"), down("hour"), up("ip"), up("origin")]
    return printed(df.orderBy(*order), C.INGRESOS)


# -- 3 --------------------------------------------------------------------------


def matriculas(t: LmsTables, s: Settings) -> DataFrame:
    """One row per enrolment with its dates."""
    rows = enrolments.rows(t).select(
        F.col("id").alias("enrolment_id"),
        *PAIR,
        F.when(F.col("status") == 0, "Activo").otherwise("Suspendido").alias("enrolment_state"),
        stamp(F.col("timecreated"), s.report_tz).alias("enrolled_text"),
        stamp(F.col("timemodified"), s.report_tz).alias("changed_text"),
    )
    df = (
        join_hot(rows, _role_text(t), "left")
        .join(_home(t, s), "course_id")
        .join(_persons(t), "userid")
        .withColumn("role_text", _role_or_none())
        .withColumn("document", F.col("username"))
        .withColumn("end_text", F.col("end_text_zero"))
    )
    return printed(df.orderBy(up("fullname"), up("role_text"), up("person"), "enrolment_id"), C.MATRICULAS)


# -- 4 --------------------------------------------------------------------------


def usuarios_ambiente(t: LmsTables, s: Settings) -> DataFrame:
    """User counts by creation month and origin."""
    at = local_ts(F.col("timecreated"), s.report_tz)
    df = (
        t.user.filter(F.col("id") > 2)
        .groupBy(F.year(at).alias("year"), F.month(at).alias("month"), L.auth_origin(F.col("auth")).alias("origin"))
        .agg(
            F.count("*").alias("users"),
            F.count_if((F.col("deleted") == 0) & (F.col("suspended") == 0)).alias("active"),
            F.count_if(F.col("suspended") == 1).alias("suspended"),
            F.count_if(F.col("deleted") == 1).alias("deleted"),
        )
        .withColumn("environment", F.lit(s.environment))
    )
    return printed(df.orderBy(down("year"), down("month"), up("origin")), C.USUARIOS)


# -- 5 --------------------------------------------------------------------------


def fichas_programas(t: LmsTables, s: Settings) -> DataFrame:
    """Courses with seeds and counts of people holding a role."""
    kind = F.when(F.col("shortname").isin(*people.TEACHERS), "teacher").when(
        F.col("shortname") == people.STUDENT, "student"
    )
    # Whether a person is a student and/or a teacher, one row per person.
    persons = (
        people.course_assignments(t)
        .groupBy(*PAIR)
        .agg(
            F.bool_or(F.coalesce(kind, F.lit("")) == "student").alias("student"),
            F.bool_or(F.coalesce(kind, F.lit("")) == "teacher").alias("teacher"),
        )
    )
    counts = persons.groupBy("course_id").agg(
        F.count_if("student").alias("students"),
        F.count_if("teacher").alias("teachers"),
        F.count("*").alias("persons"),
    )
    df = (
        _home(t, s)
        .join(counts, "course_id", "left")
        .na.fill(0, ["students", "teachers", "persons"])
        .withColumn("created_text", stamp(F.col("course_created"), s.report_tz))
        .withColumn("end_text", F.col("end_text_zero"))
    )
    return printed(df.orderBy(down("course_created"), up("fullname"), "course_id"), C.FICHAS)


# -- 6 --------------------------------------------------------------------------


def trafico_diario(t: LmsTables, s: Settings) -> DataFrame:
    """Day and origin: events, unique users, active courses."""
    homes = t.course.select(
        F.col("id").alias("courseid"),
        L.origin(F.col("shortname").rlike(X.INTEGRATED_STRICT)).alias("origin"),
    )
    # One row per day, user and course keeps the event count as a sum.
    daily = (
        t.log.filter((F.col("userid") > 0) & (F.col("action") == "viewed") & F.col("courseid").isNotNull())
        .groupBy(local_date(F.col("timecreated"), s.report_tz).alias("day"), "userid", "courseid")
        .agg(F.count("*").alias("n"))
        .join(people.present_users(t).select(F.col("id").alias("userid")), "userid", "left_semi")
        .join(homes, "courseid")
    )
    # Two groupings in two steps each, instead of one that repeats every row per distinct count.
    by_user = daily.groupBy("day", "origin", "userid").agg(F.sum("n").alias("n"))
    events = by_user.groupBy("day", "origin").agg(F.sum("n").alias("events"), F.count("userid").alias("users"))
    active = daily.select("day", "origin", "courseid").distinct()
    courses_ = active.groupBy("day", "origin").agg(F.count("courseid").alias("courses"))
    df = _added([events, courses_], ["day", "origin"], {"events": F.sum, "users": F.sum, "courses": F.sum})
    return printed(df.orderBy(down("day"), up("origin")), C.TRAFICO)


# -- 7 --------------------------------------------------------------------------


def uso_herramientas(t: LmsTables, s: Settings) -> DataFrame:
    """Course and module kind: modules, uses, users, first and last use."""
    cm = tools.modules(t, deleting="all").select("module_id", "course_id", "module_name")
    uses = (
        t.log.filter(F.col("contextlevel") == people.MODULE)
        .groupBy(
            F.col("courseid").alias("course_id"), F.col("contextinstanceid").alias("module_id"), "userid"
        )
        .agg(F.count("id").alias("n"), F.min("timecreated").alias("first"), F.max("timecreated").alias("last"))
    )
    keys = [*HEAD, "education_level", "seed_modality", "region_code", "center_code"]
    keys += ["short_code", "seed_code", "prog_name"]
    groups, labels = _grouped(_home(t, s), "course_id", keys)
    kind = ["gid", "module_name"]
    items = cm.join(groups, "course_id").groupBy(*kind).agg(F.count_distinct("module_id").alias("items"))
    used = (
        cm.join(uses, ["course_id", "module_id"])
        .join(groups, "course_id")
        .groupBy(*kind, "userid")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
        .groupBy(*kind)
        .agg(
            F.sum("n").alias("uses"),
            F.count("userid").alias("users"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
        )
    )
    measures = {"items": F.sum, "uses": F.sum, "users": F.sum, "first": F.min, "last": F.max}
    df = _added([items, used], kind, measures).join(labels, "gid")
    df = df.select(
        "*",
        F.coalesce(stamp(F.col("first"), s.report_tz), F.lit("Sin uso")).alias("first_text"),
        F.coalesce(stamp(F.col("last"), s.report_tz), F.lit("Sin uso")).alias("last_text"),
    )
    return printed(df.orderBy(up("fullname"), down("uses"), up("module_name"), up("idnumber")), C.USO)


# -- 7B -------------------------------------------------------------------------


def _stack(t: LmsTables, s: Settings) -> DataFrame:
    """Participation counts of the catalogue, one union and one aggregation."""
    names = (
        "accesses", "blogs", "quizzes", "assignments", "discussions", "replies", "surveys", "wikis", "scorm",
    )
    p = tools.Period(tz=s.report_tz)

    forum = t.forum.select(F.col("id").alias("forum"), F.col("course").alias("course_id"), "type", "name")
    places = t.forum_discussions.select(F.col("id").alias("discussion"), "forum").join(forum, "forum")
    talk = ~F.col("type").isin("news", "blog")
    # Posts are counted per discussion and user; only these counts look up their forum.
    posts = (
        t.forum_posts.groupBy("discussion", "userid")
        .agg(F.count_if(F.col("parent") == 0).alias("openings"), F.count_if(F.col("parent") != 0).alias("replies"))
        .join(places, "discussion")
        .groupBy(*PAIR, "type", "name")
        .agg(F.sum("openings").alias("openings"), F.sum("replies").alias("replies"))
    )
    is_blog = (F.col("type") == "blog") | F.col("name").ilike("Blog%")
    named = F.upper("name") != "ANUNCIOS"
    log = t.log.withColumnRenamed("courseid", "course_id")
    identified = (F.col("userid") > 0) & F.col("course_id").isNotNull()
    viewed = (F.col("action") == "viewed") & identified
    quiz = (
        (F.col("objecttable") == "quiz_attempts")
        & (F.col("target") == "attempt")
        & (F.col("action") == "submitted")
    )
    wiki = (F.col("component") == "mod_wiki") & F.col("eventname").like("%page_updated%")
    package = (F.col("component") == "mod_scorm") & identified
    logged = (
        log.filter(viewed | quiz | wiki | package)
        .groupBy(*PAIR)
        .agg(
            F.count_if(viewed).alias("accesses"),
            F.count_if(quiz).alias("quizzes"),
            F.count_if(wiki).alias("wikis"),
            F.count_if(package).alias("scorm"),
        )
    )
    parts = [
        logged,
        posts.select(
            *PAIR,
            F.when(is_blog, F.col("openings")).alias("blogs"),
            F.when(talk & named, F.col("replies")).alias("replies"),
        ),
        tools.assignments(t, p, ("submitted", "draft")).withColumnRenamed("total", "assignments"),
        tools.discussions_opened(t, p).withColumnRenamed("total", "discussions"),
        tools.survey_parts(t, p).withColumnRenamed("total", "surveys"),
    ]
    total = reduce(lambda a, b: a + b, [F.col(n) for n in names])
    return tools.stacked(parts, names).withColumn("total", total)


def participacion(t: LmsTables, s: Settings) -> DataFrame:
    """Participation per user and course with a grand total."""
    pairs = enrolments.rows(t).select(*PAIR).distinct()
    counted = _stack(t, s)
    df = (
        pairs.join(counted, PAIR, "left")
        .join(_role_text(t), PAIR, "left")
        .join(_home(t, s), "course_id")
        .join(_persons(t), "userid")
        .na.fill(0, [c for c in counted.columns if c not in PAIR])
        .withColumn("role_text", _role_or_none())
        .withColumn("document", F.col("username"))
    )
    return printed(df.orderBy(up("idnumber"), up("person"), "course_id", "userid"), C.PARTICIPACION)


# -- 8A -------------------------------------------------------------------------


def tiempo_herramienta(t: LmsTables, s: Settings) -> DataFrame:
    """Estimated time per user, course and module kind, with its share.

    The share needs the user-course total over already summed rows; that window
    holds one row per module kind, not one per event.
    """
    spent = (
        timeontask.per_instance(t, s)
        .join(timeontask.module_kinds(t), "module_id", "left")
        .groupBy(*PAIR, "module_name")
        .agg(F.sum("seconds").alias("seconds"))
    )
    whole = Window.partitionBy(*PAIR)
    keys = [*HEAD, "education_level", "seed_modality", "short_code", "seed_code", "prog_name"]
    groups, labels = _grouped(_home(t, s), "course_id", keys)
    df = (
        spent.join(groups, "course_id")
        .groupBy(*PAIR, "module_name", "gid")
        .agg(F.sum("seconds").alias("seconds"))
        .withColumn("all_seconds", F.sum("seconds").over(whole))
        .join(_persons(t).select("userid", "username", "person"), "userid")
        .join(labels, "gid")
    )
    df = df.select(
        "*",
        F.col("username").alias("document"),
        F.coalesce("module_name", F.lit("Curso / LMS")).alias("tool"),
        ratio_2dp(F.col("seconds"), F.lit(60)).alias("minutes"),
        ratio_2dp(F.col("seconds"), F.lit(3600)).alias("hours"),
        ratio_2dp(F.col("seconds") * 100, F.col("all_seconds")).alias("share"),
    )
    order = [up("fullname"), up("person"), down("minutes"), "course_id", "userid", up("tool")]
    return printed(df.orderBy(*order), C.TIEMPO)


# -- 8B, 8C ---------------------------------------------------------------------


def sesiones_log(t: LmsTables, s: Settings) -> DataFrame:
    """Video sessions inferred from the text of log events."""
    video = ilike_any(F.col("component"), VIDEO_COMPONENTS) | ilike_any(F.col("eventname"), VIDEO_EVENTS)
    what = ["component", "eventname", "objecttable", "objectid"]
    per_user = (
        access.of_course_users(t.log)
        .filter(video)
        .groupBy(*PAIR, *what)
        .agg(F.count("*").alias("n"), F.min("timecreated").alias("first"), F.max("timecreated").alias("last"))
    )
    keys = [*HEAD, "education_level", "seed_modality", "short_code", "seed_code", "prog_name"]
    groups, labels = _grouped(_home(t, s), "course_id", keys)
    times = (F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    df = (
        per_user.join(groups, "course_id")
        .groupBy("gid", *what, "userid")
        .agg(*times)
        .groupBy("gid", *what)
        .agg(*times, F.count("userid").alias("users"))
        .withColumnRenamed("n", "events")
        .join(labels, "gid")
        .withColumn("first_text", stamp(F.col("first"), s.report_tz))
        .withColumn("last_text", stamp(F.col("last"), s.report_tz))
    )
    order = [down("first_text"), up("idnumber"), *[up(w) for w in what]]
    return printed(df.orderBy(*order), C.SESIONES_LOG)


def sesiones_bbb(t: LmsTables, s: Settings) -> DataFrame:
    """Sessions with participants and event counts."""
    per_user = t.bigbluebuttonbn_logs.groupBy(F.col("bigbluebuttonbnid").alias("session_id"), "userid").agg(
        F.count("id").alias("n")
    )
    held = t.bigbluebuttonbn.select(
        F.col("id").alias("session_id"),
        F.col("course").alias("course_id"),
        F.col("name").alias("session_name"),
        "openingtime",
        "closingtime",
    )
    homes = courses.real_courses(t).select(F.col("id").alias("course_id"), "idnumber", "fullname")
    held = held.join(homes, "course_id")
    keys = ["idnumber", "fullname", "session_name", "openingtime", "closingtime"]
    groups, labels = _grouped(held, "session_id", keys)
    counts = (
        per_user.join(groups, "session_id")
        .groupBy("gid", "userid")
        .agg(F.sum("n").alias("n"))
        .groupBy("gid")
        .agg(F.count("userid").alias("users"), F.sum("n").alias("events"))
    )
    df = labels.join(counts, "gid", "left").na.fill(0, ["users", "events"])
    df = df.select(
        "*",
        stamp(F.col("openingtime"), s.report_tz).alias("opening_text"),
        stamp_or(F.col("closingtime"), s.report_tz, L.UNSET_DATE, null_is_unset=False).alias("closing_text"),
    )
    return printed(df.orderBy(down("opening_text"), up("idnumber"), up("session_name")), C.SESIONES_BBB)

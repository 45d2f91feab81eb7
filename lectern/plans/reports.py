"""The ten current reports.

Filters on courses and people narrow the facts before these are aggregated to
the report's grain (``operators/narrow.py``); the joins with names come after,
then the sort, and renaming to the printed labels is the last step. Sort keys end with the ids of the row, which makes the order
total and lets the range sort cut between rows whose names are equal.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import labels as L
from lectern.functions import params as Q
from lectern.functions import text as X
from lectern.functions.filters import Optional
from lectern.functions.times import ratio_2dp, stamp, stamp_or
from lectern.operators import access, courses, enrolments, online, people, timeontask, tools
from lectern.operators.narrow import is_set, narrowed
from lectern.operators.skew import join_hot
from lectern.plans import columns as C
from lectern.settings import Settings
from lectern.sources import LmsTables

PAIR = ["userid", "course_id"]
Params = Mapping[str, Any] | None
MEASURE_NAMES = tools.MEASURES


# Filters on what is known of a course, and of a person.
COURSE_FILTERS = (
    "codigo_ficha", "nombre_ficha", "codigo_programa", "nombre_programa", "nivel", "modalidad", "regional",
    "centro_formacion", "estado_grupo", "origen_datos",
)
PERSON_FILTERS = ("identificacion", "nombres_apellidos", "estado_usuario")


def facts(
    t: LmsTables, p: Mapping, home: DataFrame, persons: DataFrame | None = None, more: tuple[str, ...] = ()
) -> LmsTables:
    """The tables that facts are counted from: only kept courses and people where filters say which.

    ``more`` names further parameters that select courses in this report.
    """
    return narrowed(
        t,
        home.select("course_id") if is_set(p, (*COURSE_FILTERS, *more)) else None,
        persons.select("userid") if persons is not None and is_set(p, PERSON_FILTERS) else None,
    )


def up(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def down(name: str) -> Column:
    return F.col(name).desc_nulls_first()


def _optional(df: DataFrame, params: dict, s: Settings) -> Optional:
    return Optional(df, params, s.report_tz, s.raw_patterns)


def _course_filters(df: DataFrame, p: dict, s: Settings, whole_code: bool = False) -> DataFrame:
    """Filters on what is known of a course; absent parameters add nothing."""
    q = _optional(df, p, s)
    q = q.whole("codigo_ficha", F.col("idnumber")) if whole_code else q.contains("codigo_ficha", F.col("idnumber"))
    return (
        q.contains("nombre_ficha", F.col("fullname"))
        .contains("codigo_programa", F.coalesce("program_code", F.lit("")))
        .contains("nombre_programa", F.col("program_title"))
        .contains("nivel", F.col("level"))
        .contains("modalidad", F.col("modality"))
        .contains("regional", F.col("region_name"))
        .contains("centro_formacion", F.col("center_name"))
        .equals("estado_grupo", F.col("course_state"))
        .equals("origen_datos", F.col("origin"))
        .df
    )


def _course_dates(df: DataFrame, s: Settings, null_is_unset: bool = True, plain_start: bool = False) -> DataFrame:
    start = (
        stamp(F.col("startdate"), s.report_tz)
        if plain_start
        else stamp_or(F.col("startdate"), s.report_tz, L.UNSET_DATE, null_is_unset)
    )
    return df.withColumn("start_text", start).withColumn(
        "end_text", stamp_or(F.col("enddate"), s.report_tz, L.UNSET_DATE, null_is_unset)
    )


def _people(t: LmsTables, kinds: tuple[str, ...], base: Column | None = None) -> DataFrame:
    """User columns of the reports, with the document taken from ``base``."""
    shown = F.col("username") if base is None else base
    return t.user.select(
        F.col("id").alias("userid"),
        "username",
        "deleted",
        "suspended",
        "lastaccess",
        "email",
        shown.alias("identity"),
        X.document_type(shown, kinds).alias("document_type"),
        X.document_number(shown, kinds).alias("document"),
        X.full_name(F.col("firstname"), F.col("lastname")).alias("person"),
        L.user_state(F.col("deleted"), F.col("suspended")).alias("user_state"),
    )


def _with_roles(df: DataFrame, t: LmsTables) -> DataFrame:
    return df.join(people.roles_by_user_course(t), PAIR, "left").withColumn(
        "role_text", F.coalesce("role_names", F.lit("Sin rol asignado"))
    )


# -- 1 --------------------------------------------------------------------------


def registro_usuarios(t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """Enrolled users per course with their access counts (0 without access)."""
    p = Q.clean("registro_usuarios", params)
    home = _course_filters(courses.described(t, s), p, s, whole_code=True)
    persons = (
        _optional(_people(t, X.DOCUMENT_KINDS).filter(F.col("deleted") == 0), p, s)
        .contains("identificacion", F.col("username"))
        .contains("nombres_apellidos", F.col("person"))
        .df
    )
    few = facts(t, p, home, persons)
    seen = access.course_access(few, s, p["fecha_inicio"], p["fecha_fin"], p["hora"])
    pairs = _optional(enrolments.any_active(few), p, s).equals("estado_aprendiz", F.col("enrolment_state")).df
    df = pairs.join(seen, PAIR, "left")
    df = _optional(_with_roles(df, few), p, s).contains("rol_usuario", F.col("role_shortnames")).df
    df = df.join(home, "course_id").join(persons, "userid")
    df = _course_dates(df, s).select(
        "*",
        stamp_or(F.col("first_access"), s.report_tz, "Sin acceso").alias("first_access_text"),
        stamp_or(F.col("lastaccess"), s.report_tz, "Sin acceso").alias("last_lms_access"),
    )
    df = df.na.fill(0, ["access_days", "accesses"])
    return C.printed(
        df.orderBy(up("fullname"), up("role_text"), up("person"), "course_id", "userid"), C.REGISTRO_USUARIOS
    )


# -- 2 --------------------------------------------------------------------------


def login_totals(t: LmsTables, p: dict, s: Settings, keys: list[str]) -> DataFrame:
    """Logins and users by role text and the given keys.

    Events are counted per user and address before users and roles are joined.
    A user has one role text and one place, so counting these rows per final
    group is counting users.
    """
    rows = (
        _optional(access.login_rows(t, s, p["fecha_desde"], p["fecha_hasta"]), p, s)
        .number("mes", F.month("login_at"))
        .number("semana", F.weekofyear("login_at"))
        .hour("hora", F.col("timecreated"))
        .df
    )
    own = [k for k in keys if k == "ip"]
    per_user = rows.groupBy("userid", *own).agg(F.count("*").alias("n"))
    places = (
        _optional(access.profiles(t), p, s)
        .contains("pais", F.col("country"))
        .contains("ciudad", F.col("city"))
        .df
    )
    roles = people.roles_by_user(t).select("userid", "role_names")
    known = places.join(roles, "userid", "left")
    return (
        join_hot(per_user, known, keys=["userid"])
        .withColumn("role_text", F.coalesce("role_names", F.lit("Sin rol")))
        .groupBy("role_text", *keys)
        .agg(F.sum("n").alias("logins"), F.count("*").alias("users"))
        .withColumn("system", F.lit(L.NOT_IN_LOG))
        .withColumn("browser", F.lit(L.NOT_IN_LOG))
    )


def ingresos_sistema(t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """Logins by role, country, city and address."""
    keys = ["country", "city", "ip"]
    df = login_totals(t, Q.clean("ingresos_sistema", params), s, keys)
    order = [down("logins"), down("users"), up("role_text"), *[up(k) for k in keys]]
    return C.printed(df.orderBy(*order), C.INGRESOS_SISTEMA)


# -- 3 --------------------------------------------------------------------------


def enrolment_courses(t: LmsTables, p: dict, s: Settings) -> DataFrame:
    """Courses of the enrolment report; its course dates are compared by equality."""
    return (
        _optional(_course_filters(courses.described(t, s), p, s), p, s)
        .on_day("fecha_inicio", F.col("startdate"))
        .on_day("fecha_fin", F.col("enddate"), must_be_set=True)
        .df
    )


def matriculas_lms(t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """Users enrolled in a course during a period."""
    p = Q.clean("matriculas_lms", params)
    home = enrolment_courses(t, p, s)
    few = facts(t, p, home, more=("fecha_inicio", "fecha_fin"))
    df = enrolments.in_period(few, p["fecha_desde"], p["fecha_hasta"], s)
    df = _optional(_with_roles(df, few), p, s).contains("rol_usuario", F.col("role_shortnames")).df
    df = df.join(home, "course_id").join(
        _people(t, X.DOCUMENT_KINDS).filter(F.col("deleted") == 0), "userid"
    )
    df = _course_dates(df, s).select(
        "*",
        stamp_or(F.col("first_start"), s.report_tz, L.UNSET_DATE).alias("enrolled_text"),
        stamp_or(F.col("last_end"), s.report_tz, L.UNSET_DATE).alias("left_text"),
    )
    return C.printed(
        df.orderBy(up("fullname"), up("role_text"), up("person"), "course_id", "userid"), C.MATRICULAS_LMS
    )


# -- 4 --------------------------------------------------------------------------


def usuarios_ambiente(t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """Users of the installation, with roles, state and creator."""
    p = Q.clean("usuarios_ambiente", params)
    made = F.col("timecreated")
    local = F.from_utc_timestamp(F.timestamp_seconds(made), s.report_tz)
    users = (
        _optional(t.user.filter(F.col("id") > 2), p, s)
        .number("mes", F.month(local))
        .number("anio", F.year(local))
        .equals("origen_datos", L.auth_origin(F.col("auth")))
        .since("fecha_desde", made)
        .until("fecha_hasta", made)
        .df
    )
    roles = people.roles_by_user(t, people.SYSTEM, people.CATEGORY, people.COURSE)
    made_by = people.creators(t).withColumnRenamed("created_userid", "id")
    df = users.join(roles.withColumnRenamed("userid", "id"), "id", "left").join(made_by, "id", "left")
    kinds = X.DOCUMENT_KINDS_WITH_TI
    df = df.select(
        "id",
        "lastname",
        "firstname",
        "auth",
        F.lit(s.environment).alias("environment"),
        F.coalesce("role_names", F.lit("Sin rol")).alias("role_text"),
        X.document_type(F.col("username"), kinds).alias("document_type"),
        X.document_number(F.col("username"), kinds).alias("document"),
        X.full_name(F.col("firstname"), F.col("lastname")).alias("person"),
        L.user_state(F.col("deleted"), F.col("suspended")).alias("user_state"),
        L.auth_origin(F.col("auth")).alias("auth_origin"),
        stamp_or(made, s.report_tz, "No disponible").alias("created_text"),
        F.when(F.col("lastaccess") > 0, stamp(F.col("lastaccess"), s.report_tz))
        .otherwise("Sin acceso")
        .alias("last_lms_access"),
        F.coalesce("creator_name", F.lit("No disponible")).alias("creator"),
    )
    return C.printed(df.orderBy(up("lastname"), up("firstname"), "id"), C.USUARIOS_AMBIENTE)


# -- 5 --------------------------------------------------------------------------


def courses_with_role(t: LmsTables, role: str) -> DataFrame:
    """Courses in which somebody holds the role."""
    wanted = t.role.filter(F.col("shortname") == role).select(F.col("id").alias("roleid"))
    held = people.assigned(t).join(wanted, "roleid", "left_semi").select("contextid").distinct()
    return people.contexts(t, people.COURSE).join(held, "contextid", "left_semi").select("course_id").distinct()


def courses_with_student_state(t: LmsTables, state: str, s: Settings) -> DataFrame:
    """Courses with a student whose enrolment is in the given state."""
    students = (
        people.course_assignments(t).filter(F.col("shortname") == people.STUDENT).select(*PAIR).distinct()
    )
    return (
        enrolments.valid_now(t, s)
        .filter(F.col("valid_state") == state)
        .join(students, PAIR, "left_semi")
        .select("course_id")
        .distinct()
    )


# Further parameters that select courses in the programme report.
PROGRAMME_FILTERS = (
    "estado_grupo_sofia", "hora_creacion", "fecha_desde", "fecha_hasta", "hora_grupo", "fecha_inicio", "fecha_fin",
    "rol_usuario", "estado_aprendiz",
)


def programme_courses(t: LmsTables, p: dict, s: Settings) -> DataFrame:
    """Courses of the programme report, by everything but student state."""
    made, start, end = F.col("course_created"), F.col("startdate"), F.col("enddate")
    home = (
        _optional(_course_filters(courses.described(t, s), p, s), p, s)
        .constant("estado_grupo_sofia", L.NOT_AVAILABLE)
        .hour("hora_creacion", made)
        .since("fecha_desde", made)
        .until("fecha_hasta", made)
        .hour("hora_grupo", start)
        .since("fecha_inicio", start, must_be_set=True)
        .until("fecha_fin", end, must_be_set=True)
        .df
    )
    if p["rol_usuario"] is not None:
        home = home.join(courses_with_role(t, p["rol_usuario"]), "course_id", "left_semi")
    return home


def fichas_programas(t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """Courses and their programmes, with people counts."""
    p = Q.clean("fichas_programas", params)
    made = F.col("course_created")
    home = programme_courses(t, p, s).filter(made <= s.now())
    if p["estado_aprendiz"] is not None:
        home = home.join(courses_with_student_state(t, p["estado_aprendiz"], s), "course_id", "left_semi")
    counts = ["teachers_active", "students_active", "teachers_inactive", "students_inactive"]
    few = facts(t, p, home, more=PROGRAMME_FILTERS)
    df = home.join(enrolments.role_counts(few, s), "course_id", "left").na.fill(0, counts)
    df = _course_dates(df, s).select(
        "*",
        stamp_or(made, s.report_tz, L.UNSET_DATE).alias("created_text"),
        F.lit(L.NOT_AVAILABLE).alias("program_state"),
        F.lit(L.NOT_AVAILABLE).alias("external_state"),
    )
    return C.printed(
        df.orderBy(down("course_created"), up("fullname"), "course_id"), C.FICHAS_PROGRAMAS
    )


# -- 6 --------------------------------------------------------------------------


def trafico_diario(t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """Unique users per day, summed to day, month or year, by course origin."""
    p = Q.clean("trafico_diario", params)
    span = Q.normal_range(p["rango_consulta"])
    valid = access.valid_access(t, s, p["fecha_desde"], p["fecha_hasta"], Q.normal_origin(p["origen_datos"]))
    totals = (
        access.by_period(access.unique_user_days(valid), span)
        .groupBy("origin", "period")
        .agg(F.count("*").alias("users"))
    )
    period = F.col("period")
    nothing = F.lit(None).cast("int")
    text = {"Día": "yyyy/MM/dd", "Mes": "yyyy/MM", "Año": "yyyy"}[span]
    df = totals.select(
        "*",
        F.lit(s.traffic_environment).alias("environment"),
        F.lit(span).alias("range"),
        F.year(period).alias("year"),
        (nothing if span == "Año" else F.month(period)).alias("month"),
        (F.dayofmonth(period) if span == "Día" else nothing).alias("day_of_month"),
        F.date_format(period, text).alias("period_text"),
    )
    return C.printed(df.orderBy(down("period"), up("environment"), up("origin")), C.TRAFICO_DIARIO)


# -- 7 --------------------------------------------------------------------------


def _usage_courses(t: LmsTables, p: dict, s: Settings, whole_code: bool) -> DataFrame:
    sought = dict(p)
    if sought["origen_datos"] is not None and sought["origen_datos"].lower() in ("todas", "todos"):
        sought["origen_datos"] = None
    home = (
        _optional(_course_filters(courses.described(t, s), sought, s, whole_code), p, s)
        .hour("hora_grupo", F.col("startdate"), must_be_set=True)
        .since("fecha_inicio", F.col("startdate"), must_be_set=True)
        .until("fecha_fin", F.col("enddate"), must_be_set=True)
        .df
    )
    if p["rol_usuario"] is not None:
        home = home.join(courses_with_role(t, p["rol_usuario"]), "course_id", "left_semi")
    return home


def _usage_report(t: LmsTables, params: Params, s: Settings, simple: bool) -> DataFrame:
    p = Q.clean("uso_herramientas", params)
    period = tools.Period(p["fecha_desde"], p["fecha_hasta"], s.report_tz)
    home = _usage_courses(t, p, s, whole_code=simple)
    few = facts(t, p, home, more=("hora_grupo", "fecha_inicio", "fecha_fin", "rol_usuario"))
    usage = tools.usage_pivot(tools.tool_usage(few, s, period, p["hora_consulta"], simple))
    cells = [c for c in usage.columns if c != "course_id"]
    df = home.join(usage, "course_id", "left").na.fill(0, cells)
    return df.withColumn("notification_users", F.lit(0)).withColumn("notification_items", F.lit(0))


def uso_herramientas(t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """Per course: users and activities of each tool, for validly enrolled users."""
    df = _course_dates(_usage_report(t, params, s, simple=False), s)
    return C.printed(df.orderBy(up("fullname"), "course_id"), C.USO_HERRAMIENTAS)


# -- 8 --------------------------------------------------------------------------


def _participation(t: LmsTables, params: Params, s: Settings, creations: bool) -> DataFrame:
    p = Q.clean("participacion_herramientas", params)
    # The option list offers only "not available" for this state; choosing it
    # means no filter, while real states select.
    if p["estado_aprendiz"] == L.NOT_AVAILABLE:
        p["estado_aprendiz"] = None
    home = (
        _optional(_course_filters(courses.described(t, s), p, s), p, s)
        .since("fecha_inicio", F.col("startdate"))
        .until("fecha_fin", F.col("enddate"), must_be_set=True)
        .df
    )
    identity = F.coalesce(F.nullif("idnumber", F.lit("")), "username")
    persons = (
        _optional(
            _people(t, X.DOCUMENT_KINDS_WITH_TI, identity).filter(F.col("deleted") == 0), p, s
        )
        .equals("estado_usuario", F.col("user_state"))
        .contains("identificacion", F.col("identity"), F.col("document"))
        .contains("nombres_apellidos", F.col("person"))
        .df
    )
    few = facts(t, p, home, persons, more=("fecha_inicio", "fecha_fin"))
    base = _optional(enrolments.with_dates(few), p, s).equals("estado_aprendiz", F.col("group_state")).df
    measured = tools.participation(few, tools.Period(p["fecha_desde"], p["fecha_hasta"], s.report_tz), creations)
    df = base.join(measured, PAIR, "left").na.fill(0, list(MEASURE_NAMES))
    df = (
        _optional(_with_roles(df, few), p, s)
        .contains("rol_usuario", F.coalesce("role_shortnames", F.lit("")), F.col("role_text"))
        .df
    )
    df = df.join(home, "course_id").join(persons, "userid")
    return _course_dates(df, s, null_is_unset=False).select(
        "*",
        F.lit(L.NOT_AVAILABLE).alias("program_state"),
        F.coalesce(stamp(F.col("last_access"), s.report_tz), F.lit("Sin ingreso registrado")).alias(
            "last_access_text"
        ),
    )


def participacion_herramientas(t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """Participation of each enrolled user in the tools of a course."""
    df = _participation(t, params, s, creations=False)
    return C.printed(
        df.orderBy(up("idnumber"), up("person"), "course_id", "userid"), C.PARTICIPACION_HERRAMIENTAS
    )


# -- 9 --------------------------------------------------------------------------

# Parameters that narrow the user-course pairs of the time report.
_NARROWING = tuple(
    name for name in Q.DECLARED["tiempo_permanencia"] if name not in ("fecha_desde", "fecha_hasta")
)


def time_base(t: LmsTables, p: dict, s: Settings) -> DataFrame:
    """User-course pairs of the time report; deleted users stay."""
    home = (
        _optional(_course_filters(courses.described(t, s), p, s), p, s)
        .since("fecha_inicio", F.col("startdate"))
        .until("fecha_fin", F.col("enddate"), must_be_set=True)
        .constant("estado_aprendiz", L.NOT_AVAILABLE)
        .df
    )
    persons = (
        _optional(_people(t, X.DOCUMENT_KINDS_WITH_TI), p, s)
        .contains("identificacion", F.col("username"))
        .contains("nombres_apellidos", F.col("person"))
        .equals("estado_usuario", F.col("user_state"))
        .df
    )
    few = facts(t, p, home, persons, more=("fecha_inicio", "fecha_fin"))
    df = (
        _optional(_with_roles(enrolments.by_user_status(few), few), p, s)
        .contains("rol_usuario", F.coalesce("role_shortnames", F.lit("")))
        .df
    )
    return df.join(home, "course_id").join(persons, "userid")


def tiempo_permanencia(
    t: LmsTables, params: Params = None, s: Settings = Settings(), strict_context: bool = False
) -> DataFrame:
    """Share of estimated time per tool, for users with any time in a course.

    Gaps and view times come from one reading of the log. When a filter narrows the pairs, it is cut down to
    them first; otherwise that extra pass over the log would remove nothing.
    """
    p = Q.clean("tiempo_permanencia", params)
    base = time_base(t, p, s)
    only = base if is_set(p, _NARROWING) else None
    instances = timeontask.per_instance(t, s, p["fecha_desde"], p["fecha_hasta"], only, strict_context, views=True)
    spent = timeontask.pivoted(timeontask.per_tool(t, instances)).filter(F.col("sec_total") > 0)
    df = base.join(spent, PAIR)
    df = _course_dates(df, s, null_is_unset=False, plain_start=True).select(
        "*",
        F.lit(L.NOT_AVAILABLE).alias("program_state"),
        stamp(F.col("last_access"), s.report_tz).alias("last_access_text"),
        *[
            ratio_2dp(F.col(f"sec_{name}") * 100, F.col("sec_total")).alias(f"pct_{name}")
            for name in timeontask.PIVOT
        ],
        ratio_2dp(F.col("sec_total"), F.lit(60)).alias("minutes"),
    )
    return C.printed(
        df.orderBy(up("idnumber"), up("person"), "course_id", "userid"), C.TIEMPO_PERMANENCIA
    )


# -- 10 -------------------------------------------------------------------------


def _sessions(t: LmsTables, params: Params, s: Settings, record_flag: bool) -> DataFrame:
    p = Q.clean("sesiones_online", params)
    home = (
        _optional(_course_filters(courses.described(t, s), p, s), p, s)
        .since("fecha_inicio_grupo_desde", F.col("startdate"))
        .until("fecha_inicio_grupo_hasta", F.col("startdate"))
        .since("fecha_creacion_grupo_desde", F.col("course_created"))
        .until("fecha_creacion_grupo_hasta", F.col("course_created"))
        .df
    )
    held = t.bigbluebuttonbn.select(
        F.col("id").alias("session_id"),
        F.col("course").alias("course_id"),
        F.col("name").alias("session_name"),
        "meetingid",
        "openingtime",
        "closingtime",
        "record",
    )
    if not record_flag:
        held = held.filter(F.col("openingtime") > 0)
    opening = F.col("openingtime")
    held = (
        _optional(held, p, s)
        .since("fecha_desde", opening, must_be_set=record_flag)
        .until("fecha_hasta", opening, must_be_set=record_flag)
        .df
    )
    raw = s.raw_patterns
    if p["rol_usuario"] is not None:
        holders = online.with_role(t, p["rol_usuario"], raw, exact=record_flag)
        held = held.join(holders, "session_id", "left_semi")
    if p["identificacion"] is not None:
        test = online.identity_test(p["identificacion"], raw, username_only=record_flag)
        held = held.join(online.with_person(t, test), "session_id", "left_semi")
    if p["nombres_apellidos"] is not None:
        test = online.name_test(p["nombres_apellidos"], raw)
        held = held.join(online.with_person(t, test), "session_id", "left_semi")
    chosen = held.join(home, "course_id")
    # Any parameter of this report selects sessions; attendance is counted for these alone.
    only = chosen.select("session_id") if is_set(p, p) else None
    taped = online.recorded(t, only).withColumn("has_recording", F.lit(True))
    df = chosen.join(online.stats(t, record_flag, only), "session_id", "left").join(taped, "session_id", "left")
    has = F.coalesce("has_recording", F.lit(False))
    if record_flag:
        has = has | F.coalesce(F.col("record") == 1, F.lit(False))

    def when_set(epoch: Column) -> Column:
        return F.when(epoch > 0, stamp(epoch, s.report_tz)).otherwise(L.UNSET_DATE)

    df = df.na.fill(0, ["joins"]).select(
        "*",
        F.lit(L.NOT_AVAILABLE).alias("program_state"),
        when_set(opening).alias("opening_text"),
        when_set(F.col("closingtime")).alias("closing_text"),
        L.yes_no(F.coalesce("started", F.lit(False))).alias("started_text"),
        L.yes_no(has).alias("recorded_text"),
    )
    return _course_dates(df, s, null_is_unset=False, plain_start=record_flag).orderBy(
        up("idnumber"), down("openingtime"), up("session_name"), "session_id"
    )


def sesiones_online(t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """Scheduled online sessions with attendance, start and recording marks."""
    return C.printed(_sessions(t, params, s, record_flag=False), C.SESIONES_ONLINE)


REPORTS = {
    "registro_usuarios": registro_usuarios,
    "ingresos_sistema": ingresos_sistema,
    "matriculas_lms": matriculas_lms,
    "usuarios_ambiente": usuarios_ambiente,
    "fichas_programas": fichas_programas,
    "trafico_diario": trafico_diario,
    "uso_herramientas": uso_herramientas,
    "participacion_herramientas": participacion_herramientas,
    "tiempo_permanencia": tiempo_permanencia,
    "sesiones_online": sesiones_online,
}


def preview(df: DataFrame, rows: int = 50) -> DataFrame:
    """First rows in report order; a top-k, not a full sort."""
    return df.limit(rows)

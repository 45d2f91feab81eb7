"""Earlier variants of the reports that answer a different question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import labels as L
from lectern.functions import params as Q
from lectern.functions import text as X
from lectern.functions.times import epoch_range, local_ts, overlaps, stamp, stamp_or
from lectern.operators import access, courses, enrolments, people, tools
from lectern.operators.skew import join_hot
from lectern.plans import columns as C
from lectern.plans import reports as R
from lectern.plans.reports import Params, down, up
from lectern.settings import Settings
from lectern.sources import LmsTables

PAIR = ["userid", "course_id"]


TRAFICO_POR_HORA = {
    "environment": "Ambiente",
    "year": "Año",
    "month": "Mes",
    "day_of_month": "Día",
    "band": "Rango de Hora (60 minutos)",
    "users": "Cantidad de Usuarios Únicos",
}


def trafico_por_hora(t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """Unique users per day and one-hour band (no enrolment test)."""
    p = Q.clean("trafico_diario", params)
    homes = courses.origins(t)
    if p["origen_datos"] is not None:
        homes = homes.filter(F.col("origin") == Q.normal_origin(p["origen_datos"]))
    at = local_ts(F.col("timecreated"), s.report_tz)
    seen = (
        access.of_course_users(access.log_between(t, p["fecha_desde"], p["fecha_hasta"], s.report_tz))
        .filter(F.col("action") == "viewed")
        .select(*PAIR, F.to_date(at).alias("day"), F.date_format(at, "HH").alias("hour"))
        .distinct()
        .join(homes.select("course_id"), "course_id", "left_semi")
        .select("userid", "day", "hour")
        .distinct()
        .join(people.present_users(t).select(F.col("id").alias("userid")), "userid", "left_semi")
    )
    df = seen.groupBy("day", "hour").agg(F.count("*").alias("users")).select(
        F.lit(s.traffic_environment).alias("environment"),
        F.year("day").alias("year"),
        F.month("day").alias("month"),
        F.dayofmonth("day").alias("day_of_month"),
        F.concat("hour", F.lit(":00 - "), "hour", F.lit(":59")).alias("band"),
        "users",
    )
    order = [down("year"), down("month"), down("day_of_month"), down("band")]
    return C.printed(df.orderBy(*order), TRAFICO_POR_HORA)


_COUNTED = tuple(m for m in tools.MEASURES if m != "accesses")

PARTICIPACION_TOTAL = {
    **{k: v for k, v in C.PARTICIPACION_HERRAMIENTAS.items() if k not in tools.MEASURES},
    "modality": "Modalidad",
    "fullname": "Nombre del grupo/ficha",
    "email": "Correo",
    "role_text": "Rol de usuario",
    "user_state": "Estado del usuario LMS",
    **{k: v for k, v in C.PARTICIPACION_HERRAMIENTAS.items() if k in tools.MEASURES},
    "total": "Total participaciones en herramientas",
}


def participacion_total(t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """Participation with its total; forums count discussions opened."""
    total = reduce(lambda a, b: a + b, [F.col(m) for m in _COUNTED])
    df = R._participation(t, params, s, creations=True).withColumn("total", total)
    return C.printed(
        df.orderBy(up("idnumber"), up("person"), "course_id", "userid"), PARTICIPACION_TOTAL
    )


FICHAS_ROLES_OUTER = {
    k: v for k, v in C.FICHAS_PROGRAMAS.items() if k not in ("created_text", "level")
}


def fichas_roles_outer(t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """Courses with role counts in which unenrolled role holders are inactive."""
    p = Q.clean("fichas_programas", params)
    home = R.programme_courses(t, p, s)
    if p["estado_aprendiz"] is not None:
        wanted = p["estado_aprendiz"]
        students = people.course_assignments(t).filter(F.col("shortname") == people.STUDENT).select(*PAIR).distinct()
        state = F.when(F.col("status") == 0, "Activo").otherwise("Inactivo")
        enrolled = enrolments.rows(t).filter(state == wanted).select(*PAIR).distinct()
        found = enrolled.join(students, PAIR, "left_semi").select("course_id").distinct()
        home = home.join(found, "course_id", "left_semi")
    counts = ["teachers_active", "students_active", "teachers_inactive", "students_inactive"]
    few = R.facts(t, p, home, more=R.PROGRAMME_FILTERS)
    df = home.join(enrolments.role_counts_outer(few), "course_id", "left").na.fill(0, counts)
    df = R._course_dates(df, s, null_is_unset=False, plain_start=True).select(
        "*",
        F.lit(L.NOT_AVAILABLE).alias("program_state"),
        F.lit(L.NOT_AVAILABLE).alias("external_state"),
    )
    return C.printed(df.orderBy(down("course_created"), up("fullname"), "course_id"), FICHAS_ROLES_OUTER)


MATRICULAS_ACTIVAS = {
    **{k: v for k, v in C.MATRICULAS_LMS.items() if k not in ("enrolment_state", "method_state")},
    "enrolment_state": "Estado del Usuario",
}


def matriculas_activas(t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """One row per active enrolment of active users."""
    p = Q.clean("matriculas_lms", params)
    home = R.enrolment_courses(t, p, s)
    few = R.facts(t, p, home, more=("fecha_inicio", "fecha_fin"))
    rows = enrolments.rows(few).filter((F.col("status") == 0) & (F.col("method_status") == 0))
    bounds = epoch_range(p["fecha_desde"], p["fecha_hasta"], s.report_tz)
    test = overlaps(F.col("timestart"), F.col("timecreated"), F.col("timeend"), bounds)
    if test is not None:
        rows = rows.filter(test)
    rows = rows.select(
        F.col("id").alias("enrolment_id"),
        *PAIR,
        F.lit("Activo").alias("enrolment_state"),
        stamp(F.col("timecreated"), s.report_tz).alias("enrolled_text"),
        stamp_or(F.col("timeend"), s.report_tz, L.UNSET_DATE).alias("left_text"),
    )
    active = R._people(t, X.DOCUMENT_KINDS_WITH_TI).filter((F.col("deleted") == 0) & (F.col("suspended") == 0))
    rows = join_hot(rows, people.roles_by_user_course(few), "left")
    rows = rows.withColumn("role_text", F.coalesce("role_names", F.lit("Sin rol asignado")))
    df = R._optional(rows, p, s).contains("rol_usuario", F.col("role_shortnames")).df
    df = df.join(home, "course_id").join(active, "userid")
    df = R._course_dates(df, s, null_is_unset=False, plain_start=True)
    return C.printed(
        df.orderBy(up("fullname"), up("role_text"), up("person"), "enrolment_id"), MATRICULAS_ACTIVAS
    )


def registro_por_matricula(t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """One row per enrolment; an hour filter keeps only users seen in that hour."""
    p = Q.clean("registro_usuarios", params)
    home = (
        R._optional(R._course_filters(courses.described(t, s), p, s, whole_code=True), p, s)
        .since("fecha_inicio", F.col("startdate"))
        .until("fecha_fin", F.col("enddate"), must_be_set=True)
        .df
    )
    persons = (
        R._optional(R._people(t, X.DOCUMENT_KINDS).filter(F.col("deleted") == 0), p, s)
        .contains("identificacion", F.col("username"))
        .contains("nombres_apellidos", F.col("person"))
        .df
    )
    few = R.facts(t, p, home, persons, more=("fecha_inicio", "fecha_fin"))
    rows = enrolments.rows(few).select(
        F.col("id").alias("enrolment_id"),
        *PAIR,
        F.when(F.col("status") == 0, "Activa").otherwise("Suspendida").alias("enrolment_state"),
    )
    rows = R._optional(rows, p, s).equals("estado_aprendiz", F.col("enrolment_state")).df
    seen = access.course_access(few, s, hour=p["hora"], target=None)
    # One entry per pair with access counts and roles; without an hour filter
    # pairs that have roles but no access are kept too.
    known = seen.join(people.roles_by_user_course(few), PAIR, "left" if p["hora"] is not None else "full")
    df = join_hot(rows, known, "inner" if p["hora"] is not None else "left")
    df = df.withColumn("role_text", F.coalesce("role_names", F.lit("Sin rol asignado")))
    df = R._optional(df, p, s).contains("rol_usuario", F.col("role_shortnames")).df
    df = df.join(home, "course_id").join(persons, "userid").na.fill(0, ["access_days", "accesses"])
    df = R._course_dates(df, s).select(
        "*",
        stamp_or(F.col("first_access"), s.report_tz, "Sin acceso").alias("first_access_text"),
        stamp_or(F.col("lastaccess"), s.report_tz, "Sin acceso").alias("last_lms_access"),
    )
    return C.printed(
        df.orderBy(up("fullname"), up("role_text"), up("person"), "enrolment_id"), C.REGISTRO_USUARIOS
    )


INGRESOS_SIN_IP = {
    "role_text": "Rol de usuario",
    "system": "Sistema operativo",
    "browser": "Navegador web",
    "country": "País",
    "city": "Ciudad",
    "logins": "Total de ingresos",
    "users": "Usuarios únicos",
}


def ingresos_sin_ip(t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """Logins by role, country and city, without the address."""
    df = R.login_totals(t, Q.clean("ingresos_sistema", params), s, ["country", "city"])
    order = [down("logins"), down("users"), up("role_text"), up("country"), up("city")]
    return C.printed(df.orderBy(*order), INGRESOS_SIN_IP)


def sesiones_record_flag(t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """Sessions where the record mark also counts as a recording."""
    return C.printed(R._sessions(t, params, s, record_flag=True), C.SESIONES_ONLINE)


def foros_creados(t: LmsTables, s: Settings, since: str | None = None, until: str | None = None) -> DataFrame:
    """Discussions opened and blog first posts per user and course."""
    p = tools.Period(since, until, s.report_tz)
    opened = tools.discussions_opened(t, p).select(*PAIR, F.col("total").alias("forums"), F.lit(0).alias("blogs"))
    blogs = tools.blog_openings(t, p).select(*PAIR, F.lit(0).alias("forums"), F.col("total").alias("blogs"))
    return opened.unionByName(blogs).groupBy(*PAIR).agg(F.sum("forums").alias("forums"), F.sum("blogs").alias("blogs"))


def roles_curso_usuario(t: LmsTables) -> DataFrame:
    """Roles of a user taken from course contexts only."""
    return people.roles_by_user(t, people.COURSE)


USO_SIMPLE = {k: v for k, v in C.USO_HERRAMIENTAS.items() if k not in ("modality", "fullname", "origin", "region", "center")}


def uso_herramientas_simple(t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """Tool usage without the enrolment test and without a user filter."""
    df = R._course_dates(R._usage_report(t, params, s, simple=True), s, null_is_unset=False, plain_start=True)
    return C.printed(df.orderBy(up("fullname"), "course_id"), USO_SIMPLE)

"""Checks of scalar functions, labels and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import (
    K4, K5, LEVEL, MODALITY, NOW, S, STATE, USER_STATE, check, day, doc_number, doc_type, local, part, ratio, stamp_or,
)
from lectern.functions import labels as L
from lectern.functions import params as Q
from lectern.functions import text as X
from lectern.functions import times as M
from lectern.functions.filters import Optional, contains, ilike_any
from lectern.operators import access, courses, tools
from lectern.operators.textindex import TextIndex
from lectern.plans.catalogue import VIDEO_COMPONENTS, VIDEO_EVENTS
from lectern.session import scratch_path

TZ = S.report_tz


def _filtered(df, **given):
    return Optional(df, given, TZ)


# -- text functions ---------------------------------------------------------------


def _course_fn(key: str, column, sql: str) -> None:
    check(
        key,
        lambda t: t.course.select("id", column(F.col("fullname"), F.col("shortname")).alias("v")),
        f"select id, {sql} as v from mdl_course",
    )


_course_fn(
    "fn_program_code", lambda full, short: X.program_code(full), r"nullif(regexp_extract(fullname, '\(([0-9]+)(_PRY_[0-9]+)?\)\s*$', 1), '')"
)
_course_fn(
    "fn_program_name", lambda full, short: X.program_name(full), r"trim(regexp_replace(fullname, '\s*\([0-9]+(_PRY_[0-9]+)?\)\s*$', ''))"
)
_course_fn("fn_region_code", lambda full, short: X.region_code(short), "nullif(regexp_extract(shortname, '_R_([0-9]+)', 1), '')")
_course_fn("fn_center_code", lambda full, short: X.center_code(short), "nullif(regexp_extract(shortname, '_C_([0-9]+)', 1), '')")
_course_fn(
    "fn_modality_letter",
    lambda full, short: X.modality_letter(short),
    "nullif(regexp_extract(shortname, '^[0-9]*P_[0-9]+_([A-Za-z]+)_', 1), '')",
)
_course_fn(
    "fn_version", lambda full, short: X.version(short), "nullif(regexp_extract(shortname, '^[0-9]*P_[0-9]+_[A-Za-z]+_([0-9]+)', 1), '')"
)
_course_fn(
    "fn_program_code_short",
    lambda full, short: X.short_program_code(short),
    "nullif(regexp_extract(shortname, '^P_([0-9]+)_', 1), '')",
)
_course_fn(
    "fn_regex_test",
    lambda full, short: short.rlike(X.INTEGRATED_STRICT),
    "regexp_matches(shortname, '^P_[0-9]+_.*_R_[0-9]+_C_[0-9]+')",
)
check(
    "fn_regex_strip",
    lambda t: t.user.select("id", X.document_number(F.col("username"), X.DOCUMENT_KINDS).alias("v")),
    f"select id, {doc_number('username', K4)} as v from mdl_user",
)
check(
    "fn_full_name",
    lambda t: t.user.select("id", X.full_name(F.col("firstname"), F.col("lastname")).alias("v")),
    "select id, concat(firstname, ' ', lastname) as v from mdl_user",
)
check(
    "fn_concat_null",
    lambda t: courses.parsed(t).select("course_id", F.concat(F.lit("Centro "), "center_code").alias("v")),
    "select course_id, 'Centro ' || center_code as v from x_course",
)
check(
    "fn_string_basic",
    lambda t: t.user.select(
        "id",
        F.trim("city").alias("trimmed"),
        F.lower("username").alias("lowered"),
        F.upper("country").alias("raised"),
        F.lpad(F.col("id").cast("string"), 6, "0").alias("padded"),
        F.split_part("email", F.lit("@"), F.lit(1)).alias("part"),
    ),
    """select id, trim(city) as trimmed, lower(username) as lowered, upper(country) as raised,
         lpad(cast(id as varchar), 6, '0') as padded, split_part(email, '@', 1) as part from mdl_user""",
)
check(
    "fn_null_default",
    lambda t: t.user.select(
        "id",
        X.blank_to(F.col("city"), "No definido").alias("city"),
        F.coalesce(F.nullif("timecreated", F.lit(0)), F.lit(-1)).alias("made"),
    ),
    """select id, case when trim(city) = '' or city is null then 'No definido' else trim(city) end as city,
         case when timecreated is null or timecreated = 0 then -1 else timecreated end as made from mdl_user""",
)
check(
    "fn_casts",
    lambda t: courses.parsed(t).select(
        "course_id",
        F.col("region_code").try_cast("bigint").alias("as_number"),
        F.col("idnumber").try_cast("int").alias("as_int"),
        F.col("course_id").cast("string").alias("as_text"),
    ),
    """select course_id, try_cast(region_code as bigint) as as_number, try_cast(idnumber as integer) as as_int,
         cast(course_id as varchar) as as_text from x_course""",
)

# -- time functions ---------------------------------------------------------------

def _log_fn(key: str, columns: dict, sql: str) -> None:
    check(
        key,
        lambda t: t.log.select("id", *[make(F.col("timecreated")).alias(n) for n, make in columns.items()]),
        f"select id, {sql} from lg",
    )


_log_fn(
    "fn_epoch_to_ts",
    {"v": lambda at: F.timestamp_seconds(at).cast("string")},
    "cast(make_timestamp(timecreated * 1000000) as varchar) as v",
)
_log_fn(
    "fn_ts_to_epoch",
    {"v": lambda at: F.unix_timestamp(F.date_trunc("hour", F.timestamp_seconds(at)))},
    "timecreated - timecreated % 3600 as v",
)
_log_fn(
    "fn_tz_shift",
    {"here": lambda at: M.local_ts(at, TZ).cast("string"), "back": lambda at: F.unix_timestamp(F.to_utc_timestamp(M.local_ts(at, TZ), TZ))},
    f"cast({local('timecreated')} as varchar) as here, timecreated as back",
)
_log_fn(
    "fn_date_format",
    {
        "full_text": lambda at: M.stamp(at, TZ),
        "day_text": lambda at: M.stamp(at, TZ, "yyyy/MM/dd"),
        "month_text": lambda at: M.stamp(at, TZ, "yyyy/MM"),
        "year_text": lambda at: M.stamp(at, TZ, "yyyy"),
        "hour_text": lambda at: M.stamp(at, TZ, "HH"),
        "band_text": lambda at: M.stamp(at, TZ, "HH:00:00"),
    },
    ", ".join(
        f"strftime({local('timecreated')}, '{fmt}') as {name}"
        for name, fmt in {
            "full_text": "%Y/%m/%d %H:%M:%S", "day_text": "%Y/%m/%d", "month_text": "%Y/%m", "year_text": "%Y",
            "hour_text": "%H", "band_text": "%H:00:00",
        }.items()
    ),
)
_log_fn(
    "fn_date_parts",
    {
        "y": lambda at: F.year(M.local_ts(at, TZ)),
        "m": lambda at: F.month(M.local_ts(at, TZ)),
        "d": lambda at: F.dayofmonth(M.local_ts(at, TZ)),
        "w": lambda at: F.weekofyear(M.local_ts(at, TZ)),
    },
    ", ".join(
        f"{part(unit, local('timecreated'))} as {name}"
        for name, unit in {"y": "year", "m": "month", "d": "day", "w": "weekofyear"}.items()
    ),
)
_log_fn(
    "fn_date_trunc",
    {"m": lambda at: F.trunc(M.local_date(at, TZ), "month"), "y": lambda at: F.trunc(M.local_date(at, TZ), "year")},
    f"cast(date_trunc('month', {day('timecreated')}) as date) as m, cast(date_trunc('year', {day('timecreated')}) as date) as y",
)
_log_fn(
    "fn_date_add",
    {"v": lambda at: M.local_date(at, TZ), "next_day": lambda at: F.date_add(M.local_date(at, TZ), 1)},
    f"{day('timecreated')} as v, {day('timecreated')} + 1 as next_day",
)
check(
    "fn_epoch_display",
    lambda t: t.user.select(
        "id",
        M.stamp_or(F.col("timecreated"), TZ, "No disponible").alias("made"),
        M.stamp_or(F.col("lastaccess"), TZ, "Sin acceso").alias("seen"),
    ),
    f"select id, {stamp_or('timecreated', 'No disponible')} as made, {stamp_or('lastaccess', 'Sin acceso')} as seen from mdl_user",
)
check(
    "fn_as_of",
    lambda t: t.course.filter(F.col("timecreated") <= S.now()).select("id", (F.lit(S.now()) - F.col("timecreated")).alias("age")),
    f"select id, {NOW} - timecreated as age from mdl_course where timecreated <= {NOW}",
)
check(
    "fn_period_overlap",
    lambda t: t.user_enrolments.filter(
        M.overlaps(
            F.col("timestart"), F.col("timecreated"), F.col("timeend"), M.epoch_range("2024-01-12", "2024-01-13", TZ)
        )
    ).select("id"),
    """select id from mdl_user_enrolments where case when timestart is null or timestart = 0 then timecreated else timestart end < 1705208400
       and (timeend is null or timeend = 0 or timeend >= 1705035600)""",
)
check(
    "fn_valid_at",
    lambda t: t.user_enrolments.filter(
        M.valid_at(F.col("timestart"), F.col("timeend"), F.lit(S.now()))
    ).select("id"),
    f"select id from mdl_user_enrolments where coalesce(timestart, 0) <= {NOW} and (coalesce(timeend, 0) = 0 or timeend >= {NOW})",
)
check(
    "fn_math",
    lambda t: t.user_enrolments.select(
        "id",
        M.ratio_2dp(F.col("userid") * 100, F.col("enrolid")).alias("share"),
        F.least(F.lit(1800), F.greatest(F.lit(0), F.col("timeend") - F.col("timestart"))).alias("capped"),
    ),
    f"""select id, {ratio('userid * 100', 'enrolid')} as share,
          case when coalesce(timeend - timestart, 0) < 0 then 0 when coalesce(timeend - timestart, 0) > 1800 then 1800
            else coalesce(timeend - timestart, 0) end as capped from mdl_user_enrolments""",
)

# -- labels -----------------------------------------------------------------------

check(
    "prj_course_state",
    lambda t: t.course.select(
        "id", L.course_state(F.col("visible"), F.col("startdate"), F.col("enddate"), S.now()).alias("v")
    ),
    f"select id, {STATE} as v from mdl_course",
)
check(
    "prj_level",
    lambda t: courses.parsed(t).select("course_id", L.level(F.col("letter")).alias("v")),
    f"select course_id, {LEVEL} as v from x_course",
)
check(
    "prj_modality",
    lambda t: courses.parsed(t).select("course_id", L.modality(F.col("letter")).alias("v")),
    f"select course_id, {MODALITY} as v from x_course",
)
check(
    "prj_user_state",
    lambda t: t.user.select("id", L.user_state(F.col("deleted"), F.col("suspended")).alias("v")),
    f"select id, {USER_STATE} as v from mdl_user",
)
check(
    "prj_document",
    lambda t: t.user.select(
        "id",
        X.document_type(F.col("username"), X.DOCUMENT_KINDS).alias("kind"),
        X.document_number(F.col("username"), X.DOCUMENT_KINDS).alias("number"),
        X.document_type(F.col("username"), X.DOCUMENT_KINDS_WITH_TI).alias("kind_ti"),
        X.document_number(F.col("username"), X.DOCUMENT_KINDS_WITH_TI).alias("number_ti"),
    ),
    f"""select id, {doc_type('username', K4)} as kind, {doc_number('username', K4)} as number,
          {doc_type('username', K5)} as kind_ti, {doc_number('username', K5)} as number_ti from mdl_user""",
)
check(
    "prj_tool_class",
    lambda t: tools.modules(t, "all").select(
        "module_id", "tool", L.time_tool_class(F.col("module_name"), F.col("forum_type")).alias("time_tool")
    ),
    """select module_id, tool, case when module_name in ('feedback', 'survey', 'quiz', 'assign', 'bigbluebuttonbn') then module_name
         when module_name = 'attendance' then 'asistencia' else tool end as time_tool from x_tool""",
)
check(
    "prj_auth_origin",
    lambda t: t.user.select("id", L.auth_origin(F.col("auth")).alias("v")),
    "select id, case auth when 'manual' then 'Manual' else 'Integración / Externo' end as v from mdl_user",
)

# -- filters ----------------------------------------------------------------------

check(
    "flt_optional",
    lambda t: _filtered(t.user.select("id", "username"), identificacion=Q.blank_to_none("  "))
    .contains("identificacion", F.col("username"))
    .df,
    "select id, username from mdl_user",
)
check(
    "flt_contains",
    lambda t: _filtered(t.course.select("id", "fullname"), nombre_ficha="wIDget").contains("nombre_ficha", F.col("fullname")).df,
    "select id, fullname from mdl_course where contains(lower(fullname), 'widget')",
)
def _indexed(t, value: str):
    """Users whose name or user name contains a value, by the index of triples."""
    person = F.concat_ws(" ", "firstname", "lastname")
    index = TextIndex.build(t.user, "id", {"person": person, "username": F.col("username")}, scratch_path(t.spark, "names"))
    return index.contains(t.user, "id", {"person": person, "username": F.col("username")}, value).select("id", "username")


for _name, _value in (("name", "R#0000001"), ("number", "00012"), ("short", "7")):
    check(
        f"flt_contains_by_index_{_name}",
        lambda t, value=_value: _indexed(t, value),
        f"""select id, username from mdl_user
            where contains(lower(concat_ws(' ', firstname, lastname)), lower('{_value}')) or contains(lower(username), lower('{_value}'))""",
    )
check(
    "flt_contains_literal",
    lambda t: t.course.filter(contains(F.col("shortname"), "p_")).select("id", "shortname"),
    "select id, shortname from mdl_course where contains(lower(shortname), 'p_')",
)
check(
    "flt_contains_pattern",
    lambda t: t.course.filter(contains(F.col("shortname"), "v%r_", raw=True)).select("id", "shortname"),
    "select id, shortname from mdl_course where shortname ilike '%v%r_%'",
)
check(
    "flt_ilike_exact",
    lambda t: _filtered(t.course.select("id", "shortname"), codigo="manual_RED widget").whole("codigo", F.col("shortname")).df,
    "select id, shortname from mdl_course where lower(shortname) = 'manual_red widget'",
)
check(
    "flt_label_eq",
    lambda t: _filtered(courses.described(t, S).select("course_id", "course_state"), estado_grupo="Finalizado")
    .equals("estado_grupo", F.col("course_state"))
    .df,
    "select course_id, course_state from x_home where course_state = 'Finalizado'",
)
check(
    "flt_label_contains",
    lambda t: _filtered(courses.described(t, S).select("course_id", "modality"), modalidad="DISTANCIA")
    .contains("modalidad", F.col("modality"))
    .df,
    "select course_id, modality from x_home where modality ilike '%distancia%'",
)
check(
    "flt_constant_label",
    lambda t: _filtered(t.course.select("id"), a=L.NOT_AVAILABLE).constant("a", L.NOT_AVAILABLE).df.unionByName(
        _filtered(t.course.select("id"), a="Activo").constant("a", L.NOT_AVAILABLE).df
    ),
    "select id from mdl_course where 'No disponible (SOFIA Plus)' = 'No disponible (SOFIA Plus)'"
    " union all select id from mdl_course where 'No disponible (SOFIA Plus)' = 'Activo'",
)
check(
    "flt_synonyms",
    lambda t: courses.origins(t).filter(F.col("origin") == Q.normal_origin("SOFIA Plus")).withColumn(
        "range", F.lit(Q.normal_range("AÑO"))
    ),
    "select course_id, origin, 'Año' as range from x_home where origin = 'Integración'",
)
check(
    "flt_hour",
    lambda t: _filtered(t.log.select("id", "timecreated"), hora="7:30").hour("hora", F.col("timecreated")).df,
    f"select id, timecreated from lg where hour({local('timecreated')}) = 7",
)
check(
    "flt_month_year_week",
    lambda t: _filtered(t.log.select("id", M.local_ts(F.col("timecreated"), TZ).alias("at")), mes="1", semana="3", anio="2024")
    .number("mes", F.month("at"))
    .number("semana", F.weekofyear("at"))
    .number("anio", F.year("at"))
    .df.select("id"),
    f"""select id from lg where extract(month from {local('timecreated')}) = 1 and extract(week from {local('timecreated')}) = 3
        and extract(year from {local('timecreated')}) = 2024""",
)
check(
    "flt_date_range",
    lambda t: _filtered(t.log.select("id", "timecreated"), a="2024-01-10", b="2024-01-12")
    .since("a", F.col("timecreated"))
    .until("b", F.col("timecreated"))
    .df,
    f"select id, timecreated from lg where {day('timecreated')} between date '2024-01-10' and date '2024-01-12'",
)
check(
    "flt_date_eq",
    lambda t: _filtered(t.course.select("id", "startdate"), a="2024-01-10").on_day("a", F.col("startdate")).df,
    f"select id, startdate from mdl_course where {day('startdate')} = date '2024-01-10'",
)
check(
    "flt_date_set",
    lambda t: _filtered(t.course.select("id", "startdate"), a="2024-01-20")
    .until("a", F.col("startdate"), must_be_set=True)
    .df,
    f"select id, startdate from mdl_course where startdate > 0 and {day('startdate')} <= date '2024-01-20'",
)
check(
    "flt_ilike_any",
    lambda t: t.log.filter(
        ilike_any(F.col("component"), VIDEO_COMPONENTS) | ilike_any(F.col("eventname"), VIDEO_EVENTS)
    ).select("id", "component", "eventname"),
    """select id, component, eventname from lg where regexp_matches(lower(component), 'bigbluebutton|zoom|teams|webex')
       or regexp_matches(lower(eventname), 'bigbluebutton|zoom|meeting|session')""",
)
check(
    "flt_multi_contains",
    lambda t: _filtered(t.user.select("id", "idnumber", "username"), identificacion="000012")
    .contains("identificacion", F.col("idnumber"), F.col("username"))
    .df,
    "select id, idnumber, username from mdl_user where contains(idnumber, '000012') or contains(username, '000012')",
)
check(
    "flt_in_list",
    lambda t: t.forum.filter(~F.col("type").isin("news", "blog")).select("id", "type"),
    "select id, type from mdl_forum where type not in ('news', 'blog')",
)
check(
    "flt_history_floor",
    lambda t: access.valid_access(t, S.with_(floor_epoch=1705294800)),
    "select * from x_valid where timecreated >= 1705294800",
)

"""Checks of sources, shared relations and export operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks.base import K5, S, check, doc_number, doc_type
from lectern.functions.params import clean
from lectern.operators import access, courses, enrolments, export, online, options, people, timeontask, tools
from lectern.plans import reports as R
from lectern.session import scratch_path
from lectern.sources import LmsTables

P = tools.Period()

# -- sources ----------------------------------------------------------------------

check(
    "scan_lms_table",
    lambda t: t.user.select("id", "username", "email", "auth", "deleted"),
    "select id, username, email, auth, deleted from mdl_user",
)
check(
    "log_time_range_scan",
    lambda t: access.log_between(t, "2024-01-08", "2024-01-14", S.report_tz).select("id", "userid", "timecreated"),
    "select id, userid, timecreated from lg where timecreated >= 1704690000 and timecreated < 1705294800",
)
check(
    "seeds_union",
    courses.seeds,
    "select * from x_seed",
)
check(
    "filter_options",
    options.filter_options,
    """select filter, value, label from (
         select unnest(['rol_usuario', 'modalidad', 'nivel', 'id_categoria']) as filter, '' as value, 'Todas' as label
         union all select 'nivel', unnest(['Formación titulada', 'No definido']), unnest(['Formación titulada', 'No definido'])
         union all select 'rol_usuario', shortname, coalesce(nullif(trim(name), ''),
             case shortname when 'manager' then 'Gestor' when 'coursecreator' then 'Creador de cursos'
               when 'editingteacher' then 'Instructor editor' when 'teacher' then 'Instructor' when 'student' then 'Aprendiz' end, shortname)
           from mdl_role where shortname not in ('guest', 'user', 'frontpage')
         union all select distinct 'modalidad', modality, modality from x_home where modality <> 'No definido'
         union all select 'id_categoria', cast(id as varchar), name from mdl_course_categories) o""",
)
check(
    "profile_fields",
    options.profile_fields,
    "select id, shortname, name, datatype from mdl_user_info_field order by shortname",
)

# -- export -----------------------------------------------------------------------

_ORDER = ["fullname", "role_text", "person", "course_id", "userid"]
_ROWS = """
    select h.fullname, coalesce(r.role_names, 'Sin rol asignado') as role_text, u.person, a.course_id, a.userid, a.enrolment_state
    from x_any a join x_home h using (course_id) join x_present u using (userid) left join x_roles r using (userid, course_id)"""


def _rows(t: LmsTables):
    return (
        R._with_roles(enrolments.any_active(t), t)
        .join(courses.parsed(t).select("course_id", "fullname"), "course_id")
        .join(R._people(t, ()).filter(F.col("deleted") == 0).select("userid", "person"), "userid")
        .select(*_ORDER, "enrolment_state")
    )


def _order():
    return [F.col(c).asc_nulls_last() for c in _ORDER]


_INDEXED = (
    f"select *, row_number() over (order by {', '.join(_ORDER)}) - 1 as idx from ({_ROWS}) z"
)
check(
    "export_part_assign",
    lambda t: export.assign_parts(_rows(t), _order(), 700),
    f"select *, cast(idx // 700 + 1 as integer) as parte from ({_INDEXED}) q",
)


def _breaks(df):
    """A value with a line break, quotation marks and a comma in every row."""
    return df.withColumn("nota", F.concat(F.lit('a "b",\n'), F.col("person")))


def _written(t: LmsTables) -> str:
    path = scratch_path(t.spark, "csv")
    export.write_csv_parts(
        _breaks(_rows(t)), _order(), path, "registro", 700, {"regional": "Huila", "nivel": None}, "Registro",
        datetime(2024, 1, 15),
    )
    return path


check(
    "export_csv_parts",
    lambda t: export.read_csv_parts(t.spark, _written(t), "registro", _breaks(_rows(t)).schema),
    f"""select fullname, role_text, person, cast(course_id as varchar) as course_id, cast(userid as varchar) as userid,
          enrolment_state, 'a "b",' || chr(10) || person as nota, cast(idx // 700 + 1 as integer) as parte from ({_INDEXED}) q""",
)
check(
    "export_heading",
    lambda t: export.read_heading(t.spark, _written(t), "registro"),
    f"""select cast(line as integer) as line, text from (values (0, 'Nombre del reporte,Registro'), (1, 'Fecha de generación,2024/01/15'),
          (2, 'Hora de generación,00:00:00'), (3, 'nivel,Todos'), (4, 'regional,Huila')) v(line, text)
        where exists (select * from ({_ROWS}) z)""",
)
check(
    "export_manifest",
    lambda t: export.manifest(
        export.part_counts(export.assign_parts(_rows(t), _order(), 700)), "registro", "csv", {}, datetime(2024, 1, 15)
    ).drop("filtros"),
    f"""select 'registro' as reporte, 'csv' as formato, cast(parte as integer) as parte, cast(n as bigint) as filas,
          'registro_parte_' || lpad(cast(parte as varchar), 3, '0') || '.csv' as archivo, '2024-01-15T00:00:00' as generado_en
        from (select idx // 700 + 1 as parte, count(*) as n from ({_INDEXED}) q group by 1) parts""",
)
check(
    "preview_top50",
    lambda t: R.preview(_rows(t).orderBy(*_order())),
    f"select * from ({_ROWS}) z order by {', '.join(_ORDER)} limit 50",
)
check(
    "normalize_output",
    lambda t: export.file_values(
        t.user.select(
            "id",
            "firstname",
            F.timestamp_seconds("timecreated").alias("made"),
            F.to_date(F.timestamp_seconds("timecreated")).alias("made_day"),
            (F.col("id") / F.lit(4)).cast("decimal(12,2)").alias("quarter"),
        )
    ),
    """select cast(id as varchar) as id, coalesce(firstname, '') as firstname,
         coalesce(strftime(make_timestamp(timecreated * 1000000), '%Y-%m-%dT%H:%M:%S'), '') as made,
         coalesce(strftime(make_timestamp(timecreated * 1000000), '%Y-%m-%d'), '') as made_day,
         cast(id / 4 as varchar) as quarter from mdl_user""",
)
check(
    "retention_expired",
    lambda t: export.expire_old_files(t.table("solicitudes")),
    """select id, usuario_email, case when n > 100 then 'EXPIRADO' else estado end as estado,
         case when n > 100 then null else archivo_ruta end as archivo_ruta, fecha_fin
       from (select s.*, case when estado = 'FINALIZADO' and archivo_ruta is not null then
               row_number() over (partition by usuario_email, estado = 'FINALIZADO' and archivo_ruta is not null
                 order by fecha_fin desc nulls first, id desc) end as n from solicitudes s) r""",
)
check(
    "requests_recent",
    lambda t: export.recent_requests(t.table("solicitudes"), "u1@example.org").select(
        "id", "reporte_codigo", "estado", "formato", "fecha_solicitud"
    ),
    """select id, reporte_codigo, estado, formato, fecha_solicitud from solicitudes where usuario_email = 'u1@example.org'
       order by fecha_solicitud desc nulls first, id desc limit 100""",
)

# -- shared relations -------------------------------------------------------------

check("rel_course_parsed", courses.parsed, "select * from x_course")
check(
    "rel_course_origin",
    courses.origins,
    "select course_id, origin from x_home",
)
check(
    "rel_region_center",
    lambda t: courses.described(t, S).select("course_id", "region_name", "center_name", "region", "center"),
    "select course_id, region_name, center_name, region, center from x_home",
)
check("rel_roles_user_course", people.roles_by_user_course, "select * from x_roles")
check("rel_roles_user", people.roles_by_user, "select * from x_user_roles")
check(
    "rel_roles_user_ctx",
    lambda t: people.roles_by_user(t, people.SYSTEM, people.CATEGORY, people.COURSE),
    "select * from x_user_roles_ctx",
)
check("rel_enrol_any_active", enrolments.any_active, "select * from x_any")
check(
    "rel_enrol_period",
    lambda t: enrolments.in_period(t, "2024-01-12", "2024-01-13", S),
    """select userid, course_id, min(coalesce(nullif(timestart, 0), timecreated)) as first_start,
         case when bool_or(coalesce(timeend, 0) = 0) then 0 else max(timeend) end as last_end,
         case when bool_or(status = 0 and method_status = 0) then 'Activo' else 'Suspendido' end as enrolment_state,
         case when bool_or(method_status = 0) then 'Activo' else 'Inactivo' end as method_state
       from x_ue where coalesce(nullif(timestart, 0), timecreated) <= 1705208399
         and (coalesce(timeend, 0) = 0 or timeend >= 1705035600) group by 1, 2""",
)
check("rel_enrol_valid_now", lambda t: enrolments.valid_now(t, S), "select * from x_now")
check(
    "rel_enrol_dates",
    enrolments.with_dates,
    """select userid, course_id, case when bool_or(status = 0 and method_status = 0) then 'Activo' else 'Inactivo' end as group_state,
         min(timecreated) as first_enrolled, max(timemodified) as last_changed, min(nullif(timestart, 0)) as first_start,
         max(nullif(timeend, 0)) as last_end from x_ue group by 1, 2""",
)
check(
    "rel_enrol_status",
    enrolments.by_user_status,
    "select userid, course_id, case when enrolment_state = 'Activa' then 'Activo' else 'Inactivo' end as group_state from x_any",
)
check("rel_course_role_counts", lambda t: enrolments.role_counts(t, S), "select * from x_counts")
check(
    "rel_base_enrolments",
    lambda t: R._with_roles(enrolments.with_dates(t), t)
    .join(courses.described(t, S), "course_id")
    .join(
        R._people(
            t, ("cc", "dni", "ce", "ppt", "ti"), F.coalesce(F.nullif("idnumber", F.lit("")), "username")
        ).filter(F.col("deleted") == 0),
        "userid",
    )
    .select(
        "userid", "course_id", "idnumber", "program_title", "role_text", "group_state", "user_state", "identity",
        "document_type", "document", "person", "email", "first_enrolled", "last_end",
    ),
    f"""select u.userid, d.course_id, h.idnumber, h.program_title, coalesce(r.role_names, 'Sin rol asignado') as role_text,
          d.group_state, u.user_state, u.identity, {doc_type('identity', K5)} as document_type,
          {doc_number('identity', K5)} as document, u.person, u.email, d.first_enrolled, d.last_end
        from (select userid, course_id, case when bool_or(status = 0 and method_status = 0) then 'Activo' else 'Inactivo' end as group_state,
                min(timecreated) as first_enrolled, max(nullif(timeend, 0)) as last_end from x_ue group by 1, 2) d
        join x_home h using (course_id) join x_present u using (userid) left join x_roles r using (userid, course_id)""",
)
check(
    "rel_base_users",
    lambda t: R.time_base(t, clean("tiempo_permanencia", {}), S).select(
        "userid", "course_id", "idnumber", "role_text", "group_state", "user_state", "document_type", "document", "person"
    ),
    f"""select u.userid, a.course_id, h.idnumber, coalesce(r.role_names, 'Sin rol asignado') as role_text,
          case when a.enrolment_state = 'Activa' then 'Activo' else 'Inactivo' end as group_state, u.user_state,
          {doc_type('username', K5)} as document_type, {doc_number('username', K5)} as document, u.person
        from x_any a join x_home h using (course_id) join x_user u using (userid) left join x_roles r using (userid, course_id)""",
)
check("rel_course_access", lambda t: access.course_access(t, S), "select * from x_access")
check("rel_course_views", lambda t: access.course_views(t, S), "select * from x_views")
check(
    "rel_access_distinct_ts",
    lambda t: access.distinct_view_times(t, S),
    """select userid, courseid as course_id, count(distinct timecreated) as accesses, max(timecreated) as last_access
       from lg where action = 'viewed' and userid > 0 and courseid is not null group by 1, 2""",
)
check(
    "rel_login_events",
    lambda t: access.login_events(t, S).withColumn("login_at", F.col("login_at").cast("string")),
    "select * replace (cast(login_at as varchar) as login_at) from x_login",
)
check("rel_valid_access", lambda t: access.valid_access(t, S), "select * from x_valid")
check(
    "rel_unique_user_day",
    lambda t: access.unique_user_days(access.valid_access(t, S)),
    "select distinct origin, day, userid from x_valid",
)
check(
    "rel_period_bucket",
    lambda t: access.by_period(access.unique_user_days(access.valid_access(t, S)), "Mes"),
    "select distinct origin, day, userid, cast(date_trunc('month', day) as date) as period from x_valid",
)
check(
    "rel_tool_activity",
    lambda t: tools.modules(t)
    .filter(F.col("course_id") != 1)
    .join(tools.valid_module_users(t, P), ["course_id", "module_id"], "left")
    .select("course_id", "module_id", "tool", "userid"),
    """select m.course_id, m.module_id, m.tool, a.userid from (select distinct course_id, module_id, tool from x_activity) m
       left join (select distinct course_id, module_id, userid from x_activity where userid is not null) a using (course_id, module_id)""",
)
check(
    "tool_usage_long",
    lambda t: tools.tool_usage(t, S, P),
    "select * from x_usage",
)
for _key, _fn in {
    "blogs": tools.blogs,
    "quizzes": tools.quizzes,
    "assignments": tools.assignments,
    "forums": tools.forums,
    "forum_replies": tools.forum_replies,
    "surveys": tools.surveys,
    "wikis": tools.wikis,
    "scorm": tools.scorm,
    "sessions": tools.sessions,
    "chats": tools.chats,
    "announcements": tools.announcements,
}.items():
    check(
        f"tool_{_key}",
        lambda t, fn=_fn: fn(t, P),
        f"select * from t_{'replies' if _key == 'forum_replies' else _key}",
    )


def _dense(t: LmsTables) -> LmsTables:
    return t.with_log("mdl_logstore_dense")


check(
    "rel_event_gaps",
    lambda t: timeontask.next_event(timeontask.events(_dense(t), S), ["userid", "course_id"], S.gap_slice_seconds),
    "select * from x_gap",
)
check("rel_capped_gap", lambda t: timeontask.gaps(_dense(t), S), "select * from x_seconds")
check(
    "rel_gap_tool",
    lambda t: timeontask.per_tool(t, timeontask.per_instance(_dense(t), S)),
    "select userid, course_id, tool, cast(sum(seconds) as bigint) as seconds from x_spent group by 1, 2, 3",
)
check(
    "rel_gap_tool_strict",
    lambda t: timeontask.per_tool(t, timeontask.per_instance(_dense(t), S, strict_context=True)),
    """select userid, course_id, tool, cast(sum(seconds) as bigint) as seconds from (
         select s.userid, s.course_id, s.seconds, case when m.module_name is null then 'curso' when m.module_name = 'forum' then
             case m.forum_type when 'blog' then 'blog' when 'news' then 'anuncio' else 'foro' end
           when m.module_name = 'attendance' then 'asistencia' else m.module_name end as tool
         from x_seconds s left join x_module m on m.module_id = s.contextinstanceid and s.contextlevel = 70) z group by 1, 2, 3""",
)
check(
    "rel_time_pivot",
    lambda t: timeontask.pivoted(timeontask.per_tool(t, timeontask.per_instance(_dense(t), S))),
    "select * from x_pivot",
)
check("rel_session_stats", online.stats, "select * from x_stats")
check("rel_user_creator", people.creators, "select * from x_creator")
check("rel_profile_fields", people.profile_documents, "select * from x_doc")

"""Checks of the ten current reports and their variants."""

from __future__ import annotations

from checks.base import (
    K4, K5, NOW, S, check, day, doc_number, doc_type, labelled, local, part, ratio, stamp, stamp_or,
    valid, zero_or_stamp,
)
from lectern.functions.labels import NOT_AVAILABLE, NOT_IN_LOG
from lectern.operators import access, tools
from lectern.plans import columns as C
from lectern.plans import reports as R
from lectern.plans import variants as V

UNSET = "No definida"
ROLE = "coalesce(r.role_names, 'Sin rol asignado') as role_text"


def both(key: str, fn, sql, params: dict, where: str) -> None:
    """Check a report unfiltered and with filters."""
    check(key, lambda t: fn(t, None, S), sql("true"))
    check(f"{key}_filtered", lambda t: fn(t, params, S), sql(where))


def dates(start: str = "startdate", end: str = "enddate", show=stamp_or) -> str:
    return f"{show(start, UNSET)} as start_text, {show(end, UNSET)} as end_text"


# -- 1 ----------------------------------------------------------------------------


def _registro(where: str, access: str = "x_access", base: str = "x_any a") -> str:
    return labelled(
        C.REGISTRO_USUARIOS,
        f"""select h.*, {ROLE}, {doc_type('username', K4)} as document_type, {doc_number('username', K4)} as document, u.person,
              case when first_access is null then 'Sin acceso' else {stamp('first_access')} end as first_access_text,
              {stamp_or('u.lastaccess', 'Sin acceso')} as last_lms_access, coalesce(access_days, 0) as access_days,
              coalesce(accesses, 0) as accesses, a.enrolment_state, {dates()}
            from {base} join x_home h using (course_id) join x_present u using (userid)
            left join x_roles r using (userid, course_id) left join {access} v using (userid, course_id) where {where}""",
    )


both(
    "registro_usuarios",
    R.registro_usuarios,
    _registro,
    {"rol_usuario": "student", "estado_aprendiz": "Activa", "nivel": "titulada", "codigo_ficha": "500002", "regional": "99"},
    "r.role_shortnames ilike '%student%' and enrolment_state = 'Activa' and level ilike '%titulada%' and idnumber = '500002'"
    " and region_name ilike '%99%'",
)
check(
    "registro_usuarios_hour",
    lambda t: R.registro_usuarios(
        t, {"hora": "07:30", "fecha_inicio": "2024-01-05", "fecha_fin": "2024-01-25", "origen_datos": "Manual"}, S
    ),
    _registro(
        "origin = 'Manual'",
        access=f"""(select userid, courseid as course_id, count(distinct {day('timecreated')}) as access_days, count(*) as accesses,
            min(timecreated) as first_access, max(timecreated) as last_access from lg
          where userid > 0 and courseid is not null and action = 'viewed' and target = 'course' and hour({local('timecreated')}) = 7
            and {day('timecreated')} between date '2024-01-05' and date '2024-01-25' group by 1, 2)""",
    ),
)

# -- 2 ----------------------------------------------------------------------------


def _logins(columns: dict, keys: str, where: str) -> str:
    return labelled(
        columns,
        f"""select coalesce(r.role_names, 'Sin rol') as role_text, {keys}, count(*) as logins, count(distinct l.userid) as users,
              '{NOT_IN_LOG}' as system, '{NOT_IN_LOG}' as browser
            from x_login l left join x_user_roles r using (userid) where {where} group by 1, {keys}""",
    )


both(
    "ingresos_sistema",
    R.ingresos_sistema,
    lambda where: _logins(C.INGRESOS_SISTEMA, "country, city, ip", where),
    {"fecha_desde": "2024-01-05", "fecha_hasta": "2024-01-20", "semana": "2", "mes": "1", "hora": "9", "pais": "nation", "ciudad": "MACH"},
    "cast(login_at as date) between date '2024-01-05' and date '2024-01-20' and extract(week from login_at) = 2"
    " and month(login_at) = 1 and hour(login_at) = 9 and country ilike '%nation%' and city ilike '%mach%'",
)

# -- 3 ----------------------------------------------------------------------------


def _matriculas(where: str, period: str = "x_period") -> str:
    return labelled(
        C.MATRICULAS_LMS,
        f"""select h.*, {ROLE}, {doc_type('username', K4)} as document_type, {doc_number('username', K4)} as document, u.person,
              u.user_state, p.enrolment_state, p.method_state, {dates()}, {stamp_or('p.first_start', UNSET)} as enrolled_text,
              {stamp_or('p.last_end', UNSET)} as left_text
            from {period} p join x_home h using (course_id) join x_present u using (userid)
            left join x_roles r using (userid, course_id) where {where}""",
    )


check("matriculas_lms", lambda t: R.matriculas_lms(t, None, S), _matriculas("true"))
check(
    "matriculas_lms_filtered",
    lambda t: R.matriculas_lms(
        t,
        {"fecha_desde": "2024-01-12", "fecha_hasta": "2024-01-13", "modalidad": "presencial", "estado_grupo": "Finalizado",
         "fecha_inicio": "2024-01-02"},
        S,
    ),
    _matriculas(
        f"modality ilike '%presencial%' and course_state = 'Finalizado' and {day('startdate')} = date '2024-01-02'",
        """(select userid, course_id, min(coalesce(nullif(timestart, 0), timecreated)) as first_start,
              case when bool_or(coalesce(timeend, 0) = 0) then 0 else max(timeend) end as last_end,
              case when bool_or(status = 0 and method_status = 0) then 'Activo' else 'Suspendido' end as enrolment_state,
              case when bool_or(method_status = 0) then 'Activo' else 'Inactivo' end as method_state
            from x_ue where coalesce(nullif(timestart, 0), timecreated) < 1705208400
              and (coalesce(timeend, 0) = 0 or timeend >= 1705035600) group by 1, 2)""",
    ),
)

# -- 4 ----------------------------------------------------------------------------


def _usuarios(where: str) -> str:
    return labelled(
        C.USUARIOS_AMBIENTE,
        f"""select '{S.environment}' as environment, coalesce(r.role_names, 'Sin rol') as role_text,
              {doc_type('m.username', K5)} as document_type, {doc_number('m.username', K5)} as document, x.person, x.user_state, m.auth,
              case m.auth when 'manual' then 'Manual' else 'Integración / Externo' end as auth_origin,
              {stamp_or('m.timecreated', 'No disponible')} as created_text,
              case when m.lastaccess > 0 then {stamp('m.lastaccess')} else 'Sin acceso' end as last_lms_access,
              coalesce(k.creator_name, 'No disponible') as creator
            from mdl_user m join x_user x on x.userid = m.id left join x_creator k on k.created_userid = m.id
            left join x_user_roles_ctx r on r.userid = m.id where m.id > 2 and {where}""",
    )


both(
    "usuarios_ambiente",
    R.usuarios_ambiente,
    _usuarios,
    {"mes": "8", "anio": "2023", "origen_datos": "Manual", "fecha_desde": "2023-08-02", "fecha_hasta": "2023-08-20"},
    f"month({local('m.timecreated')}) = 8 and year({local('m.timecreated')}) = 2023 and m.auth = 'manual'"
    f" and {day('m.timecreated')} between date '2023-08-02' and date '2023-08-20'",
)

# -- 5 ----------------------------------------------------------------------------


def _fichas(where: str) -> str:
    cells = ", ".join(
        f"coalesce(n.{c}, 0) as {c}"
        for c in ("teachers_active", "students_active", "teachers_inactive", "students_inactive")
    )
    return labelled(
        C.FICHAS_PROGRAMAS,
        f"""select h.*, {cells}, '{NOT_AVAILABLE}' as program_state, '{NOT_AVAILABLE}' as external_state,
              {stamp_or('course_created', UNSET)} as created_text, {dates()}
            from x_home h left join x_counts n using (course_id) where course_created <= {NOW} and {where}""",
    )


both(
    "fichas_programas",
    R.fichas_programas,
    _fichas,
    {"rol_usuario": "student", "estado_aprendiz": "Activo", "centro_formacion": "nation", "fecha_desde": "2023-11-20",
     "fecha_inicio": "2024-01-02", "fecha_fin": "2024-02-20", "codigo_programa": "10"},
    f"""course_id in (select course_id from x_course_role where shortname = 'student')
        and course_id in (select r.course_id from x_course_role r join x_now n using (userid, course_id)
          where r.shortname = 'student' and n.valid_state = 'Activo')
        and center_name ilike '%nation%' and {day('course_created')} >= date '2023-11-20' and startdate > 0
        and {day('startdate')} >= date '2024-01-02' and enddate > 0 and {day('enddate')} <= date '2024-02-20'
        and program_code ilike '%10%'""",
)

check(
    "fichas_programas_hours",
    lambda t: R.fichas_programas(t, {"hora_creacion": "22:15", "hora_grupo": "05"}, S),
    _fichas(f"hour({local('course_created')}) = 22 and hour({local('startdate')}) = 5"),
)

# -- 6 ----------------------------------------------------------------------------


def _trafico(span: str, where: str = "true") -> str:
    unit = {"Día": "day", "Mes": "month", "Año": "year"}[span]
    fmt = {"Día": "%Y/%m/%d", "Mes": "%Y/%m", "Año": "%Y"}[span]
    return labelled(
        C.TRAFICO_DIARIO,
        f"""select '{S.traffic_environment}' as environment, origin, '{span}' as range, {part('year', 'period')} as year,
              {'cast(null as integer)' if span == 'Año' else part('month', 'period')} as month,
              {part('day', 'period') if span == 'Día' else 'cast(null as integer)'} as day_of_month,
              strftime(period, '{fmt}') as period_text, count(*) as users
            from (select distinct origin, cast(date_trunc('{unit}', day) as date) as period, day, userid from x_valid where {where}) d
            group by origin, period""",
    )


check("trafico_diario", lambda t: R.trafico_diario(t, None, S), _trafico("Día"))
check("trafico_mensual", lambda t: R.trafico_diario(t, {"rango_consulta": "mes"}, S), _trafico("Mes"))
check("trafico_anual", lambda t: R.trafico_diario(t, {"rango_consulta": "ano", "origen_datos": "todas"}, S), _trafico("Año"))
check(
    "trafico_diario_filtered",
    lambda t: R.trafico_diario(
        t, {"fecha_desde": "2024-01-08", "fecha_hasta": "2024-01-20", "origen_datos": "sofia plus"}, S
    ),
    _trafico("Día", "day between date '2024-01-08' and date '2024-01-20' and origin = 'Integración'"),
)

# -- 7 ----------------------------------------------------------------------------


def _uso(where: str, usage: str = "x_usage", columns: dict = C.USO_HERRAMIENTAS, show=stamp_or, start: str | None = None) -> str:
    cells = ", ".join(
        f"coalesce(cast(sum(case when tool = '{x}' then {m} end) as bigint), 0) as {x}_{m}"
        for x in tools.USAGE_TOOLS
        for m in ("users", "items")
    )
    shown = dates(show=show) if start is None else f"{start} as start_text, {show('enddate', UNSET)} as end_text"
    return labelled(
        columns,
        f"""select h.*, n.* exclude (course_id), 0 as notification_users, 0 as notification_items, {shown}
            from x_home h join (select h.course_id, {cells} from x_home h left join {usage} z using (course_id) group by 1) n
              using (course_id) where {where}""",
    )


both(
    "uso_herramientas",
    R.uso_herramientas,
    _uso,
    {"rol_usuario": "teacher", "origen_datos": "Todas", "nombre_programa": "widget", "hora_grupo": "5", "fecha_inicio": "2024-01-01",
     "fecha_fin": "2024-03-01"},
    f"""course_id in (select course_id from x_course_role where shortname = 'teacher') and program_title ilike '%widget%'
        and startdate > 0 and hour({local('startdate')}) = 5 and {day('startdate')} >= date '2024-01-01' and enddate > 0
        and {day('enddate')} <= date '2024-03-01'""",
)
# A course filter alone: facts of other courses are cut away, lookups must not be.
check(
    "uso_herramientas_one_course",
    lambda t: R.uso_herramientas(t, {"codigo_ficha": "50014"}, S),
    _uso("idnumber ilike '%50014%'"),
)
check(
    "uso_herramientas_one_center",
    lambda t: R.uso_herramientas(t, {"centro_formacion": "nation"}, S),
    _uso("center_name ilike '%nation%'"),
)
check(
    "uso_herramientas_period",
    lambda t: R.uso_herramientas(t, {"fecha_desde": "2024-01-05", "fecha_hasta": "2024-01-15", "hora_consulta": "10:00"}, S),
    _uso(
        "true",
        f"""(select m.course_id, m.tool, count(distinct module_id) as items, count(distinct
               case when exists (select 1 from x_ue ue where ue.course_id = l.courseid and ue.userid = l.userid and {valid('l.timecreated')})
               then v.userid end) as users
             from x_tool m left join lg l on l.courseid = m.course_id and l.contextinstanceid = m.module_id and l.contextlevel = 70
               and l.userid > 0 and {day('l.timecreated')} between date '2024-01-05' and date '2024-01-15' and hour({local('l.timecreated')}) = 10
             left join x_live v on v.userid = l.userid where coalesce(m.deletioninprogress, 0) = 0 group by 1, 2)""",
    ),
)

# -- 8 ----------------------------------------------------------------------------

_TOOLS = ("wikis", "surveys", "forums", "replies", "quizzes", "blogs", "assignments", "scorm", "sessions", "chats", "announcements")
_PAIRS = """(select userid, course_id, case when bool_or(status = 0 and method_status = 0) then 'Activo' else 'Inactivo' end as group_state
             from x_ue group by 1, 2)"""


def _participacion(where: str, columns: dict = C.PARTICIPACION_HERRAMIENTAS, source: dict | None = None, extra: str = "") -> str:
    source = source or {}
    cells = ", ".join(f"coalesce(cast({m}.total as bigint), 0) as {m}" for m in _TOOLS)
    joins = " ".join(f"left join {source.get(m, f't_{m}')} {m} using (userid, course_id)" for m in _TOOLS)
    return labelled(
        columns,
        f"""select h.*, {ROLE}, {doc_type('u.identity', K5)} as document_type, {doc_number('u.identity', K5)} as document,
              u.person, u.email, u.user_state, a.group_state, '{NOT_AVAILABLE}' as program_state, {dates(show=zero_or_stamp)},
              coalesce(v.accesses, 0) as accesses, coalesce({stamp('v.last_access')}, 'Sin ingreso registrado') as last_access_text,
              {cells} {extra}
            from {_PAIRS} a join x_home h using (course_id) join x_present u using (userid)
            left join x_roles r using (userid, course_id) left join x_views v using (userid, course_id) {joins} where {where}""",
    )


both(
    "participacion_herramientas",
    R.participacion_herramientas,
    _participacion,
    {"rol_usuario": "APRENDIZ", "estado_usuario": "Activo", "estado_aprendiz": "Activo", "identificacion": "000", "nombres_apellidos": "0001",
     "fecha_inicio": "2024-01-02", "fecha_fin": "2024-03-01", "nombre_ficha": "ring"},
    f"""(coalesce(r.role_shortnames, '') ilike '%aprendiz%' or r.role_names ilike '%aprendiz%') and user_state = 'Activo'
        and group_state = 'Activo' and identity ilike '%000%' and person ilike '%0001%' and {day('startdate')} >= date '2024-01-02'
        and enddate > 0 and {day('enddate')} <= date '2024-03-01' and fullname ilike '%ring%'""",
)


check(
    "participacion_one_course",
    lambda t: R.participacion_herramientas(t, {"codigo_ficha": "50014"}, S),
    _participacion("idnumber ilike '%50014%'"),
)
check(
    "participacion_one_person",
    lambda t: R.participacion_herramientas(t, {"identificacion": "0001"}, S),
    _participacion(f"(identity ilike '%0001%' or {doc_number('u.identity', K5)} ilike '%0001%')"),
)


def _period_posts(test: str) -> str:
    return (
        f"(select userid, course_id, count(*) as total from x_post where {test}"
        f" and {day('created')} between date '2024-01-05' and date '2024-01-12' group by 1, 2)"
    )


_BETWEEN = "between date '2024-01-05' and date '2024-01-12'"
def _period_parts() -> dict[str, str]:
    """Each measure of the period on its own: userid, course_id, total."""

    def logged(test: str, total: str = "count(*)", more: str = "") -> str:
        return f"""(select userid, courseid as course_id, {total} as total{more} from lg where userid > 0 and courseid is not null
            and {test} and {day('timecreated')} {_BETWEEN} group by 1, 2)"""

    def done(rows: str, activities: str, key: str, test: str, total: str = "count(*)") -> str:
        return f"""(select b.userid, a.course as course_id, {total} as total from {rows} b join {activities} a on a.id = b.{key}
            where {test} {_BETWEEN} group by 1, 2)"""

    view = f"(eventname = '{access.COURSE_VIEWED}' or (component = 'core' and target = 'course' and action = 'viewed'))"
    package = "component = 'mod_scorm' and (action in ('viewed', 'launched', 'submitted', 'completed', 'updated') or eventname ilike '%scorm%')"
    sent = "case when timemodified = 0 or timemodified is null then timecreated else timemodified end"
    surveys = " union all ".join(
        f"select * from {done(rows, table, key, day(at))} z"
        for rows, table, key, at in (
            ("mdl_feedback_completed", "mdl_feedback", "feedback", "timemodified"),
            ("mdl_survey_answers", "mdl_survey", "survey", "b.time"),
        )
    )
    return {
        "accesses": logged(view, more=", max(timecreated) as last_access"),
        "wikis": logged("component = 'mod_wiki' and (eventname ilike '%page_updated%' or action in ('created', 'updated'))"),
        "surveys": f"({surveys})",
        "forums": _period_posts("type not in ('news', 'blog') and userid > 0"),
        "replies": _period_posts("type not in ('news', 'blog') and parent > 0"),
        "quizzes": done("mdl_quiz_attempts", "mdl_quiz", "quiz", f"state = 'finished' and timefinish > 0 and {day('timefinish')}"),
        "blogs": _period_posts("type = 'blog' and userid > 0"),
        "assignments": done("mdl_assign_submission", "mdl_assign", "assignment", f"status = 'submitted' and {day(sent)}", "count(distinct assignment)"),
        "scorm": logged(package, "count(distinct coalesce(contextinstanceid, objectid, id))"),
        "sessions": done("mdl_bigbluebuttonbn_logs", "mdl_bigbluebuttonbn", "bigbluebuttonbnid", f"b.userid > 0 and {day('b.timecreated')}", "count(distinct a.id)"),
        "chats": done("mdl_chat_messages", "mdl_chat", "chatid", f"b.userid > 0 and {day('timestamp')}"),
        "announcements": _period_posts("type = 'news'"),
    }


def _period_sql() -> str:
    rows = " union all ".join(
        f"select userid, course_id, '{name}' as what, total, {'last_access' if name == 'accesses' else 'null'} as last_access from {sql} z"
        for name, sql in _period_parts().items()
    )
    sums = ", ".join(f"cast(coalesce(sum(case when what = '{m}' then total end), 0) as bigint) as {m}" for m in tools.MEASURES)
    return f"select userid, course_id, {sums}, max(last_access) as last_access from ({rows}) y group by 1, 2"


check(
    "participacion_period",
    lambda t: tools.participation(t, tools.Period("2024-01-05", "2024-01-12", S.report_tz)).filter(
        " + ".join(tools.MEASURES) + " > 0"
    ),
    _period_sql(),
)

# -- 9 ----------------------------------------------------------------------------

_PCTS = ("wiki", "surveys", "forums", "quizzes", "blogs", "assignments", "scorm", "sessions", "chats", "attendance")


def _tiempo(where: str) -> str:
    cells = ", ".join(f"{ratio(f'p.sec_{n} * 100', 'p.sec_total')} as pct_{n}" for n in _PCTS)
    return labelled(
        C.TIEMPO_PERMANENCIA,
        f"""select h.*, {doc_type('u.username', K5)} as document_type, {doc_number('u.username', K5)} as document, u.person,
              case a.enrolment_state when 'Activa' then 'Activo' else 'Inactivo' end as group_state, '{NOT_AVAILABLE}' as program_state,
              {stamp('startdate')} as start_text, {zero_or_stamp('enddate', UNSET)} as end_text, coalesce(v.accesses, 0) as accesses,
              {stamp('v.last_access')} as last_access_text, {cells}, {ratio('p.sec_total', '60')} as minutes
            from x_pivot p join x_any a using (userid, course_id) join x_home h using (course_id) join x_user u using (userid)
            left join x_roles r using (userid, course_id)
            left join (select userid, courseid as course_id, count(distinct timecreated) as accesses, max(timecreated) as last_access
              from mdl_logstore_dense where action = 'viewed' and userid > 0 and courseid is not null group by 1, 2) v using (userid, course_id)
            where p.sec_total > 0 and {where}""",
    )


both(
    "tiempo_permanencia",
    lambda t, p, s: R.tiempo_permanencia(t.with_log("mdl_logstore_dense"), p, s),
    _tiempo,
    {"rol_usuario": "student", "estado_usuario": "Activo", "regional": "region", "codigo_programa": "10", "origen_datos": "Integración",
     "estado_aprendiz": NOT_AVAILABLE},
    "r.role_shortnames ilike '%student%' and u.user_state = 'Activo' and region_name ilike '%region%' and program_code ilike '%10%'"
    " and origin = 'Integración'",
)

check(
    "tiempo_one_course",
    lambda t: R.tiempo_permanencia(t.with_log("mdl_logstore_dense"), {"codigo_ficha": "50014"}, S),
    _tiempo("idnumber ilike '%50014%'"),
)

# -- 10 ---------------------------------------------------------------------------


def _sesiones(where: str, flag: bool = False) -> str:
    def when_set(e: str) -> str:
        return f"case when {e} > 0 then {stamp(e)} else '{UNSET}' end"

    stats = (
        "(select bigbluebuttonbnid as session_id, count(*) filter (where log in ('Join', 'joined', 'Attended')) as joins,"
        " bool_or(log = 'Create') as started from mdl_bigbluebuttonbn_logs where userid > 0 group by 1)"
        if flag
        else "x_stats"
    )
    shown = f"{stamp('startdate')} as start_text, {zero_or_stamp('enddate', UNSET)} as end_text" if flag else dates(show=zero_or_stamp)
    taped = "(t.session_id is not null or b.record = 1)" if flag else "t.session_id is not null"
    return labelled(
        C.SESIONES_ONLINE,
        f"""select h.*, '{NOT_AVAILABLE}' as program_state, {shown}, coalesce(z.joins, 0) as joins, b.meetingid, b.name as session_name,
              {when_set('b.openingtime')} as opening_text, {when_set('b.closingtime')} as closing_text,
              case when z.started then 'Sí' else 'No' end as started_text, case when {taped} then 'Sí' else 'No' end as recorded_text
            from mdl_bigbluebuttonbn b join x_home h on h.course_id = b.course left join {stats} z on z.session_id = b.id
            left join x_taped t on t.session_id = b.id where {'true' if flag else 'b.openingtime > 0'} and {where}""",
    )


both(
    "sesiones_online",
    R.sesiones_online,
    _sesiones,
    {"rol_usuario": "student", "identificacion": "0000", "nombres_apellidos": "customer#0000000", "fecha_desde": "2024-01-05",
     "fecha_hasta": "2024-01-25", "fecha_inicio_grupo_desde": "2024-01-02", "fecha_creacion_grupo_hasta": "2024-01-30"},
    f"""exists (select 1 from mdl_bigbluebuttonbn_logs g join x_course_role q on q.userid = g.userid and q.course_id = b.course
          where g.bigbluebuttonbnid = b.id and (q.shortname ilike '%student%' or q.role_name ilike '%student%'))
        and exists (select 1 from mdl_bigbluebuttonbn_logs g join x_user q on q.userid = g.userid
          where g.bigbluebuttonbnid = b.id and (q.identity ilike '%0000%' or q.username ilike '%0000%'))
        and exists (select 1 from mdl_bigbluebuttonbn_logs g join x_user q on q.userid = g.userid
          where g.bigbluebuttonbnid = b.id and q.person ilike '%customer#0000000%')
        and {day('b.openingtime')} between date '2024-01-05' and date '2024-01-25' and {day('startdate')} >= date '2024-01-02'
        and {day('course_created')} <= date '2024-01-30'""",
)

# -- variants ---------------------------------------------------------------------

check(
    "trafico_por_hora",
    lambda t: V.trafico_por_hora(t, {"origen_datos": "Integración"}, S),
    labelled(
        V.TRAFICO_POR_HORA,
        f"""select '{S.traffic_environment}' as environment, {part('year', 'd')} as year, {part('month', 'd')} as month, {part('day', 'd')} as day_of_month,
              strftime(d, '%H:00 - %H:59') as band, count(distinct userid) as users
            from (select l.userid, date_trunc('hour', {local('l.timecreated')}) as d from lg l join mdl_user u on u.id = l.userid
                  join x_home h on h.course_id = l.courseid
                  where l.userid > 0 and u.deleted = 0 and l.action = 'viewed' and h.origin = 'Integración') z group by d""",
    ),
)
_OPENED = """(select d.userid, f.course as course_id, count(distinct d.id) as total from mdl_forum_discussions d join mdl_forum f on f.id = d.forum
              where f.type not in ('news', 'blog') group by 1, 2)"""
_FIRST = "(select userid, course_id, count(id) as total from x_post where type = 'blog' and parent = 0 group by 1, 2)"
check(
    "participacion_total",
    lambda t: V.participacion_total(t, None, S),
    _participacion(
        "true",
        V.PARTICIPACION_TOTAL,
        {"forums": _OPENED, "blogs": _FIRST},
        ", " + " + ".join(f"coalesce(cast({m}.total as bigint), 0)" for m in _TOOLS) + " as total",
    ),
)
_OUTER = """
    select r.course_id,
      count(distinct case when shortname in ('teacher', 'editingteacher') and state = 0 then r.userid end) as teachers_active,
      count(distinct case when shortname = 'student' and state = 0 then r.userid end) as students_active,
      count(distinct case when shortname in ('teacher', 'editingteacher') and state <> 0 then r.userid end) as teachers_inactive,
      count(distinct case when shortname = 'student' and state <> 0 then r.userid end) as students_inactive
    from (select q.*, coalesce(ue.status, 1) as state from x_course_role q left join mdl_enrol e on e.courseid = q.course_id
          left join mdl_user_enrolments ue on ue.userid = q.userid and ue.enrolid = e.id) r group by 1"""
check(
    "fichas_roles_outer",
    lambda t: V.fichas_roles_outer(t, None, S),
    labelled(
        V.FICHAS_ROLES_OUTER,
        f"""select h.*, coalesce(teachers_active, 0) as teachers_active, coalesce(students_active, 0) as students_active,
              coalesce(teachers_inactive, 0) as teachers_inactive, coalesce(students_inactive, 0) as students_inactive,
              '{NOT_AVAILABLE}' as program_state, '{NOT_AVAILABLE}' as external_state, {stamp('startdate')} as start_text,
              {zero_or_stamp('enddate', UNSET)} as end_text
            from x_home h left join ({_OUTER}) n using (course_id)""",
    ),
)
check(
    "matriculas_activas",
    lambda t: V.matriculas_activas(t, None, S),
    labelled(
        V.MATRICULAS_ACTIVAS,
        f"""select h.*, {ROLE}, {doc_type('username', K5)} as document_type, {doc_number('username', K5)} as document, u.person, u.user_state,
              'Activo' as enrolment_state, {stamp('startdate')} as start_text, {zero_or_stamp('enddate', UNSET)} as end_text,
              {stamp('e.timecreated')} as enrolled_text, {stamp_or('e.timeend', UNSET)} as left_text
            from x_ue e join x_home h using (course_id) join x_present u using (userid) left join x_roles r using (userid, course_id)
            where u.suspended = 0 and e.status = 0 and e.method_status = 0""",
    ),
)
check(
    "fichas_roles_outer_filtered",
    lambda t: V.fichas_roles_outer(
        t, {"estado_aprendiz": "Inactivo", "rol_usuario": "teacher", "fecha_inicio": "2024-01-10"}, S
    ),
    labelled(
        V.FICHAS_ROLES_OUTER,
        f"""select h.*, coalesce(teachers_active, 0) as teachers_active, coalesce(students_active, 0) as students_active,
              coalesce(teachers_inactive, 0) as teachers_inactive, coalesce(students_inactive, 0) as students_inactive,
              '{NOT_AVAILABLE}' as program_state, '{NOT_AVAILABLE}' as external_state, {stamp('startdate')} as start_text,
              {zero_or_stamp('enddate', UNSET)} as end_text
            from x_home h left join ({_OUTER}) n using (course_id)
            where course_id in (select course_id from x_course_role where shortname = 'teacher') and {day('startdate')} >= date '2024-01-10'
              and course_id in (select e.course_id from x_ue e join x_course_role r on r.userid = e.userid and r.course_id = e.course_id
                where r.shortname = 'student' and e.status <> 0)""",
    ),
)
check(
    "matriculas_activas_filtered",
    lambda t: V.matriculas_activas(t, {"fecha_inicio": "2024-01-04", "fecha_hasta": "2024-01-09", "rol_usuario": "student"}, S),
    labelled(
        V.MATRICULAS_ACTIVAS,
        f"""select h.*, {ROLE}, {doc_type('username', K5)} as document_type, {doc_number('username', K5)} as document, u.person, u.user_state,
              'Activo' as enrolment_state, {stamp('startdate')} as start_text, {zero_or_stamp('enddate', UNSET)} as end_text,
              {stamp('e.timecreated')} as enrolled_text, {stamp_or('e.timeend', UNSET)} as left_text
            from x_ue e join x_home h using (course_id) join x_present u using (userid) left join x_roles r using (userid, course_id)
            where u.suspended = 0 and e.status = 0 and e.method_status = 0 and r.role_shortnames ilike '%student%'
              and {day('startdate')} = date '2024-01-04' and coalesce(nullif(e.timestart, 0), e.timecreated) < 1704862800""",
    ),
)
check(
    "sesiones_record_flag_filtered",
    lambda t: V.sesiones_record_flag(t, {"rol_usuario": "student", "identificacion": "00010", "fecha_desde": "2024-01-03"}, S),
    _sesiones(
        f"""exists (select 1 from mdl_bigbluebuttonbn_logs g join x_course_role q on q.userid = g.userid and q.course_id = b.course
              where g.bigbluebuttonbnid = b.id and q.shortname = 'student')
            and exists (select 1 from mdl_bigbluebuttonbn_logs g join x_user q on q.userid = g.userid
              where g.bigbluebuttonbnid = b.id and q.username ilike '%00010%')
            and b.openingtime > 0 and {day('b.openingtime')} >= date '2024-01-03'""",
        flag=True,
    ),
)
_EACH = "(select id, userid, course_id, case when status = 0 then 'Activa' else 'Suspendida' end as enrolment_state from x_ue) a"
check(
    "registro_por_matricula",
    lambda t: V.registro_por_matricula(t, None, S),
    _registro("true", access="x_access_any", base=_EACH),
)
check(
    "registro_por_matricula_hour",
    lambda t: V.registro_por_matricula(t, {"hora": "7", "fecha_inicio": "2024-01-02"}, S),
    _registro(
        f"v.accesses is not null and {day('startdate')} >= date '2024-01-02'",
        access=f"""(select userid, courseid as course_id, count(distinct {day('timecreated')}) as access_days, count(*) as accesses,
            min(timecreated) as first_access, max(timecreated) as last_access from lg
          where userid > 0 and courseid is not null and action = 'viewed' and hour({local('timecreated')}) = 7 group by 1, 2)""",
        base=_EACH,
    ),
)
check(
    "ingresos_sin_ip",
    lambda t: V.ingresos_sin_ip(t, None, S),
    _logins(V.INGRESOS_SIN_IP, "country, city", "true"),
)
check("sesiones_record_flag", lambda t: V.sesiones_record_flag(t, None, S), _sesiones("true", flag=True))
check(
    "foros_creados",
    lambda t: V.foros_creados(t, S),
    f"""select userid, course_id, cast(sum(f) as bigint) as forums, cast(sum(b) as bigint) as blogs from (
          select userid, course_id, total as f, 0 as b from {_OPENED} o union all select userid, course_id, 0, total from {_FIRST} p) z group by 1, 2""",
)
check(
    "roles_curso_usuario",
    V.roles_curso_usuario,
    """select userid, string_agg(distinct role_name, ', ' order by role_name) as role_names,
         string_agg(distinct shortname, ', ' order by shortname) as role_shortnames from x_course_role group by userid""",
)
_SIMPLE = """(select m.course_id, m.tool, count(distinct module_id) as items, count(distinct l.userid) as users
            from x_tool m left join lg l on l.courseid = m.course_id and l.contextinstanceid = m.module_id and l.contextlevel = 70{more}
            where m.deletioninprogress = 0 group by 1, 2)"""


def _uso_simple(where: str, more: str = "") -> str:
    return _uso(where, _SIMPLE.format(more=more), V.USO_SIMPLE, zero_or_stamp, stamp("startdate"))


check("uso_herramientas_simple", lambda t: V.uso_herramientas_simple(t, None, S), _uso_simple("true"))
check(
    "uso_herramientas_simple_filtered",
    lambda t: V.uso_herramientas_simple(
        t,
        {"centro_formacion": "nation", "rol_usuario": "teacher", "fecha_desde": "2024-01-05", "fecha_hasta": "2024-01-15", "hora_consulta": "10:00",
         "fecha_inicio": "2024-01-01"},
        S,
    ),
    _uso_simple(
        f"""center_name ilike '%nation%' and startdate > 0 and {day('startdate')} >= date '2024-01-01'
            and course_id in (select course_id from x_course_role where shortname = 'teacher')""",
        f" and {day('l.timecreated')} between date '2024-01-05' and date '2024-01-15' and hour({local('l.timecreated')}) = 10",
    ),
)
check(
    "uso_herramientas_simple_one_course",
    lambda t: V.uso_herramientas_simple(t, {"codigo_ficha": "500149"}, S),
    _uso_simple("idnumber = '500149'"),
)

"""Registry of checks and the SQL relations they are built from."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lectern.settings import Settings
from lectern.sources import LmsTables
from lectern.sources.star_views import STAR_TABLES, STAR_VIEWS

# Frozen clock of the checks; the test events are from January 2024, so the
# history floor is moved to their first day.
NOW = 1705320000
FLOOR = 1704067200
S = Settings(as_of=NOW, floor_epoch=FLOOR)


@dataclass
class Check:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    over: Callable[[LmsTables], DataFrame] | None = None  # the same on LMS tables held elsewhere


CHECKS: dict[str, Check] = {}


def check(key: str, run: Callable[[LmsTables], DataFrame], sql: str | None) -> None:
    """Register a query over the LMS tables and its SQL."""
    if key in CHECKS:
        raise KeyError(f"{key} registered twice")
    CHECKS[key] = Check(
        lambda spark, sf_dir: run(LmsTables.from_star(spark, sf_dir)),
        None if sql is None else compose(sql),
        run,
    )


# -- SQL building blocks ----------------------------------------------------------

OFFSET = 18000  # seconds by which the report zone lags behind UTC


def local(e: str) -> str:
    return f"make_timestamp((({e}) - {OFFSET}) * 1000000)"


def part(unit: str, moment: str) -> str:
    """Year, month, day, hour or week of a timestamp as an integer."""
    return f"cast({unit}({moment}) as integer)"


def stamp(e: str) -> str:
    return f"strftime({local(e)}, '%Y/%m/%d %H:%M:%S')"


def day(e: str) -> str:
    return f"cast({local(e)} as date)"


def stamp_or(e: str, label: str) -> str:
    return f"case when coalesce({e}, 0) = 0 then '{label}' else {stamp(e)} end"


def zero_or_stamp(e: str, label: str) -> str:
    """NULL stays NULL, only 0 is shown as the label."""
    return f"case when {e} = 0 then '{label}' else {stamp(e)} end"


def ratio(num: str, den: str) -> str:
    """Two decimals, half up, by integer arithmetic."""
    return f"((200 * cast({num} as bigint) + ({den})) // nullif(2 * ({den}), 0)) / 100.0"


def labelled(columns: dict[str, str], body: str, tail: str = "") -> str:
    shown = ", ".join(f'{name} as "{label}"' for name, label in columns.items())
    return f"select {shown} from ({body}) shown {tail}"


def valid(at: str, e: str = "ue") -> str:
    """Enrolment active on both sides and open at an instant."""
    return (
        f"{e}.status = 0 and {e}.method_status = 0"
        f" and (coalesce({e}.timestart, 0) = 0 or {e}.timestart <= {at})"
        f" and (coalesce({e}.timeend, 0) = 0 or {e}.timeend >= {at})"
    )


LEVEL = "case when letter in ('V', 'A', 'P', 'PI') then 'Formación titulada' else 'No definido' end"
MODALITY_OR_NULL = (
    "case letter when 'V' then 'Titulada virtual' when 'A' then 'Titulada a distancia'"
    " when 'P' then 'Titulada presencial' when 'PI' then 'Titulada presencial' end"
)
MODALITY = f"coalesce({MODALITY_OR_NULL}, 'No definido')"
ORIGIN = "case when regexp_matches(shortname, '^(P_[0-9]+_|[0-9]+P_[0-9]+_)') then 'Integración' else 'Manual' end"
STATE = (
    f"case when visible = 0 then 'Oculto' when startdate > {NOW} then 'No iniciado'"
    f" when enddate > 0 and enddate < {NOW} then 'Finalizado' else 'En ejecución' end"
)
USER_STATE = "case when deleted = 1 then 'Eliminado' when suspended = 1 then 'Suspendido' else 'Activo' end"


def doc_type(x: str, kinds: str) -> str:
    return f"coalesce(upper(nullif(regexp_extract(lower({x}), '({kinds})$', 1), '')), 'No definido')"


def doc_number(x: str, kinds: str) -> str:
    return f"regexp_replace({x}, '({kinds})$', '', 'i')"


K4 = "cc|dni|ce|ppt"
K5 = "cc|dni|ce|ppt|ti"

_VIEWS = {
    name: text.replace("{k}", "cast(json_extract_string(props, '$.k') as int)").replace(
        "{epoch}", "epoch_us(ts) // 1000000"
    )
    for name, text in STAR_VIEWS.items()
}
for _name in list(_VIEWS):
    for _star in STAR_TABLES:
        _VIEWS[_name] = _VIEWS[_name].replace("{" + _star + "}", _star)
    for _other in STAR_VIEWS:
        _VIEWS[_name] = _VIEWS[_name].replace("{@" + _other + "}", _other)

RELATIONS: dict[str, str] = {
    **_VIEWS,
    "lg": "select * from mdl_logstore_standard_log",
    "x_course": rf"""
        select id as course_id, idnumber, shortname, fullname, cast(category as bigint) as category, visible, startdate, enddate,
          timecreated as course_created,
          nullif(regexp_extract(fullname, '\(([0-9]+)(_PRY_[0-9]+)?\)\s*$', 1), '') as program_code,
          trim(regexp_replace(fullname, '\s*\([0-9]+(_PRY_[0-9]+)?\)\s*$', '')) as program_name,
          nullif(regexp_extract(shortname, '_R_([0-9]+)', 1), '') as region_code,
          nullif(regexp_extract(shortname, '_C_([0-9]+)', 1), '') as center_code,
          nullif(regexp_extract(shortname, '^[0-9]*P_[0-9]+_([A-Za-z]+)_', 1), '') as letter,
          nullif(regexp_extract(shortname, '^[0-9]*P_[0-9]+_[A-Za-z]+_([0-9]+)', 1), '') as version
        from mdl_course where id <> 1""",
    "x_place": """
        select x.*, coalesce(r.nombre, 'Regional ' || region_code) as region_name,
          coalesce(c.nombre, 'Centro ' || center_code) as center_name
        from x_course x left join regionales r on r.rgn_id = try_cast(region_code as bigint)
        left join centros c on c.sed_id = try_cast(center_code as bigint)""",
    "x_home": f"""
        select *, {ORIGIN} as origin, {LEVEL} as level, {MODALITY} as modality, {STATE} as course_state,
          coalesce(program_code, 'No definido') as program_code_label,
          coalesce(version, 'No definido') as version_label,
          coalesce(nullif(program_name, ''), fullname) as program_title,
          coalesce(region_name, 'No definido') as region, coalesce(center_name, 'No definido') as center,
          coalesce(center_code, 'No definido') as center_code_label
        from x_place""",
    "x_role": "select id as roleid, shortname, coalesce(nullif(name, ''), shortname) as role_name from mdl_role",
    "x_held": """
        select a.userid, a.contextid, k.contextlevel, k.instanceid, r.shortname, r.role_name
        from mdl_role_assignments a left join mdl_context k on k.id = a.contextid join x_role r on r.roleid = a.roleid""",
    "x_course_role": """
        select userid, instanceid as course_id, shortname, role_name from x_held where contextlevel = 50""",
    "x_roles": """
        select userid, course_id, string_agg(distinct role_name, ', ' order by role_name) as role_names,
          string_agg(distinct shortname, ', ' order by shortname) as role_shortnames
        from x_course_role group by userid, course_id""",
    "x_ue": """
        select ue.id, ue.enrolid, ue.userid, e.courseid as course_id, ue.status, e.status as method_status,
          ue.timestart, ue.timeend, ue.timecreated, ue.timemodified
        from mdl_user_enrolments ue join mdl_enrol e on e.id = ue.enrolid""",
    "x_live": "select id as userid from mdl_user where deleted = 0 and coalesce(suspended, 0) = 0",
    "x_user": f"""
        select id as userid, username, deleted, suspended, lastaccess, email, lastname, firstname,
          concat(firstname, ' ', lastname) as person, {USER_STATE} as user_state,
          coalesce(nullif(idnumber, ''), username) as identity from mdl_user""",
    "x_now": f"""
        select ue.userid, ue.course_id,
          case when bool_or(u.suspended = 0 and {valid(str(NOW))}) then 'Activo' else 'Inactivo' end as valid_state
        from x_ue ue join mdl_user u on u.id = ue.userid where u.deleted = 0 group by 1, 2""",
    "x_counts": """
        select r.course_id,
          count(distinct case when shortname in ('teacher', 'editingteacher') and valid_state = 'Activo' then r.userid end) as teachers_active,
          count(distinct case when shortname = 'student' and valid_state = 'Activo' then r.userid end) as students_active,
          count(distinct case when shortname in ('teacher', 'editingteacher') and valid_state = 'Inactivo' then r.userid end) as teachers_inactive,
          count(distinct case when shortname = 'student' and valid_state = 'Inactivo' then r.userid end) as students_inactive
        from x_course_role r join x_now n on n.userid = r.userid and n.course_id = r.course_id group by 1""",
    "x_period": """
        select userid, course_id, min(coalesce(nullif(timestart, 0), timecreated)) as first_start,
          case when bool_or(coalesce(timeend, 0) = 0) then 0 else max(timeend) end as last_end,
          case when bool_or(status = 0 and method_status = 0) then 'Activo' else 'Suspendido' end as enrolment_state,
          case when bool_or(method_status = 0) then 'Activo' else 'Inactivo' end as method_state
        from x_ue group by 1, 2""",
    "x_any": """
        select userid, course_id, case when min(status) = 0 then 'Activa' else 'Suspendida' end as enrolment_state
        from x_ue group by 1, 2""",
    "x_access": f"""
        select userid, courseid as course_id, count(distinct {day('timecreated')}) as access_days, count(*) as accesses,
          min(timecreated) as first_access, max(timecreated) as last_access
        from lg where userid > 0 and courseid is not null and action = 'viewed' and target = 'course' group by 1, 2""",
    "x_access_any": f"""
        select userid, courseid as course_id, count(distinct {day('timecreated')}) as access_days, count(*) as accesses,
          min(timecreated) as first_access, max(timecreated) as last_access
        from lg where userid > 0 and courseid is not null and action = 'viewed' group by 1, 2""",
    "x_views": """
        select userid, courseid as course_id, count(*) as accesses, max(timecreated) as last_access
        from lg where userid > 0 and courseid is not null
          and (eventname = '\\core\\event\\course_viewed' or (component = 'core' and target = 'course' and action = 'viewed'))
        group by 1, 2""",
    "x_login": f"""
        select l.userid, coalesce(nullif(trim(u.country), ''), 'No definido') as country,
          coalesce(nullif(trim(u.city), ''), 'No definido') as city,
          coalesce(nullif(trim(l.ip), ''), 'No disponible') as ip, l.timecreated, {local('l.timecreated')} as login_at
        from lg l join mdl_user u on u.id = l.userid
        where l.eventname = '\\core\\event\\user_loggedin' and l.userid > 0 and u.deleted = 0""",
    "x_user_roles": """
        select userid, string_agg(distinct role_name, ', ' order by role_name) as role_names,
          string_agg(distinct shortname, ', ' order by shortname) as role_shortnames
        from x_held group by userid""",
    "x_user_roles_ctx": """
        select userid, string_agg(distinct role_name, ', ' order by role_name) as role_names,
          string_agg(distinct shortname, ', ' order by shortname) as role_shortnames
        from x_held where contextlevel in (10, 40, 50) group by userid""",
    "x_creator": """
        select objectid as created_userid, concat(u.firstname, ' ', u.lastname) as creator_name
        from (select objectid, userid, row_number() over (partition by objectid order by timecreated, id) as n
              from lg where eventname = '\\core\\event\\user_created' and objectid is not null) f
        left join mdl_user u on u.id = f.userid where n = 1""",
    "x_valid": f"""
        select {ORIGIN} as origin, {day('l.timecreated')} as day, l.userid, l.courseid as course_id, l.timecreated
        from lg l join x_live v on v.userid = l.userid join x_course c on c.course_id = l.courseid
        where l.userid > 0 and l.action = 'viewed' and l.timecreated >= {FLOOR}
          and exists (select 1 from x_ue ue where ue.course_id = l.courseid and ue.userid = l.userid and {valid('l.timecreated')})""",
    "x_module": """
        select cm.id as module_id, cm.course as course_id, m.name as module_name,
          case when m.name = 'forum' then f.type end as forum_type, cm.deletioninprogress
        from mdl_course_modules cm join mdl_modules m on m.id = cm.module left join mdl_forum f on f.id = cm.instance""",
    "x_tool": """
        select *, case when module_name = 'forum' then case forum_type when 'blog' then 'blog' when 'news' then 'anuncio' else 'foro' end
            when module_name in ('feedback', 'survey') then 'encuesta' when module_name = 'quiz' then 'evaluacion'
            when module_name = 'assign' then 'evidencia' when module_name = 'bigbluebuttonbn' then 'sesion' else module_name end as tool
        from x_module""",
    "x_activity": f"""
        select m.course_id, m.module_id, m.tool,
          case when exists (select 1 from x_ue ue where ue.course_id = l.courseid and ue.userid = l.userid and {valid('l.timecreated')})
            then v.userid end as userid
        from x_tool m left join lg l on l.courseid = m.course_id and l.contextinstanceid = m.module_id
          and l.contextlevel = 70 and l.userid > 0
        left join x_live v on v.userid = l.userid
        where coalesce(m.deletioninprogress, 0) = 0 and m.course_id <> 1""",
    "x_usage": """
        select course_id, tool, count(distinct userid) as users, count(distinct module_id) as items
        from x_activity group by 1, 2""",
    "x_post": """
        select p.id, p.userid, p.parent, p.created, f.course as course_id, f.type, f.name
        from mdl_forum_posts p join mdl_forum_discussions d on d.id = p.discussion join mdl_forum f on f.id = d.forum""",
    "t_blogs": "select userid, course_id, count(distinct id) as total from x_post where type = 'blog' and userid > 0 group by 1, 2",
    "t_forums": "select userid, course_id, count(distinct id) as total from x_post where type not in ('news', 'blog') and userid > 0 group by 1, 2",
    "t_replies": "select userid, course_id, count(distinct id) as total from x_post where type not in ('news', 'blog') and parent > 0 group by 1, 2",
    "t_announcements": "select userid, course_id, count(distinct id) as total from x_post where type = 'news' group by 1, 2",
    "t_quizzes": """
        select a.userid, q.course as course_id, count(a.id) as total from mdl_quiz_attempts a join mdl_quiz q on q.id = a.quiz
        where a.state = 'finished' and a.timefinish > 0 group by 1, 2""",
    "t_assignments": """
        select b.userid, a.course as course_id, count(distinct b.assignment) as total
        from mdl_assign_submission b join mdl_assign a on a.id = b.assignment where b.status = 'submitted' group by 1, 2""",
    "t_surveys": """
        select userid, course_id, count(*) as total from (
          select b.userid, a.course as course_id from mdl_feedback_completed b join mdl_feedback a on a.id = b.feedback
          union all select b.userid, a.course from mdl_survey_answers b join mdl_survey a on a.id = b.survey) both_kinds
        group by 1, 2""",
    "t_wikis": """
        select userid, courseid as course_id, count(*) as total from lg
        where component = 'mod_wiki' and userid > 0 and courseid is not null
          and (eventname ilike '%page_updated%' or action in ('created', 'updated')) group by 1, 2""",
    "t_scorm": """
        select userid, courseid as course_id, count(distinct coalesce(contextinstanceid, objectid, id)) as total from lg
        where component = 'mod_scorm' and userid > 0 and courseid is not null
          and (eventname ilike '%scorm%' or action in ('viewed', 'launched', 'submitted', 'completed', 'updated')) group by 1, 2""",
    "t_sessions": """
        select b.userid, a.course as course_id, count(distinct a.id) as total
        from mdl_bigbluebuttonbn_logs b join mdl_bigbluebuttonbn a on a.id = b.bigbluebuttonbnid where b.userid > 0 group by 1, 2""",
    "t_chats": """
        select b.userid, a.course as course_id, count(distinct b.id) as total
        from mdl_chat_messages b join mdl_chat a on a.id = b.chatid where b.userid > 0 group by 1, 2""",
    "x_gap": """
        select id, userid, courseid as course_id, contextlevel, contextinstanceid, timecreated,
          lead(timecreated) over (partition by userid, courseid order by timecreated, id) as next_time
        from mdl_logstore_dense where userid > 0 and courseid is not null""",
    "x_seconds": """
        select *, case when next_time is null then 0 else least(1800, greatest(0, next_time - timecreated)) end as seconds
        from x_gap""",
    "x_spent": """
        select s.userid, s.course_id, s.seconds, m.module_name,
          case when m.module_name is null then 'curso' when m.module_name = 'forum' then
              case m.forum_type when 'blog' then 'blog' when 'news' then 'anuncio' else 'foro' end
            when m.module_name in ('attendance', 'attendanceregister') then 'asistencia' else m.module_name end as tool
        from x_seconds s left join x_module m on m.module_id = s.contextinstanceid""",
    "x_pivot": """
        select userid, course_id, cast(sum(seconds) as bigint) as sec_total,
          cast(sum(case when tool = 'wiki' then seconds else 0 end) as bigint) as sec_wiki,
          cast(sum(case when tool in ('feedback', 'survey') then seconds else 0 end) as bigint) as sec_surveys,
          cast(sum(case when tool = 'foro' then seconds else 0 end) as bigint) as sec_forums,
          cast(sum(case when tool = 'quiz' then seconds else 0 end) as bigint) as sec_quizzes,
          cast(sum(case when tool = 'blog' then seconds else 0 end) as bigint) as sec_blogs,
          cast(sum(case when tool = 'assign' then seconds else 0 end) as bigint) as sec_assignments,
          cast(sum(case when tool = 'scorm' then seconds else 0 end) as bigint) as sec_scorm,
          cast(sum(case when tool = 'bigbluebuttonbn' then seconds else 0 end) as bigint) as sec_sessions,
          cast(sum(case when tool = 'chat' then seconds else 0 end) as bigint) as sec_chats,
          cast(sum(case when tool = 'asistencia' then seconds else 0 end) as bigint) as sec_attendance
        from x_spent group by 1, 2""",
    "x_stats": """
        select bigbluebuttonbnid as session_id,
          count(case when userid > 0 and (log ilike '%join%' or log ilike '%attended%') then 1 end) as joins,
          count(distinct case when userid > 0 and (log ilike '%join%' or log ilike '%attended%') then userid end) as users,
          bool_or(log ilike '%create%' or log ilike '%start%') as started
        from mdl_bigbluebuttonbn_logs group by 1""",
    "x_taped": "select distinct bigbluebuttonbnid as session_id from mdl_bigbluebuttonbn_recordings where coalesce(status, 0) >= 0",
    "x_seed": """
        select cast(4 as bigint) as seed_category, cast(code as varchar) as seed_code, program_type, education_level, prog_name, design_version,
          seed_version, current_version, modality as seed_modality, lms_id from seeds where status_seed = 'A'
        union all
        select 6, cast(code as varchar), program_type, education_level, prog_name, design_version,
          seed_version, current_version, modality, lms_id from seeds_induction where status_seed = 'A'""",
    "x_cat": f"""
        select c.id as course_id, c.idnumber, c.fullname, c.visible, c.startdate, c.enddate, c.timecreated as course_created,
          coalesce(education_level, 'No definido') as level, coalesce(seed_modality, 'No definido') as modality,
          coalesce(nullif(regexp_extract(c.shortname, '_R_([0-9]+)', 1), ''), 'No definido') as region,
          coalesce(nullif(regexp_extract(c.shortname, '_C_([0-9]+)', 1), ''), 'No definido') as center,
          coalesce(nullif(regexp_extract(c.shortname, '^P_([0-9]+)_', 1), ''), seed_code, 'No definido') as program_code,
          coalesce(cast(current_version as varchar), cast(design_version as varchar), cast(seed_version as varchar), 'No definido') as version,
          coalesce(prog_name, 'No definido') as program, {STATE} as course_state, {stamp('c.startdate')} as start_text
        from mdl_course c left join x_seed s on s.seed_category = c.category
          and s.seed_code = nullif(regexp_extract(c.shortname, '^P_([0-9]+)_', 1), '')
        where c.id <> 1""",
    "x_present": "select * from x_user where deleted = 0",
    "x_doc": """
        select d.userid,
          max(case when f.shortname in ('tipo_documento', 'tipodocumento', 'tipo_doc', 'tipoidentificacion', 'tipo_identificacion') then d.data end) as document_type,
          max(case when f.shortname in ('documento', 'numero_documento', 'identificacion', 'cedula', 'numero_identificacion') then d.data end) as document
        from mdl_user_info_data d join mdl_user_info_field f on f.id = d.fieldid
        where f.shortname in ('tipo_documento', 'tipodocumento', 'tipo_doc', 'tipoidentificacion', 'tipo_identificacion',
          'documento', 'numero_documento', 'identificacion', 'cedula', 'numero_identificacion')
        group by 1""",
    "x_login_day": f"""
        select {day('timecreated')} as fecha, userid, courseid, count(*) as ingresos,
          min(timecreated) as primer_ts, max(timecreated) as ultimo_ts,
          count(*) filter (where target = 'course') as vistas_curso,
          min(timecreated) filter (where target = 'course') as primera_vista,
          max(timecreated) filter (where target = 'course') as ultima_vista
        from lg where userid > 0 and courseid is not null and action = 'viewed' group by 1, 2, 3""",
}


def compose(sql: str) -> str:
    """Put the relations a statement uses in front of it, in dependency order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in RELATIONS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(RELATIONS[name])

    visit(sql)
    ordered: list[str] = []

    def place(name: str) -> None:
        if name in ordered:
            return
        for other in RELATIONS:
            if other != name and re.search(rf"\b{other}\b", RELATIONS[name]):
                place(other)
        ordered.append(name)

    for name in RELATIONS:
        if name in needed:
            place(name)
    if not ordered:
        return sql
    return "with " + ",\n".join(f"{name} as ({RELATIONS[name]})" for name in ordered) + "\n" + sql

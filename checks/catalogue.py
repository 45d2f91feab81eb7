"""Checks of the analyst catalogue."""

from __future__ import annotations

from checks.base import S, check, day, labelled, local, part, ratio, stamp, stamp_or, zero_or_stamp
from lectern.functions.labels import NOT_IN_LOG
from lectern.plans import catalogue as A
from lectern.plans import catalogue_columns as C

UNSET = "No definida"
ROLE = "coalesce(r.role_names, 'Sin rol asignado') as role_text"

check(
    "cat_dashboard_totals",
    A.dashboard_totals,
    labelled(
        C.DASHBOARD,
        """select
             (select count(*) from mdl_user where deleted = 0) as users,
             (select count(*) from mdl_user where deleted = 0 and suspended = 0) as users_active,
             (select count(distinct u.userid) from x_user u join x_held h using (userid) where shortname in ('teacher', 'editingteacher') and deleted = 0) as teachers,
             (select count(distinct u.userid) from x_user u join x_held h using (userid) where shortname in ('teacher', 'editingteacher') and deleted = 0 and suspended = 0) as teachers_active,
             (select count(distinct u.userid) from x_user u join x_held h using (userid) where shortname = 'student' and deleted = 0) as students,
             (select count(distinct u.userid) from x_user u join x_held h using (userid) where shortname = 'student' and deleted = 0 and suspended = 0) as students_active,
             (select count(distinct c.id) from x_held h join x_user u using (userid) join mdl_course c on c.id = h.instanceid where contextlevel = 50 and c.id <> 1) as courses,
             (select count(distinct c.id) from x_held h join x_user u using (userid) join mdl_course c on c.id = h.instanceid where contextlevel = 50 and c.id <> 1 and c.visible = 1) as courses_active,
             (select count(distinct l.userid) from lg l join mdl_user u on u.id = l.userid) as users_seen,
             (select count(*) from mdl_assign) as assigns, (select count(*) from mdl_quiz) as quizzes,
             (select count(*) from mdl_feedback) as feedbacks,
             (select count(*) from mdl_forum where type not in ('news', 'blog')) as forums,
             (select count(*) from mdl_forum where type = 'blog' or name ilike 'Blog%') as blogs,
             (select count(*) from mdl_wiki) as wikis""",
    ),
)
check(
    "cat_registro_usuarios",
    lambda t: A.registro_usuarios(t, S),
    labelled(
        C.REGISTRO,
        f"""select c.*, {stamp_or('c.enddate', UNSET)} as end_text, {ROLE}, coalesce(d.document_type, 'No definido') as document_type,
              coalesce(d.document, u.username) as document, u.person,
              case when v.first_access is null then 'Sin acceso' else {stamp('v.first_access')} end as first_access_text,
              {stamp_or('u.lastaccess', 'Sin acceso')} as last_lms_access, coalesce(v.access_days, 0) as access_days,
              coalesce(v.accesses, 0) as accesses
            from x_ue e join x_cat c using (course_id) join x_present u using (userid) left join x_doc d using (userid)
            left join x_roles r using (userid, course_id) left join x_access_any v using (userid, course_id)""",
    ),
)
check(
    "cat_ingresos",
    lambda t: A.ingresos(t, S),
    labelled(
        C.INGRESOS,
        f"""select {part('year', 'moment')} as year, {part('month', 'moment')} as month, {part('week', 'moment')} as week, strftime(moment, '%H:00:00') as hour,
              '{NOT_IN_LOG}' as system, '{NOT_IN_LOG}' as browser, '{NOT_IN_LOG}' as country, '{NOT_IN_LOG}' as city,
              ip, origin, count(*) as events, count(distinct userid) as users
            from (select l.userid, {local('l.timecreated')} as moment, coalesce(ip, 'Sin IP') as ip, coalesce(origin, 'Sin origen') as origin
                  from lg l join mdl_user u on u.id = l.userid where l.userid > 0 and u.deleted = 0 and action = 'viewed') z
            group by 1, 2, 3, 4, ip, origin""",
    ),
)
check(
    "cat_matriculas",
    lambda t: A.matriculas(t, S),
    labelled(
        C.MATRICULAS,
        f"""select c.*, {zero_or_stamp('c.enddate', UNSET)} as end_text, u.username as document, u.person, u.email, {ROLE},
              case when e.status = 0 then 'Activo' else 'Suspendido' end as enrolment_state,
              {stamp('e.timecreated')} as enrolled_text, {stamp('e.timemodified')} as changed_text
            from x_ue e join x_cat c using (course_id) join x_present u using (userid) left join x_roles r using (userid, course_id)""",
    ),
)
check(
    "cat_usuarios_ambiente",
    lambda t: A.usuarios_ambiente(t, S),
    labelled(
        C.USUARIOS,
        f"""select '{S.environment}' as environment, {part('year', local('timecreated'))} as year, {part('month', local('timecreated'))} as month,
              case auth when 'manual' then 'Manual' else 'Integración / Externo' end as origin, count(*) as users,
              count(*) filter (where deleted = 0 and suspended = 0) as active, count(*) filter (where suspended = 1) as suspended,
              count(*) filter (where deleted = 1) as deleted from mdl_user where id > 2 group by 2, 3, 4""",
    ),
)
check(
    "cat_fichas_programas",
    lambda t: A.fichas_programas(t, S),
    labelled(
        C.FICHAS,
        f"""select c.*, {stamp('c.course_created')} as created_text, {zero_or_stamp('c.enddate', UNSET)} as end_text,
              coalesce(n.students, 0) as students, coalesce(n.teachers, 0) as teachers, coalesce(n.persons, 0) as persons
            from x_cat c left join (select course_id, count(distinct userid) filter (where shortname = 'student') as students,
                count(distinct userid) filter (where shortname in ('teacher', 'editingteacher')) as teachers,
                count(distinct userid) as persons from x_course_role group by 1) n using (course_id)""",
    ),
)
check(
    "cat_trafico_diario",
    lambda t: A.trafico_diario(t, S),
    labelled(
        C.TRAFICO,
        f"""select {day('l.timecreated')} as day,
              case when regexp_matches(c.shortname, '^P_[0-9]+_.*_R_[0-9]+_C_[0-9]+') then 'Integración' else 'Manual' end as origin,
              count(*) as events, count(distinct l.userid) as users, count(distinct l.courseid) as courses
            from lg l join mdl_user u on u.id = l.userid join mdl_course c on c.id = l.courseid
            where l.userid > 0 and u.deleted = 0 and l.action = 'viewed' group by 1, 2""",
    ),
)
check(
    "cat_uso_herramientas",
    lambda t: A.uso_herramientas(t, S),
    labelled(
        C.USO,
        f"""select idnumber, fullname, level, modality, region, center, program_code, program, module_name,
              count(distinct module_id) as items, count(l.id) as uses, count(distinct l.userid) as users,
              coalesce({stamp('min(l.timecreated)')}, 'Sin uso') as first_text, coalesce({stamp('max(l.timecreated)')}, 'Sin uso') as last_text
            from x_module m join x_cat c using (course_id)
            left join lg l on l.courseid = m.course_id and l.contextinstanceid = m.module_id and l.contextlevel = 70
            group by all""",
    ),
)
_COUNTS = {
    "accesses": "select userid, courseid as course_id, count(*) as total from lg where action = 'viewed' and userid > 0 and courseid is not null group by 1, 2",
    "blogs": "select userid, course_id, count(id) as total from x_post where parent = 0 and (type = 'blog' or name ilike 'Blog%') group by 1, 2",
    "quizzes": """select userid, courseid as course_id, count(*) as total from lg
                  where objecttable = 'quiz_attempts' and target = 'attempt' and action = 'submitted' group by 1, 2""",
    "assignments": """select b.userid, a.course as course_id, count(distinct b.assignment) as total from mdl_assign_submission b
                  join mdl_assign a on a.id = b.assignment where b.status in ('submitted', 'draft') group by 1, 2""",
    "discussions": """select d.userid, f.course as course_id, count(distinct d.id) as total from mdl_forum_discussions d
                  join mdl_forum f on f.id = d.forum where f.type not in ('news', 'blog') group by 1, 2""",
    "replies": """select userid, course_id, count(distinct id) as total from x_post
                  where type not in ('news', 'blog') and parent <> 0 and upper(name) <> 'ANUNCIOS' group by 1, 2""",
    "surveys": "select * from t_surveys",
    "wikis": "select userid, courseid as course_id, count(*) as total from lg where component = 'mod_wiki' and eventname like '%page_updated%' group by 1, 2",
    "scorm": "select userid, courseid as course_id, count(*) as total from lg where component = 'mod_scorm' and userid > 0 and courseid is not null group by 1, 2",
}
check(
    "cat_participacion",
    lambda t: A.participacion(t, S),
    labelled(
        C.PARTICIPACION,
        "select c.*, coalesce(r.role_names, 'Sin rol asignado') as role_text, u.username as document, u.person, "
        + ", ".join(f"coalesce(n_{k}.total, 0) as {k}" for k in _COUNTS)
        + ", "
        + " + ".join(f"coalesce(n_{k}.total, 0)" for k in _COUNTS)
        + " as total from x_any a join x_cat c using (course_id) join x_present u using (userid)"
        + " left join x_roles r using (userid, course_id) "
        + " ".join(f"left join ({q}) n_{k} using (userid, course_id)" for k, q in _COUNTS.items()),
    ),
)
check(
    "cat_tiempo_herramienta",
    lambda t: A.tiempo_herramienta(t.with_log("mdl_logstore_dense"), S),
    labelled(
        C.TIEMPO,
        f"""select z.*, {ratio('secs', '60')} as minutes, {ratio('secs', '3600')} as hours,
              {ratio('secs * 100', 'cast(sum(secs) over (partition by course_id, userid) as bigint)')} as share
            from (select s.course_id, s.userid, idnumber, fullname, level, modality, region, center, program_code, program,
                    u.username as document, u.person, coalesce(s.module_name, 'Curso / LMS') as tool, cast(sum(seconds) as bigint) as secs
                  from x_spent s join x_cat c using (course_id) join x_present u using (userid) group by all) z""",
    ),
)
check(
    "cat_sesiones_log",
    lambda t: A.sesiones_log(t, S),
    labelled(
        C.SESIONES_LOG,
        f"""select idnumber, fullname, level, modality, region, center, program_code, program, component, eventname, objecttable, objectid,
              {stamp('min(l.timecreated)')} as first_text, {stamp('max(l.timecreated)')} as last_text, count(*) as events,
              count(distinct l.userid) as users
            from lg l join x_cat c on c.course_id = l.courseid
            where l.userid > 0 and (component ilike '%bigbluebutton%' or component ilike '%zoom%' or component ilike '%teams%'
              or component ilike '%webex%' or eventname ilike '%bigbluebutton%' or eventname ilike '%zoom%'
              or eventname ilike '%meeting%' or eventname ilike '%session%')
            group by all""",
    ),
)
check(
    "cat_sesiones_bbb",
    lambda t: A.sesiones_bbb(t, S),
    labelled(
        C.SESIONES_BBB,
        f"""select c.idnumber, c.fullname, b.name as session_name, {stamp('b.openingtime')} as opening_text,
              {zero_or_stamp('b.closingtime', UNSET)} as closing_text, count(distinct l.userid) as users, count(l.id) as events
            from mdl_bigbluebuttonbn b join mdl_course c on c.id = b.course left join mdl_bigbluebuttonbn_logs l on l.bigbluebuttonbnid = b.id
            where c.id <> 1 group by c.idnumber, c.fullname, b.name, b.openingtime, b.closingtime""",
    ),
)

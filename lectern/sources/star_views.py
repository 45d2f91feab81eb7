"""LMS-shaped views over the star-schema test tables.

One SQL text per LMS table, valid in Spark and in DuckDB. ``{name}`` stands for
a star table, ``{@name}`` for another view here. Every view reads its source
tables whole, so the LMS tables grow with the scale factor. A third of the
event log falls on course 2, which gives every test a hot course.
"""

from __future__ import annotations

# user and course of an order: course 2 for a third of the orders
_ORDER_USER = "cast(floor(o_custkey / 10) as bigint)"
_ORDER_COURSE = f"case when o_orderkey % 3 = 1 then 2 else {_ORDER_USER} * 3 + o_orderkey % 20 end"
# user near the course that owns an activity of that order or line
_NEAR_USER_O = "cast(greatest(floor(o_orderkey / 96) - o_custkey % 6, 0) as bigint)"
_NEAR_USER_L = (
    "cast(case when l_returnflag = 'R' then l_suppkey"
    " else greatest(floor(l_orderkey / 96) - l_linenumber % 6, 0) end as bigint)"
)
_LINE_ID = (
    "(l_orderkey * 10 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) as bigint)"
)
_PART_COURSE = "cast(floor(p_partkey / 4) as bigint)"

STAR_VIEWS: dict[str, str] = {
    "mdl_user": """
        select c_custkey as id,
          cast(10000000 + c_custkey as string) || case c_custkey % 7 when 0 then 'cc' when 1 then 'CC'
            when 2 then 'dni' when 3 then 'ce' when 4 then 'ppt' when 5 then 'ti' else '' end as username,
          case when c_custkey % 5 = 0 then '' else cast(20000000 + c_custkey as string) || 'cc' end as idnumber,
          case when c_custkey % 19 = 6 then null else c_mktsegment end as firstname, c_name as lastname,
          'u' || cast(c_custkey as string) || '@example.org' as email,
          case when c_custkey % 3 = 0 then 'manual' else 'oauth2' end as auth,
          case when c_custkey % 11 = 9 then '' else n_name end as country,
          case when c_custkey % 13 = 4 then ' ' else c_mktsegment end as city,
          case when c_custkey % 29 = 7 then 1 else 0 end as deleted,
          case when c_custkey % 17 = 3 then 1 when c_custkey % 31 = 9 then null else 0 end as suspended,
          case when c_custkey % 23 = 5 then 0 when c_custkey % 41 = 8 then null
            else 1690000000 + c_custkey * 3600 end as timecreated,
          case when c_custkey % 10 = 6 then 0 else 1706000000 + c_custkey * 60 end as lastaccess
        from {customer} join {nation} on n_nationkey = c_nationkey""",
    "mdl_course": """
        select p_partkey as id, cast(500000 + p_partkey as string) as idnumber,
          case p_partkey % 6
            when 0 then 'P_' || cast(100000 + p_partkey as string) || '_V_1_R_' || cast(p_partkey % 5 as string) || '_C_' || cast(p_partkey % 25 as string)
            when 1 then '2P_' || cast(100000 + p_partkey as string) || '_A_2_R_' || cast(p_partkey % 5 as string) || '_C_' || cast(p_partkey % 25 as string)
            when 2 then 'P_' || cast(100000 + p_partkey as string) || '_PI_3_R_99_C_999'
            when 3 then 'P_' || cast(100000 + p_partkey as string) || '_P_1_R_' || cast(p_partkey % 5 as string)
            when 4 then 'P_' || cast(100000 + p_partkey as string) || '_X_1'
            else 'MANUAL_' || p_name end as shortname,
          case p_partkey % 4
            when 0 then upper(p_name) || ' (' || cast(100000 + p_partkey as string) || ')'
            when 1 then upper(p_name) || ' (' || cast(100000 + p_partkey as string) || '_PRY_7) '
            when 2 then p_name else '(' || cast(100000 + p_partkey as string) || ')' end as fullname,
          case when p_partkey % 2 = 0 then 4 else 6 end as category,
          case when p_partkey % 9 = 8 then 0 else 1 end as visible,
          case when p_partkey % 7 = 6 then 0 when p_partkey % 53 = 9 then null
            else 1704000000 + (p_partkey % 40) * 86400 + (p_partkey % 24) * 3600 end as startdate,
          case when p_partkey % 3 = 0 then 0 when p_partkey % 59 = 10 then null
            else 1704500000 + (p_partkey % 30) * 86400 end as enddate,
          1700000000 + (p_partkey % 90) * 86400 + (p_partkey % 24) * 3600 as timecreated
        from {part}""",
    "mdl_course_categories": """
        select r_regionkey as id, r_name as name, 10 - r_regionkey as sortorder from {region}""",
    "mdl_enrol": """
        select p_partkey * 2 as id, p_partkey as courseid, case when p_partkey % 9 = 4 then 1 else 0 end as status from {part}
        union all
        select p_partkey * 2 + 1, p_partkey, case when p_partkey % 5 = 3 then 1 else 0 end from {part}""",
    "mdl_user_enrolments": f"""
        select o_orderkey as id, cast(({_ORDER_COURSE}) * 2 + o_orderkey % 2 as bigint) as enrolid,
          {_ORDER_USER} as userid, case when o_orderstatus = 'P' then 1 else 0 end as status,
          case o_orderkey % 4 when 0 then 0 when 1 then null when 2 then 1704200000 + (o_orderkey % 7) * 86400 else 1705000000 end as timestart,
          case o_orderkey % 5 when 0 then 0 when 1 then 1705800000 when 2 then 1706200000 - (o_orderkey % 11) * 86400
            when 3 then null else 1704700000 end as timeend,
          1704100000 + o_orderkey % 100000 as timecreated, 1704300000 + o_orderkey % 100000 as timemodified
        from {{orders}}""",
    "mdl_role": """
        select n_nationkey as id,
          case n_nationkey when 1 then 'manager' when 2 then 'coursecreator' when 3 then 'editingteacher'
            when 4 then 'teacher' when 5 then 'student' when 6 then 'guest' else 'role' || cast(n_nationkey as string) end as shortname,
          case n_nationkey when 2 then 'Creador' when 3 then 'Instructor editor' when 5 then 'Aprendiz'
            when 1 then '' when 4 then '' when 6 then '' else n_name end as name,
          n_nationkey as sortorder
        from {nation}""",
    "mdl_context": """
        select 1 as id, 10 as contextlevel, 0 as instanceid from {region} where r_regionkey = 0
        union all select -1 - r_regionkey, 40, r_regionkey from {region}
        union all select p_partkey * 2 + 2, 50, p_partkey from {part}
        union all select p_partkey * 2 + 3, 70, p_partkey from {part}""",
    "mdl_role_assignments": f"""
        select o_orderkey as id, {_ORDER_USER} as userid,
          cast(case when o_orderkey % 31 = 0 then 1 when o_orderkey % 29 = 0 then -1 - o_orderkey % 5
            when o_orderkey % 23 = 0 then ({_ORDER_COURSE}) * 2 + 3
            when o_orderkey % 3 = 1 then 2 * 2 + 2 else ({_ORDER_USER} * 3 + o_orderkey % 22) * 2 + 2 end as bigint) as contextid,
          case o_orderpriority when '1-URGENT' then 4 when '2-HIGH' then 3 when '3-MEDIUM' then 1 else 5 end as roleid
        from {{orders}}""",
    "mdl_modules": """
        select n_nationkey as id, case n_nationkey when 1 then 'wiki' when 2 then 'feedback' when 3 then 'survey'
          when 4 then 'quiz' when 5 then 'assign' when 6 then 'forum' when 7 then 'scorm' when 8 then 'bigbluebuttonbn'
          when 9 then 'chat' when 10 then 'page' when 11 then 'attendance' else 'mod' || cast(n_nationkey as string) end as name
        from {nation}""",
    "mdl_course_modules": """
        select o_orderkey as id, cast(floor(o_orderkey / 30) as bigint) as course, 1 + o_orderkey % 11 as module,
          cast(floor(o_orderkey / 8) as bigint) as instance,
          case when o_orderkey % 37 = 36 then 1 when o_orderkey % 41 = 40 then null else 0 end as deletioninprogress
        from {orders}""",
    "mdl_logstore_standard_log": """
        select event_id as id, user_id as userid,
          cast(case when event_type = 'click' and k % 8 = 1 then null else course end as bigint) as courseid,
          case when k % 4 = 0 then 50 else 70 end as contextlevel,
          cast(case when k % 4 = 0 then course else course * 30 + k % 30 end as bigint) as contextinstanceid,
          case when event_type = 'view' and k % 5 = 3 then chr(92) || 'mod_page' || chr(92) || 'event' || chr(92) || 'course_module_viewed'
            when event_type = 'view' then chr(92) || 'core' || chr(92) || 'event' || chr(92) || 'course_viewed'
            when event_type = 'click' then chr(92) || 'core' || chr(92) || 'event' || chr(92) || 'user_loggedin'
            when event_type = 'signup' then chr(92) || 'core' || chr(92) || 'event' || chr(92) || 'user_created'
            when event_type = 'purchase' and k % 3 = 2 then chr(92) || 'mod_bigbluebuttonbn' || chr(92) || 'event' || chr(92) || 'meeting_joined'
            when event_type = 'purchase' and k % 3 = 1 then chr(92) || 'mod_forum' || chr(92) || 'event' || chr(92) || 'post_created'
            when event_type = 'purchase' then chr(92) || 'mod_wiki' || chr(92) || 'event' || chr(92) || 'page_updated'
            when k % 2 = 1 then chr(92) || 'mod_quiz' || chr(92) || 'event' || chr(92) || 'attempt_submitted'
            else chr(92) || 'mod_scorm' || chr(92) || 'event' || chr(92) || 'sco_launched' end as eventname,
          case when event_type = 'view' and k % 5 = 3 then 'mod_page' when event_type in ('view', 'click', 'signup') then 'core'
            when event_type = 'purchase' and k % 3 = 2 then 'mod_bigbluebuttonbn' when event_type = 'purchase' and k % 3 = 1 then 'mod_forum'
            when event_type = 'purchase' then 'mod_wiki' when k % 2 = 1 then 'mod_quiz' else 'mod_scorm' end as component,
          case when event_type = 'view' then 'viewed' when event_type = 'click' then 'loggedin' when event_type = 'signup' then 'created'
            when event_type = 'purchase' and k % 3 = 2 then 'joined' when event_type = 'purchase' and k % 3 = 1 then 'created'
            when event_type = 'purchase' then 'updated' when k % 2 = 1 then 'submitted' else 'launched' end as action,
          case when event_type = 'view' and k % 5 = 3 then 'course_module' when event_type = 'view' then 'course'
            when event_type in ('click', 'signup') then 'user' when event_type = 'purchase' and k % 3 = 2 then 'meeting'
            when event_type = 'purchase' and k % 3 = 1 then 'post' when event_type = 'purchase' then 'page'
            when k % 2 = 1 then 'attempt' else 'sco' end as target,
          case when event_type = 'signup' then 'user' when event_type = 'purchase' and k % 3 = 2 then 'bigbluebuttonbn'
            when event_type = 'purchase' and k % 3 = 1 then 'forum_posts' when event_type = 'error' and k % 2 = 1 then 'quiz_attempts'
            else null end as objecttable,
          cast(case when event_type = 'signup' then user_id * 7 + k when event_type in ('purchase', 'error') then k else null end as bigint) as objectid,
          case when k % 8 = 0 then ' ' when k % 8 = 3 then null else '10.0.0.' || cast(k as string) end as ip,
          'web' as origin, t as timecreated
        from (select event_id, user_id, event_type, {k} as k, {epoch} as t,
                case when {k} % 3 = 0 then 2 else user_id * 3 + {k} % 25 end as course from {events}) e""",
    "mdl_logstore_dense": """
        select id, userid, courseid, contextlevel, contextinstanceid, eventname, component, action, target,
          objecttable, objectid, ip, origin,
          cast(1704067200 + floor((timecreated - 1704067200) / 300) as bigint) as timecreated
        from {@mdl_logstore_standard_log} l""",
    "mdl_forum": f"""
        select p_partkey as id, {_PART_COURSE} as course,
          case when p_partkey % 5 = 0 then 'Blog ' || p_name when p_partkey % 5 = 1 then 'Anuncios' else p_name end as name,
          case p_partkey % 3 when 0 then 'general' when 1 then 'blog' else 'news' end as type
        from {{part}}""",
    "mdl_forum_discussions": f"""
        select o_orderkey as id, cast(floor(o_orderkey / 8) as bigint) as forum, {_NEAR_USER_O} as userid,
          1704100000 + o_orderkey % 2000000 as timemodified from {{orders}}""",
    "mdl_forum_posts": f"""
        select {_LINE_ID} as id, l_orderkey as discussion, {_NEAR_USER_L} as userid,
          case when l_linenumber = 1 then 0 else l_orderkey * 10 + 1 end as parent,
          1704100000 + (l_orderkey * 10 + l_linenumber * 7000) % 2000000 as created from {{lineitem}}""",
    "mdl_quiz": f"select p_partkey as id, {_PART_COURSE} as course from {{part}}",
    "mdl_quiz_attempts": f"""
        select {_LINE_ID} as id, cast(floor(l_orderkey / 8) as bigint) as quiz, {_NEAR_USER_L} as userid,
          case when l_returnflag = 'A' then 'inprogress' else 'finished' end as state,
          case when l_linenumber = 3 then 0 else 1704100000 + (l_orderkey * 10 + l_linenumber * 7000) % 2000000 end as timefinish
        from {{lineitem}}""",
    "mdl_assign": f"select p_partkey as id, {_PART_COURSE} as course from {{part}}",
    "mdl_assign_submission": f"""
        select o_orderkey as id, cast(floor(o_orderkey / 8) as bigint) as assignment, {_NEAR_USER_O} as userid,
          case o_orderstatus when 'P' then 'draft' else 'submitted' end as status,
          case when o_orderkey % 6 = 0 then 0 else 1704100000 + o_orderkey * 97 % 2000000 end as timemodified,
          1704100000 + o_orderkey * 31 % 1000000 as timecreated
        from {{orders}}""",
    "mdl_feedback": f"select p_partkey as id, {_PART_COURSE} as course from {{part}}",
    "mdl_feedback_completed": f"""
        select o_orderkey as id, cast(floor(o_orderkey / 8) as bigint) as feedback, {_NEAR_USER_O} as userid,
          1704100000 + o_orderkey * 89 % 2000000 as timemodified from {{orders}}""",
    "mdl_survey": f"select p_partkey as id, {_PART_COURSE} as course from {{part}}",
    "mdl_survey_answers": f"""
        select o_orderkey as id, cast(floor(o_orderkey / 9) as bigint) as survey, {_NEAR_USER_O} as userid,
          1704100000 + o_orderkey * 83 % 2000000 as time from {{orders}}""",
    "mdl_chat": f"select p_partkey as id, {_PART_COURSE} as course from {{part}}",
    "mdl_chat_messages": f"""
        select o_orderkey as id, cast(floor(o_orderkey / 8) as bigint) as chatid, {_NEAR_USER_O} as userid,
          1704100000 + o_orderkey * 79 % 2000000 as timestamp from {{orders}}""",
    "mdl_wiki": f"select p_partkey as id, {_PART_COURSE} as course from {{part}}",
    "mdl_bigbluebuttonbn": f"""
        select p_partkey as id, {_PART_COURSE} as course, p_name || ' ' || cast(p_partkey % 100 as string) as name,
          'meet-' || cast(p_partkey as string) as meetingid,
          case when p_partkey % 8 = 7 then 0 else 1704100000 + (p_partkey % 60) * 43200 end as openingtime,
          case when p_partkey % 5 = 4 then 0 else 1704107200 + (p_partkey % 60) * 43200 end as closingtime,
          case when p_partkey % 4 = 1 then 1 else 0 end as record from {{part}}""",
    "mdl_bigbluebuttonbn_logs": f"""
        select o_orderkey as id, cast(floor(o_orderkey / 7) as bigint) as bigbluebuttonbnid, {_NEAR_USER_O} as userid,
          case o_orderpriority when '1-URGENT' then 'Create' when '2-HIGH' then 'Join' when '3-MEDIUM' then 'joined'
            when '5-LOW' then 'Logout' else 'Attended' end as log,
          1704100000 + o_orderkey * 73 % 2000000 as timecreated from {{orders}}""",
    "mdl_bigbluebuttonbn_recordings": """
        select p_partkey as id, cast(floor(p_partkey / 2) as bigint) * 3 as bigbluebuttonbnid,
          case p_partkey % 4 when 0 then null when 1 then 2 when 2 then -1 else 0 end as status from {part}""",
    "mdl_user_info_field": """
        select p_partkey as id, case p_partkey when 1 then 'tipo_documento' when 2 then 'documento'
            when 3 then 'celular' else 'campo' || cast(p_partkey as string) end as shortname,
          p_name as name, p_type as datatype from {part}""",
    "mdl_user_info_data": """
        select c_custkey * 3 as id, c_custkey as userid, 1 as fieldid, case when c_custkey % 4 = 3 then null else 'CC' end as data from {customer}
        union all select c_custkey * 3 + 1, c_custkey, 2, case when c_custkey % 4 = 2 then null else cast(30000000 + c_custkey as string) end from {customer}
        union all select c_custkey * 3 + 2, c_custkey, 3, '300' || cast(c_custkey as string) from {customer}""",
    "seeds": """
        select 100000 + p_partkey as code, 'TITULADA' as program_type, 'TECNICO' as education_level, upper(p_name) as prog_name,
          p_size as design_version, 1 as seed_version, cast(null as integer) as current_version, 'V' || cast(p_size as string) as modality,
          case when p_partkey % 5 = 4 then 'I' else 'A' end as status_seed, p_partkey as lms_id from {part}""",
    "seeds_induction": """
        select 100000 + p_partkey as code, 'INDUCCION' as program_type, 'INDUCCION' as education_level, upper(p_name) as prog_name,
          p_size as design_version, 1 as seed_version, p_size as current_version, 'V' || cast(p_size as string) as modality,
          case when p_partkey % 7 = 6 then 'I' else 'A' end as status_seed, p_partkey as lms_id from {part}""",
    "regionales": "select r_regionkey as rgn_id, r_name as nombre from {region}",
    "centros": "select n_nationkey as sed_id, n_name as nombre from {nation}",
    "solicitudes": """
        select o_orderkey as id, 'registro_usuarios' as reporte_codigo,
          'u' || cast(cast(floor(o_custkey / 50) as bigint) as string) || '@example.org' as usuario_email,
          case o_orderstatus when 'P' then 'ERROR' else 'FINALIZADO' end as estado,
          case when o_orderkey % 2 = 0 then 'csv' else 'xlsx' end as formato,
          case when o_orderstatus = 'P' then null else '/out/' || cast(o_orderkey as string) || '.csv' end as archivo_ruta,
          o_orderkey * 3 as filas_procesadas, 1704000000 + o_orderkey * 7 % 50000 as fecha_solicitud,
          1704000600 + o_orderkey * 7 % 5000 as fecha_fin,
          case when o_orderkey % 2 = 0 then 'regional' else '' end as filtros
        from {orders}""",
}

STAR_TABLES = ("region", "nation", "customer", "part", "orders", "lineitem", "events")

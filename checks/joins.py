"""Checks of joins, aggregations, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.base import NOW, S, check, day, ratio, valid
from lectern.functions import labels as L
from lectern.functions.times import local_date, ratio_2dp
from lectern.operators import access, courses, enrolments, export, online, people, timeontask, tools
from lectern.operators.skew import join_hot
from lectern.plans import reports as R
from lectern.sources import LmsTables

P = tools.Period()
PAIR = ["userid", "course_id"]


def _dense(t: LmsTables) -> LmsTables:
    return t.with_log("mdl_logstore_dense")


def _modules_with_events(t: LmsTables):
    """Every module with its events, if any, and the user of each, if live.

    Users are looked up before modules without events come in, whose missing users would all meet in one
    task. Hot modules lie on the side that an outer join can't split: an inner join plus a union.
    """
    keys = ["course_id", "module_id"]
    cm = tools.modules(t).select(*keys, "module_name", "forum_type")
    events = tools.module_events(t, P)
    live = people.live_users(t).withColumn("live", F.lit(1))
    looked_up = join_hot(events, live, "left", ["userid"]).select(*keys, "timecreated", F.when(F.col("live") == 1, F.col("userid")).alias("live_user"))
    silent = cm.join(events.select(*keys).distinct(), keys, "left_anti")
    rows = join_hot(looked_up, cm, keys=keys).unionByName(silent, allowMissingColumns=True)
    return rows.select(*keys, "module_name", "forum_type", "timecreated", "live_user")


# -- joins ------------------------------------------------------------------------

check(
    "jn_inner",
    lambda t: enrolments.rows(t)
    .join(courses.parsed(t).select("course_id", "idnumber"), "course_id")
    .join(t.user.select(F.col("id").alias("userid"), "username"), "userid")
    .select("id", "idnumber", "username"),
    """select ue.id, c.idnumber, u.username from mdl_user_enrolments ue join mdl_enrol e on e.id = ue.enrolid
       join mdl_course c on c.id = e.courseid and c.id <> 1 join mdl_user u on u.id = ue.userid""",
)
check(
    "jn_inner_const",
    people.course_assignments,
    """select a.userid, k.instanceid as course_id, r.shortname, coalesce(nullif(r.name, ''), r.shortname) as role_name
       from mdl_role_assignments a join mdl_context k on k.id = a.contextid and k.contextlevel = 50 join mdl_role r on r.id = a.roleid""",
)
check(
    "jn_left_multi",
    lambda t: enrolments.any_active(t)
    .select(*PAIR)
    .join(tools.participation(t, P), PAIR, "left")
    .na.fill(0, list(tools.MEASURES)),
    "select b.userid, b.course_id, "
    + ", ".join(
        f"coalesce({m}.total, 0) as {m}"
        for m in ("wikis", "surveys", "forums", "replies", "quizzes", "blogs", "assignments", "scorm", "sessions", "chats", "announcements")
    )
    + ", coalesce(v.accesses, 0) as accesses, v.last_access from x_any b left join x_views v using (userid, course_id) "
    + " ".join(
        f"left join t_{m} {m} using (userid, course_id)"
        for m in ("wikis", "surveys", "forums", "replies", "quizzes", "blogs", "assignments", "scorm", "sessions", "chats", "announcements")
    ),
)
check(
    "jn_left_dim",
    lambda t: courses.with_places(courses.parsed(t), t).select("course_id", "region_code", "region_name", "center_name"),
    "select course_id, region_code, region_name, center_name from x_place",
)
check(
    "jn_left_conditional",
    _modules_with_events,
    """select m.course_id, m.module_id, m.module_name, m.forum_type, l.timecreated, u.id as live_user
       from x_module m left join lg l on l.courseid = m.course_id and l.contextinstanceid = m.module_id and l.contextlevel = 70 and l.userid > 0
       left join mdl_user u on u.id = l.userid and u.deleted = 0 and coalesce(u.suspended, 0) = 0
       where coalesce(m.deletioninprogress, 0) = 0""",
)
check(
    "jn_params",
    lambda t: courses.parsed(t).select("course_id", (F.lit(S.now()) - F.col("course_created")).alias("age")),
    f"select course_id, p.now - course_created as age from x_course cross join (select {NOW} as now) p",
)
check(
    "jn_semi_range",
    lambda t: access.valid_access(t, S).select("userid", "course_id", "timecreated"),
    f"""select l.userid, l.courseid as course_id, l.timecreated from lg l
        where l.userid > 0 and l.action = 'viewed' and l.courseid <> 1
          and l.userid in (select id from mdl_user where deleted = 0 and coalesce(suspended, 0) = 0)
          and l.courseid in (select id from mdl_course)
          and exists (select 1 from x_ue ue where ue.userid = l.userid and ue.course_id = l.courseid and {valid('l.timecreated')})""",
)
check(
    "jn_existence",
    lambda t: tools.modules(t)
    .join(
        tools.valid_module_users(t, P).select("course_id", "module_id").distinct().withColumn("used", F.lit(True)),
        ["course_id", "module_id"],
        "left",
    )
    .select("module_id", F.coalesce("used", F.lit(False)).alias("used")),
    f"""select m.id as module_id, exists (select 1 from lg l join x_live v on v.userid = l.userid join x_ue ue
            on ue.userid = l.userid and ue.course_id = l.courseid
          where l.contextlevel = 70 and l.userid > 0 and l.courseid = m.course and l.contextinstanceid = m.id and {valid('l.timecreated')}) as used
        from mdl_course_modules m where coalesce(m.deletioninprogress, 0) = 0""",
)
check(
    "jn_semi_role",
    lambda t: courses.parsed(t).select("course_id").join(R.courses_with_role(t, "teacher"), "course_id", "left_semi"),
    "select course_id from x_course c where exists (select 1 from x_course_role r where r.course_id = c.course_id and shortname = 'teacher')",
)
check(
    "jn_semi_student_state",
    lambda t: courses.parsed(t).select("course_id").join(
        R.courses_with_student_state(t, "Inactivo", S), "course_id", "left_semi"
    ),
    """select course_id from x_course c where exists (select 1 from x_course_role r join x_now n using (userid, course_id)
         where r.course_id = c.course_id and r.shortname = 'student' and n.valid_state = 'Inactivo')""",
)
check(
    "jn_semi_session",
    lambda t: t.bigbluebuttonbn.select(F.col("id").alias("session_id"), "name").join(
        online.with_role(t, "teach", False), "session_id", "left_semi"
    ),
    """select b.id as session_id, b.name from mdl_bigbluebuttonbn b where exists (
         select 1 from mdl_bigbluebuttonbn_logs l join x_course_role r on r.userid = l.userid and r.course_id = b.course
         where l.bigbluebuttonbnid = b.id and (r.shortname ilike '%teach%' or r.role_name ilike '%teach%'))""",
)
check(
    "jn_recording_flag",
    lambda t: t.bigbluebuttonbn.select(F.col("id").alias("session_id"))
    .join(online.recorded(t).withColumn("taped", F.lit(True)), "session_id", "left")
    .select("session_id", L.yes_no(F.coalesce("taped", F.lit(False))).alias("recorded")),
    """select b.id as session_id, case when exists (select 1 from mdl_bigbluebuttonbn_recordings r
         where r.bigbluebuttonbnid = b.id and coalesce(r.status, 0) >= 0) then 'Sí' else 'No' end as recorded from mdl_bigbluebuttonbn b""",
)
check(
    "jn_left_seed",
    lambda t: courses.seeded(t).select("course_id", "short_code", "prog_name", F.col("seed_version_label").alias("version")),
    """select c.course_id, nullif(regexp_extract(m.shortname, '^P_([0-9]+)_', 1), '') as short_code,
         case c.program when 'No definido' then null else c.program end as prog_name, c.version
       from x_cat c join mdl_course m on m.id = c.course_id""",
)

# -- aggregations -----------------------------------------------------------------

check(
    "agg_basic",
    lambda t: t.log.groupBy("courseid").agg(
        F.count("*").alias("n"),
        F.count("objectid").alias("objects"),
        F.min("timecreated").alias("first"),
        F.max("timecreated").alias("last"),
        F.sum("userid").alias("total"),
    ),
    """select courseid, count(*) as n, count(objectid) as objects, min(timecreated) as first, max(timecreated) as last,
         cast(sum(userid) as bigint) as total from lg group by courseid""",
)
check(
    "agg_count_distinct",
    lambda t: t.log.groupBy("courseid").agg(F.count_distinct("userid").alias("users")),
    "select courseid, count(distinct userid) as users from lg group by courseid",
)
check(
    "agg_distinct_filter",
    lambda t: tools.usage_pivot(tools.tool_usage(t, S, P)),
    "select course_id, "
    + ", ".join(
        f"count(distinct userid) filter (where tool = '{x}') as {x}_users, count(distinct module_id) filter (where tool = '{x}') as {x}_items"
        for x in tools.USAGE_TOOLS
    )
    + " from x_activity group by course_id",
)
check(
    "agg_count_filter",
    lambda t: t.user.groupBy("country").agg(
        F.count_if((F.col("deleted") == 0) & (F.col("suspended") == 0)).alias("active"),
        F.count_if(F.col("deleted") == 1).alias("deleted"),
    ),
    """select country, count(*) filter (where deleted = 0 and suspended = 0) as active,
         count(*) filter (where deleted = 1) as deleted from mdl_user group by country""",
)
check(
    "agg_distinct_case",
    lambda t: online.stats(t).select("session_id", "users"),
    """select bigbluebuttonbnid as session_id, count(distinct case when userid > 0 and log in ('Join', 'joined', 'Attended') then userid end) as users
       from mdl_bigbluebuttonbn_logs group by 1""",
)
check(
    "agg_bool_or",
    lambda t: t.user_enrolments.groupBy("enrolid").agg(F.bool_or(F.col("status") == 0).alias("any_active")),
    "select enrolid, min(status) = 0 as any_active from mdl_user_enrolments group by enrolid",
)
check(
    "agg_string_distinct",
    lambda t: people.roles_by_user_course(t).select("userid", "course_id", "role_names"),
    "select userid, course_id, string_agg(distinct role_name, ', ' order by role_name) as role_names from x_course_role group by 1, 2",
)
check(
    "agg_sum_pivot",
    lambda t: timeontask.pivoted(timeontask.per_tool(t, timeontask.per_instance(_dense(t), S))).select(
        *PAIR, "sec_total", "sec_wiki", "sec_quizzes", "sec_forums"
    ),
    "select userid, course_id, sec_total, sec_wiki, sec_quizzes, sec_forums from x_pivot",
)
check(
    "agg_group_expr",
    lambda t: t.log.groupBy(
        local_date(F.col("timecreated"), S.report_tz).alias("day"), F.coalesce("ip", F.lit("Sin IP")).alias("address")
    ).agg(F.count("*").alias("n")),
    f"select {day('timecreated')} as day, coalesce(ip, 'Sin IP') as address, count(*) as n from lg group by 1, 2",
)
check(
    "agg_share_pct",
    lambda t: timeontask.pivoted(timeontask.per_tool(t, timeontask.per_instance(_dense(t), S))).select(
        *PAIR,
        ratio_2dp(F.col("sec_quizzes") * 100, F.col("sec_total")).alias("quiz_pct"),
        ratio_2dp(F.col("sec_total"), F.lit(60)).alias("minutes"),
    ),
    f"select userid, course_id, {ratio('sec_quizzes * 100', 'sec_total')} as quiz_pct, {ratio('sec_total', '60')} as minutes from x_pivot",
)

# -- windows ----------------------------------------------------------------------

check(
    "win_lead_gap",
    lambda t: timeontask.next_event(timeontask.events(t, S), PAIR, S.gap_slice_seconds).select(
        "id", (F.col("next_time") - F.col("timecreated")).alias("gap")
    ),
    """select id, lead(timecreated) over (partition by userid, courseid order by timecreated, id) - timecreated as gap
       from lg where userid > 0 and courseid is not null""",
)
check(
    "win_sum_of_sum",
    lambda t: timeontask.per_tool(t, timeontask.per_instance(_dense(t), S)).withColumn(
        "pair_total", F.sum("seconds").over(Window.partitionBy(*PAIR))
    ),
    """select userid, course_id, tool, cast(sum(seconds) as bigint) as seconds,
         cast(sum(sum(seconds)) over (partition by userid, course_id) as bigint) as pair_total from x_spent group by 1, 2, 3""",
)
check(
    "win_first_per_key",
    lambda t: t.log.filter(F.col("objectid").isNotNull())
    .groupBy("objectid")
    .agg(F.min_by("userid", F.struct("timecreated", "id")).alias("userid")),
    "select distinct on (objectid) objectid, userid from lg where objectid is not null order by objectid, timecreated, id",
)

# -- sorts and sets ---------------------------------------------------------------

# The position in the sorted output is part of the rows, so the order is checked.
check(
    "sort_mixed",
    lambda t: export.with_row_index(
        t.course.select("id", "fullname", "startdate"), [R.down("startdate"), R.up("fullname"), F.col("id").asc()]
    ),
    """select id, fullname, startdate, row_number() over (order by startdate desc nulls first, fullname asc nulls last, id) - 1 as idx
       from mdl_course""",
)
check(
    "sort_hidden",
    lambda t: export.with_row_index(
        t.user.select("id", "username", "firstname", "lastname"), [R.up("firstname"), R.up("lastname"), F.col("id").asc()]
    ).select("id", "username", "idx"),
    """select id, username, row_number() over (order by firstname nulls last, lastname nulls last, id) - 1 as idx from mdl_user""",
)
check(
    "set_union_all",
    lambda t: tools.survey_parts(t, P),
    """select b.userid, a.course as course_id, count(distinct b.id) as total from mdl_feedback_completed b join mdl_feedback a on a.id = b.feedback group by 1, 2
       union all select b.userid, a.course, count(distinct b.id) from mdl_survey_answers b join mdl_survey a on a.id = b.survey group by 1, 2""",
)
check(
    "set_distinct",
    lambda t: t.log.select("userid", "courseid").distinct(),
    "select distinct userid, courseid from lg",
)

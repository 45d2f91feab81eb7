"""Checks of the daily summary tables and the jobs that maintain them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from checks.base import CHECKS, Check, S, check, compose, day, local, part
from lectern.functions.labels import NOT_IN_LOG
from lectern.operators import timeontask
from lectern.session import scratch_path
from lectern.sources import LmsTables
from lectern.sources.catalog import star_view
from lectern.streaming import eventtime, rollups, streams

ACTIVITY = f"""
    select {day('l.timecreated')} as fecha, l.userid, l.courseid,
      case when m.tool = 'foro' and l.objecttable = 'forum_posts' and l.action = 'created' then 'comentario' else m.tool end as herramienta
    from lg l join x_tool m on m.module_id = l.contextinstanceid
    where l.userid > 0 and l.courseid is not null and l.contextlevel = 70"""
TOOL_LIST = ", ".join(f"'{x}'" for x in rollups.ACTIVITY_TOOLS)

check("rollup_login_day", lambda t: rollups.login_day(t, S), "select * from x_login_day")
check(
    "rollup_tool_activity_day",
    lambda t: rollups.tool_activity_day(t, S),
    f"select fecha, userid, courseid, herramienta, count(*) as cantidad from ({ACTIVITY}) z where herramienta in ({TOOL_LIST}) group by 1, 2, 3, 4",
)


def _time_sql(log: str) -> str:
    return f"""
    select fecha, userid, courseid, coalesce(tool, 'curso') as herramienta, cast(sum(secs) as bigint) as segundos from (
      select fecha, userid, courseid, contextinstanceid, case when nxt is null then 0 when nxt - timecreated > 1800 then 1800 else nxt - timecreated end as secs from (
        select *, {day('timecreated')} as fecha, lead(timecreated) over (partition by userid, courseid, {day('timecreated')} order by timecreated, id) as nxt
        from {log} where userid > 0 and courseid is not null) a) b
    left join x_tool m on m.module_id = b.contextinstanceid group by 1, 2, 3, 4"""


check(
    "rollup_estimated_time_day",
    lambda t: rollups.estimated_time_day(t.with_log("mdl_logstore_dense"), S),
    _time_sql("mdl_logstore_dense"),
)
check(
    "rollup_traffic_hour",
    lambda t: rollups.traffic_hour(t, S),
    f"""select {day('timecreated')} as fecha, {part('hour', local('timecreated'))} as hora, courseid, count(distinct userid) as usuarios_unicos
        from lg where userid > 0 and courseid is not null and action = 'viewed' group by 1, 2, 3""",
)
check(
    "rollup_login_dim_day",
    lambda t: rollups.login_dim_day(t, S),
    f"""select {day('l.timecreated')} as fecha, courseid, '{NOT_IN_LOG}' as so, '{NOT_IN_LOG}' as navegador,
          coalesce(nullif(trim(country), ''), 'No definido') as pais, coalesce(nullif(trim(city), ''), 'No definido') as ciudad,
          count(distinct l.userid) as ingresos_unicos
        from lg l join mdl_user u on u.id = l.userid and u.deleted = 0
        where l.userid > 0 and courseid is not null and action = 'viewed' group by all""",
)

# -- the job ----------------------------------------------------------------------

START, MID, END = date(2023, 12, 31), date(2024, 1, 20), date(2024, 1, 31)


def _store(t: LmsTables, name: str) -> rollups.Store:
    return rollups.Store(t.spark, scratch_path(t.spark, name))


def _two_runs(t: LmsTables) -> rollups.Store:
    store = _store(t, "daily")
    for today in (MID, END):
        rollups.run_daily(t, S, store, "login_day", today, START)
    return store


_COLUMNS = [
    "fecha", "userid", "courseid", "ingresos", "primer_ts", "ultimo_ts", "vistas_curso", "primera_vista", "ultima_vista",
]
check(
    "rollup_idempotent",
    lambda t: _two_runs(t).read("login_day").select(*_COLUMNS),
    "select * from x_login_day where fecha <= date '2024-01-30'",
)
check(
    "rollup_watermark",
    lambda t: _two_runs(t).watermarks(),
    f"select 'login_day' as job_name, max({day('timecreated')}) as last_full_date from lg",
)


def _late(t: LmsTables) -> "rollups.DataFrame":
    """Events with an objectid over 90 arrive a day late, over 95 ten days late.

    Three runs see only what has arrived by then. Ids grow with arrival, as in a
    database; the last run must have repaired every day.
    """
    store = _store(t, "late")
    delay = F.when(F.col("objectid") > 95, 10).when(F.col("objectid") > 90, 1).otherwise(0)
    arrival = F.date_add(rollups.day_of(S), delay)
    log = t.log.withColumn("id", F.unix_date(arrival).cast("bigint") * 10**10 + F.col("id"))
    for today in (date(2024, 1, 11), date(2024, 1, 21), date(2024, 1, 31)):
        seen = LmsTables(
            t.spark,
            lambda name, today=today: log.filter(arrival < F.lit(today))
            if name == "mdl_logstore_standard_log"
            else t.table(name),
        )
        rollups.run_daily(seen, S, store, "tool_activity_day", today, START)
    return store.read("tool_activity_day").select("fecha", "userid", "courseid", "herramienta", "cantidad")


_ARRIVED = f"""
    (select * from lg where {day('timecreated')} <= date '2024-01-30' and {day('timecreated')}
       + cast(case when objectid > 95 then 10 when objectid > 90 then 1 else 0 end as integer) < date '2024-01-31')"""
check(
    "rollup_late_data",
    _late,
    f"""select fecha, userid, courseid, herramienta, count(*) as cantidad from ({ACTIVITY.replace('from lg l', f'from {_ARRIVED} l')}) z
        where herramienta in ({TOOL_LIST}) group by 1, 2, 3, 4""",
)


def _emptied(t: LmsTables):
    """The log loses its rows of some days between two runs over them."""
    store = _store(t, "emptied")
    rollups.run_daily(t, S, store, "traffic_hour", date(2024, 1, 11), START)
    gone = rollups.day_of(S).isin(date(2024, 1, 9), date(2024, 1, 10))
    fewer = LmsTables(t.spark, lambda name: t.log.filter(~gone) if name == "mdl_logstore_standard_log" else t.table(name))
    rollups.run_daily(fewer, S, store, "traffic_hour", date(2024, 1, 11), START)
    return store.read("traffic_hour").select("fecha", "hora", "courseid", "usuarios_unicos")


check(
    "rollup_emptied_day",
    _emptied,
    f"""select {day('timecreated')} as fecha, {part('hour', local('timecreated'))} as hora, courseid, count(distinct userid) as usuarios_unicos
        from lg where userid > 0 and courseid is not null and action = 'viewed' and {day('timecreated')} <= date '2024-01-08' group by 1, 2, 3""",
)


def _backfilled_mark(t: LmsTables):
    """Loading old days again leaves the watermark where the daily runs put it."""
    store = _two_runs(t)
    rollups.backfill(t, S, store, "login_day", date(2024, 1, 1), date(2024, 1, 5))
    return store.watermarks()


check(
    "rollup_backfill_watermark",
    _backfilled_mark,
    f"select 'login_day' as job_name, date '2024-01-30' as last_full_date from lg limit 1",
)


def _backfill(t: LmsTables):
    store = _store(t, "backfill")
    rollups.backfill(t, S, store, "traffic_hour", START, date(2024, 1, 30))
    return store.read("traffic_hour").select("fecha", "hora", "courseid", "usuarios_unicos")


check(
    "rollup_backfill",
    _backfill,
    f"""select {day('timecreated')} as fecha, {part('hour', local('timecreated'))} as hora, courseid, count(distinct userid) as usuarios_unicos
        from lg where userid > 0 and courseid is not null and action = 'viewed' group by 1, 2, 3""",
)


def _filled(t: LmsTables) -> rollups.Store:
    store = _store(t, "reports")
    rollups.backfill(t, S, store, "login_day", START, date(2024, 1, 30))
    return store


check("report_from_rollup", lambda t: rollups.access_from_rollup(_filled(t)), "select * from x_access_any")


check(
    "registro_from_rollup",
    lambda t: rollups.course_access_from_rollup(_filled(t)),
    "select * from x_access",
)


def _snapshot(t: LmsTables):
    store = _store(t, "snapshot")
    for _ in range(2):
        rollups.run_daily(t, S, store, "user_course_day", date(2024, 1, 16), START)
    return store.read("user_course_day").select("fecha", "userid", "courseid", "estado_matricula", "rol_shortnames")


check(
    "rollup_user_course_day",
    _snapshot,
    """select date '2024-01-15' as fecha, userid, course_id as courseid, enrolment_state as estado_matricula, role_shortnames as rol_shortnames
       from x_any left join x_roles using (userid, course_id)""",
)


def _filled_with(t: LmsTables, job: str) -> rollups.Store:
    store = _store(t, job)
    rollups.backfill(t, S, store, job, START, date(2024, 1, 30))
    return store


check(
    "tools_from_rollup",
    lambda t: rollups.tools_from_rollup(_filled_with(t, "tool_activity_day"), "2024-01-08", "2024-01-20"),
    f"""select userid, courseid as course_id, herramienta, count(*) as cantidad from ({ACTIVITY}) z
        where herramienta in ({TOOL_LIST}) and fecha between date '2024-01-08' and date '2024-01-20' group by 1, 2, 3""",
)
check(
    "time_from_rollup",
    lambda t: rollups.time_from_rollup(_filled_with(t, "estimated_time_day"), "2024-01-08", "2024-01-20"),
    f"""select userid, courseid as course_id, herramienta, cast(sum(segundos) as bigint) as segundos from ({_time_sql('lg')}) z
        where fecha between date '2024-01-08' and date '2024-01-20' group by 1, 2, 3""",
)


def _time_tables(t: LmsTables):
    store = _store(t, "time")
    for job in ("instance_time_day", "day_edge"):
        rollups.backfill(t, S, store, job, START, date(2024, 1, 30))
    return timeontask.per_tool(t, rollups.instances_from_rollup(store, "2024-01-08", "2024-01-20"))


check(
    "tiempo_from_rollup",
    _time_tables,
    f"""select userid, course_id, tool, cast(sum(secs) as bigint) as seconds from (
          select g.userid, g.courseid as course_id,
            case when nxt is null then 0 else least(1800, greatest(0, nxt - timecreated)) end as secs,
            case when m.module_name is null then 'curso' when m.module_name = 'forum' then
                case m.forum_type when 'blog' then 'blog' when 'news' then 'anuncio' else 'foro' end
              when m.module_name in ('attendance', 'attendanceregister') then 'asistencia' else m.module_name end as tool
          from (select *, lead(timecreated) over (partition by userid, courseid order by timecreated, id) as nxt
                from lg where userid > 0 and courseid is not null
                  and {day('timecreated')} between date '2024-01-08' and date '2024-01-20') g
          left join x_module m on m.module_id = g.contextinstanceid) z group by 1, 2, 3""",
)
check(
    "unique_users_from_rollup",
    lambda t: rollups.unique_users_from_rollup(_filled(t), "2024-01-08", "2024-01-14"),
    f"""select courseid, count(distinct userid) as usuarios_unicos from lg where userid > 0 and courseid is not null and action = 'viewed'
          and {day('timecreated')} between date '2024-01-08' and date '2024-01-14' group by 1""",
)



def _bitmaps(t: LmsTables) -> rollups.Store:
    store = _store(t, "bitmaps")
    rollups.backfill(t, S, store, "users_bitmap_day", START, date(2024, 1, 30))
    return store


check(
    "unique_users_from_bitmaps",
    lambda t: rollups.unique_users_from_bitmaps(_bitmaps(t), "2024-01-08", "2024-01-14"),
    f"""select courseid, count(distinct userid) as usuarios_unicos from lg where userid > 0 and courseid is not null and action = 'viewed'
          and {day('timecreated')} between date '2024-01-08' and date '2024-01-14' group by 1""",
)
check(
    "rollup_users_bitmap_day",
    lambda t: _bitmaps(t).read("users_bitmap_day").groupBy("fecha", "courseid").agg(
        F.sum(F.bitmap_count("usuarios")).alias("usuarios_unicos")
    ),
    f"""select {day('timecreated')} as fecha, courseid, count(distinct userid) as usuarios_unicos from lg
        where userid > 0 and courseid is not null and action = 'viewed' and {day('timecreated')} <= date '2024-01-30' group by 1, 2""",
)

# -- streams ----------------------------------------------------------------------


def _stream_log(spark, sf_dir: str):
    """The event log as a file stream over the events table."""

    def star(name: str):
        schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
        return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)

    return star_view(spark, "mdl_logstore_standard_log", star)


def stream_check(key: str, run, sql: str) -> None:
    CHECKS[key] = Check(run, compose(sql))


def _streamed(job: str, *columns: str):
    def run(spark, sf_dir: str):
        t = LmsTables.from_star(spark, sf_dir)
        return streams.run_replace_job(_stream_log(spark, sf_dir), t, S, job).select(*columns)

    return run


stream_check("stream_login_day", _streamed("login_day", *_COLUMNS), "select * from x_login_day")
stream_check(
    "stream_traffic_hour",
    _streamed("traffic_hour", "fecha", "hora", "courseid", "usuarios_unicos"),
    f"""select {day('timecreated')} as fecha, {part('hour', local('timecreated'))} as hora, courseid, count(distinct userid) as usuarios_unicos
        from lg where userid > 0 and courseid is not null and action = 'viewed' group by 1, 2, 3""",
)
stream_check(
    "stream_estimated_time_day",
    _streamed("estimated_time_day", "fecha", "userid", "courseid", "herramienta", "segundos"),
    _time_sql("lg"),
)

# -- streams in event time ----------------------------------------------------------

_DELAY_DAYS = 2


def _arrivals(t: LmsTables, sf_dir: str):
    """The log in three arrivals: by day, but rows with an objectid over 90 a day and over 95 ten days later."""
    spark = t.spark
    folder = scratch_path(spark, "arriving")
    delay = F.when(F.col("objectid") > 95, 10).when(F.col("objectid") > 90, 1).otherwise(0)
    arrival = F.least(F.greatest(F.call_function("div", F.dayofyear(F.date_add(rollups.day_of(S), delay)), F.lit(10)), F.lit(0)), F.lit(2))
    for n in range(3):
        t.log.filter(arrival == n).write.mode("append").parquet(folder)
        yield spark.readStream.schema(t.log.schema).parquet(folder)


def _event_time(job: str, shown, *columns: str):
    def run(spark, sf_dir: str):
        t = LmsTables.from_star(spark, sf_dir)
        arrivals = eventtime.Arrivals(spark, scratch_path(spark, "arrivals"), _DELAY_DAYS * 86400)
        store = _store(t, "eventtime")
        for log in _arrivals(t, sf_dir):
            eventtime.run(log, S, arrivals, store, (job,))
        eventtime.repair(t, S, arrivals, store, job)
        return shown(t, eventtime.closed(arrivals, store, job)).select(*columns)

    return run


def _passed(sql: str) -> str:
    newest = f"select max({local('timecreated')}) from lg where userid > 0 and courseid is not null"
    return f"select * from ({sql}) z where fecha < cast(({newest}) - interval {_DELAY_DAYS} day as date)"


stream_check("event_time_login_day", _event_time("login_day", lambda t, df: df, *_COLUMNS), _passed("select * from x_login_day"))
stream_check(
    "event_time_traffic_hour",
    _event_time("traffic_hour", lambda t, df: df, "fecha", "hora", "courseid", "usuarios_unicos"),
    _passed(
        f"""select {day('timecreated')} as fecha, {part('hour', local('timecreated'))} as hora, courseid, count(distinct userid) as usuarios_unicos
            from lg where userid > 0 and courseid is not null and action = 'viewed' group by 1, 2, 3"""
    ),
)
stream_check(
    "event_time_estimated_time_day",
    _event_time("instance_time_day", eventtime.time_per_tool, "fecha", "userid", "courseid", "herramienta", "segundos"),
    _passed(_time_sql("lg")),
)

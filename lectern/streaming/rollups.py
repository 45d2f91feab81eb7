"""Summary tables per local day, and the job that keeps them up to date.

Each builder reads a range of whole days of the log and gives one row per grain.
The job replaces whole days, so running it twice changes nothing, and a run takes
effect as a whole (``versions``). Rows that are new in the log but belong to older
days are added to these as partial sums where a table's measures allow that
(``MERGED``); of other tables, the days they belong to are built again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import labels as L
from lectern.functions.times import local_date, local_ts
from lectern.operators import access, enrolments, people, timeontask, tools
from lectern.settings import Settings
from lectern.sources import LmsTables
from lectern.streaming.versions import Change, DayTable, Manifest

PAIR = ["userid", "course_id"]
GRAIN = ["fecha", "userid", "courseid"]

# Tools counted in the activity table, and the days that a run always redoes.
ACTIVITY_TOOLS = (
    "wiki", "encuesta", "evaluacion", "evidencia", "blog", "anuncio", "foro", "comentario", "scorm", "sesion",
    "chat",
)
REDONE_DAYS = 2


def day_of(s: Settings) -> Column:
    return local_date(F.col("timecreated"), s.report_tz)


def _events(t: LmsTables, s: Settings, since: str | None, until: str | None) -> DataFrame:
    return (
        access.log_between(t, since, until, s.report_tz)
        .filter((F.col("userid") > 0) & F.col("courseid").isNotNull())
        .withColumn("fecha", day_of(s))
    )


def views(t: LmsTables, s: Settings, since: str | None, until: str | None) -> DataFrame:
    return _events(t, s, since, until).filter(F.col("action") == "viewed")


def login_day(t: LmsTables, s: Settings, since: str | None = None, until: str | None = None) -> DataFrame:
    """Views per day, user and course, with first and last time; views of the course itself apart."""
    own = F.when(F.col("target") == "course", F.col("timecreated"))
    return views(t, s, since, until).groupBy(*GRAIN).agg(
        F.count("*").alias("ingresos"),
        F.min("timecreated").alias("primer_ts"),
        F.max("timecreated").alias("ultimo_ts"),
        F.count(own).alias("vistas_curso"),
        F.min(own).alias("primera_vista"),
        F.max(own).alias("ultima_vista"),
    )


def tool_activity_day(t: LmsTables, s: Settings, since: str | None = None, until: str | None = None) -> DataFrame:
    """Module events per day, user, course and tool.

    Events are counted per module before the module lookup.
    """
    comment = (F.col("objecttable") == "forum_posts") & (F.col("action") == "created")
    counted = (
        _events(t, s, since, until)
        .filter(F.col("contextlevel") == people.MODULE)
        .groupBy(*GRAIN, F.col("contextinstanceid").alias("module_id"))
        .agg(F.count("*").alias("n"), F.count_if(comment).alias("posts"))
    )
    placed = counted.join(tools.modules(t, "all").select("module_id", "tool"), "module_id")
    wrote = (F.col("tool") == "foro") & (F.col("posts") > 0)
    # A forum module gives up to two rows: posts written, and the other events.
    entries = F.array(
        F.struct(
            F.col("tool").alias("herramienta"),
            F.when(F.col("tool") == "foro", F.col("n") - F.col("posts")).otherwise(F.col("n")).alias("n"),
        ),
        F.struct(F.lit("comentario").alias("herramienta"), F.when(wrote, F.col("posts")).otherwise(0).alias("n")),
    )
    return (
        placed.select(*GRAIN, F.inline(entries))
        .filter((F.col("n") > 0) & F.col("herramienta").isin(*ACTIVITY_TOOLS))
        .groupBy(*GRAIN, "herramienta")
        .agg(F.sum("n").alias("cantidad"))
    )


def estimated_time_day(
    t: LmsTables, s: Settings, since: str | None = None, until: str | None = None
) -> DataFrame:
    """Capped gap seconds per day, user, course and tool.

    A day is computed from its own events only: its last event counts 0.
    """
    rows = _events(t, s, since, until).select(
        "id", "fecha", "userid", F.col("courseid").alias("course_id"), "contextinstanceid", "timecreated"
    )
    spent = timeontask.instance_seconds(rows, ["fecha", *PAIR], s.gap_slice_seconds, F.col("contextinstanceid"))
    return (
        spent.join(tools.modules(t, "all").select("module_id", "tool"), "module_id", "left")
        .groupBy(
            "fecha", "userid", F.col("course_id").alias("courseid"), F.coalesce("tool", F.lit("curso")).alias("herramienta")
        )
        .agg(F.sum("seconds").alias("segundos"))
    )


def _course_events(t: LmsTables, s: Settings, since: str | None, until: str | None) -> DataFrame:
    return _events(t, s, since, until).select(
        "id", "fecha", "userid", F.col("courseid").alias("course_id"), "contextinstanceid", "timecreated"
    )


def instance_time_day(t: LmsTables, s: Settings, since: str | None = None, until: str | None = None) -> DataFrame:
    """Capped gap seconds per day, user, course and context instance, within the day."""
    rows = _course_events(t, s, since, until)
    spent = timeontask.instance_seconds(rows, ["fecha", *PAIR], s.gap_slice_seconds, F.col("contextinstanceid"))
    return spent.select(
        "fecha", "userid", F.col("course_id").alias("courseid"), F.col("module_id").alias("modulo"), F.col("seconds").alias("segundos")
    )


def day_edge(t: LmsTables, s: Settings, since: str | None = None, until: str | None = None) -> DataFrame:
    """First and last event per day, user and course, and where the last one was: what the gap across
    midnight is made of."""
    return (
        _events(t, s, since, until)
        .groupBy(*GRAIN)
        .agg(
            F.min("timecreated").alias("primer_ts"),
            F.max("timecreated").alias("ultimo_ts"),
            F.max_by("contextinstanceid", F.struct("timecreated", "id")).alias("ultimo_modulo"),
        )
    )


def user_course_day(t: LmsTables, s: Settings, day: str) -> DataFrame:
    """Snapshot of enrolment state and roles, taken for one day."""
    return (
        enrolments.any_active(t)
        .join(people.roles_by_user_course(t), PAIR, "left")
        .select(
            F.lit(day).cast("date").alias("fecha"),
            "userid",
            F.col("course_id").alias("courseid"),
            F.col("enrolment_state").alias("estado_matricula"),
            F.col("role_shortnames").alias("rol_shortnames"),
        )
    )


def traffic_hour(t: LmsTables, s: Settings, since: str | None = None, until: str | None = None) -> DataFrame:
    """Unique users per day, hour and course."""
    return (
        views(t, s, since, until)
        .select("fecha", F.hour(local_ts(F.col("timecreated"), s.report_tz)).alias("hora"), "courseid", "userid")
        .distinct()
        .groupBy("fecha", "hora", "courseid")
        .agg(F.count("*").alias("usuarios_unicos"))
    )


def login_dim_day(t: LmsTables, s: Settings, since: str | None = None, until: str | None = None) -> DataFrame:
    """Unique users per day, course, country and city (system and browser unknown)."""
    return (
        views(t, s, since, until)
        .select("fecha", "courseid", "userid")
        .distinct()
        .join(access.profiles(t), "userid")
        .groupBy(
            "fecha",
            "courseid",
            F.lit(L.NOT_IN_LOG).alias("so"),
            F.lit(L.NOT_IN_LOG).alias("navegador"),
            F.col("country").alias("pais"),
            F.col("city").alias("ciudad"),
        )
        .agg(F.count("*").alias("ingresos_unicos"))
    )


def users_bitmap_day(t: LmsTables, s: Settings, since: str | None = None, until: str | None = None) -> DataFrame:
    """Users seen per day and course as bitmaps: one row for each range of user ids (``bucket``)."""
    return (
        views(t, s, since, until)
        .groupBy("fecha", "courseid", F.bitmap_bucket_number("userid").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("userid")).alias("usuarios"))
    )


BUILDERS: dict[str, Callable[..., DataFrame]] = {
    "login_day": login_day,
    "tool_activity_day": tool_activity_day,
    "estimated_time_day": estimated_time_day,
    "instance_time_day": instance_time_day,
    "day_edge": day_edge,
    "traffic_hour": traffic_hour,
    "login_dim_day": login_dim_day,
    "users_bitmap_day": users_bitmap_day,
}

# Tables whose rows are partial sums: rows of one key are put together by these aggregates, so that
# late rows need no second look at the rest of their day.
MERGED: dict[str, dict[str, Callable]] = {
    "login_day": {
        "ingresos": F.sum, "primer_ts": F.min, "ultimo_ts": F.max, "vistas_curso": F.sum, "primera_vista": F.min, "ultima_vista": F.max,
    },
    "tool_activity_day": {"cantidad": F.sum},
    "users_bitmap_day": {"usuarios": F.bitmap_or_agg},
}
# Versions of a day from which on they are put together in the table.
MOST_VERSIONS = 4


# Snapshots say how things stand on the day of the run; they can't be rebuilt later.
SNAPSHOTS: dict[str, Callable[[LmsTables, Settings, str], DataFrame]] = {"user_course_day": user_course_day}

SCHEMAS: dict[str, str] = {
    "login_day": "userid bigint, courseid bigint, ingresos bigint, primer_ts bigint, ultimo_ts bigint,"
    " vistas_curso bigint, primera_vista bigint, ultima_vista bigint, fecha date",
    "tool_activity_day": "userid bigint, courseid bigint, herramienta string, cantidad bigint, fecha date",
    "estimated_time_day": "userid bigint, courseid bigint, herramienta string, segundos bigint, fecha date",
    "instance_time_day": "userid bigint, courseid bigint, modulo bigint, segundos bigint, fecha date",
    "day_edge": "userid bigint, courseid bigint, primer_ts bigint, ultimo_ts bigint, ultimo_modulo bigint, fecha date",
    "traffic_hour": "hora int, courseid bigint, usuarios_unicos bigint, fecha date",
    "login_dim_day": "courseid bigint, so string, navegador string, pais string, ciudad string,"
    " ingresos_unicos bigint, fecha date",
    "users_bitmap_day": "courseid bigint, bucket bigint, usuarios binary, fecha date",
    "user_course_day": "userid bigint, courseid bigint, estado_matricula string, rol_shortnames string, fecha date",
}


class Store:
    """Folder of summary tables, one ``DayTable`` per name."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, name: str) -> DayTable:
        return DayTable(self.spark, self.path(name), SCHEMAS.get(name, "fecha date"))

    def read(self, name: str, since: str | None = None, until: str | None = None) -> DataFrame:
        """A table, or the days of a range; other days are not read. Days in several versions are put together."""
        whole, parts = self.table(name).parts(since, until)
        return whole.unionByName(merged(name, parts))

    def replace_days(self, name: str, rows: DataFrame, since: date, until: date) -> None:
        """Make the days of an inclusive range hold exactly ``rows``; other days stay."""
        change = self.table(name).change()
        change.replace(rows, since, until)
        change.commit()

    def last_run(self, job: str) -> tuple[date | None, int | None]:
        """Last day consolidated and last log id seen."""
        m = self.table(job).manifest()
        return (None if m.last_full_date is None else date.fromisoformat(m.last_full_date)), m.last_id

    def last_full_date(self, job: str) -> date | None:
        return self.last_run(job)[0]

    def watermarks(self) -> DataFrame:
        """Last full day of each job that has run: part of the job's manifest, so it can't part from the days."""
        found = [(job, self.last_full_date(job)) for job in SCHEMAS]
        return self.spark.createDataFrame([x for x in found if x[1]], "job_name string, last_full_date date")


def merged(name: str, rows: DataFrame) -> DataFrame:
    """Rows of one key as one row; tables without partial sums hold a key once."""
    if name not in MERGED:
        return rows
    measures = MERGED[name]
    keys = [c for c in rows.columns if c not in measures]
    return rows.groupBy(*keys).agg(*[how(c).alias(c) for c, how in measures.items()]).select(*rows.columns)


# -- the job --------------------------------------------------------------------


def upto_id(t: LmsTables, newest: int | None) -> LmsTables:
    """The log as it was when ``newest`` was its last id; rows that arrive during a run are for the next one."""
    if newest is None:
        return t
    return _with_log(t, t.log.filter(F.col("id") <= newest))


def _with_log(t: LmsTables, log: DataFrame) -> LmsTables:
    return t.derived(lambda name: log if name == t.log_name else t.table(name))


def run_range(t: LmsTables, s: Settings, change: Change, job: str, since: date, until: date, newest: int | None) -> None:
    rows = BUILDERS[job](upto_id(t, newest), s, since.isoformat(), until.isoformat())
    change.replace(rows, since, until, newest)


def newest_id(t: LmsTables) -> int | None:
    return t.log.agg(F.max("id")).first()[0]


def late_rows(t: LmsTables, s: Settings, after: int, upto: int, since: date, before: date) -> DataFrame:
    """Log rows with ids in (after, upto] of days in [since, before)."""
    rows = t.log.filter((F.col("id") > after) & (F.col("id") <= upto))
    return rows.filter((day_of(s) >= F.lit(since)) & (day_of(s) < F.lit(before)))


def late_days(rows: DataFrame, s: Settings) -> list[date]:
    """Days that rows belong to; only these reach the driver."""
    return [r.fecha for r in rows.select(day_of(s).alias("fecha")).distinct().orderBy("fecha").collect()]


def add_late(t: LmsTables, s: Settings, change: Change, job: str, rows: DataFrame, known: Manifest, upto: int) -> None:
    """Add the partial sums of late log rows to their days. A day that was built since the last run has counted
    some of them already: the ids up to which days count are part of the manifest."""
    counted = [(date.fromisoformat(k), d.upto) for k, d in known.days.items() if d.upto is not None]
    days = t.spark.createDataFrame(counted, "fecha date, upto bigint")  # one row a day
    fresh = (
        rows.withColumn("fecha", day_of(s))
        .join(F.broadcast(days), "fecha", "left")
        .filter(F.col("id") > F.coalesce("upto", F.lit(-1)))
        .drop("fecha", "upto")
    )
    change.add(BUILDERS[job](_with_log(t, fresh), s), upto)


def compact(store: Store, job: str, most: int = MOST_VERSIONS) -> list[str]:
    """Put days in more than ``most`` versions together into one."""
    table = store.table(job)
    many = {k: d for k, d in table.manifest().days.items() if len(d.versions) > most}
    if many:
        change = table.change()
        change.swap(merged(job, table.rows(many)), many)
        change.commit()
    return sorted(many)


def run_daily(t: LmsTables, s: Settings, store: Store, job: str, today: date, history_start: date) -> None:
    """Consolidate up to yesterday, with every older day that late rows belong to.

    Ids of the log grow as rows arrive, so rows above the last id seen are new,
    whatever their day. Days, late rows and the note of the run take effect together: a crash
    leaves the tables as they were, and the next run does the same again.
    """
    until = today - timedelta(days=1)
    change = store.table(job).change()
    if job in SNAPSHOTS:
        change.replace(SNAPSHOTS[job](t, s, until.isoformat()), until, until)
        change.note(until, None)
        change.commit()
        return
    known = store.table(job).manifest()
    done, seen = store.last_run(job)
    newest = newest_id(t)
    since = history_start if done is None else done - timedelta(days=REDONE_DAYS)
    if newest is not None and done is not None:
        rows = late_rows(t, s, -1 if seen is None else seen, newest, history_start, since)
        if job in MERGED:
            add_late(t, s, change, job, rows, known, newest)
        else:
            for first, last in day_ranges(late_days(rows, s)):
                run_range(t, s, change, job, first, last, newest)
    if until >= since:
        run_range(t, s, change, job, since, until, newest)
    if done is None or until >= done:
        change.note(until, newest)
    change.commit()
    if job in MERGED:
        compact(store, job)
    store.table(job).expire()


def months(since: date, until: date) -> Iterator[tuple[date, date]]:
    """Calendar months that cover an inclusive range, cut to it."""
    start = since
    while start <= until:
        after = date(start.year + start.month // 12, start.month % 12 + 1, 1)
        yield start, min(after - timedelta(days=1), until)
        start = after


def day_ranges(days: list[date]) -> Iterator[tuple[date, date]]:
    """Runs of consecutive days in a sorted list of days."""
    start = 0
    for i, day in enumerate(days):
        if i + 1 == len(days) or days[i + 1] - day > timedelta(days=1):
            yield days[start], day
            start = i + 1


def backfill(t: LmsTables, s: Settings, store: Store, job: str, since: date, until: date) -> None:
    """Load history month by month; each month is one distributed job.

    The watermark rises only where the range joins on to what is loaded, so it never
    passes over days that weren't; it never falls. Rows that arrive meanwhile are
    late rows to the next daily run.
    """
    table = store.table(job)
    done, seen = store.last_run(job)
    newest = newest_id(t)
    for first, last in months(since, until):
        change = table.change()
        run_range(t, s, change, job, first, last, newest)
        change.commit()
    if done is None or (since <= done + timedelta(days=1) and until > done):
        # Late rows of other days are still to come, so ids count as seen only where nothing is older.
        change = table.change()
        change.note(until, newest if done is None else seen)
        change.commit()


# -- reports from the summary tables ----------------------------------------------


def _days(store: Store, name: str, since: str | None, until: str | None) -> DataFrame:
    """Rows of a summary table in a range of days; other day folders are not read."""
    return store.read(name, since, until).withColumnRenamed("courseid", "course_id")


def access_from_rollup(store: Store, since: str | None = None, until: str | None = None) -> DataFrame:
    """Access counts per user and course out of the daily table."""
    return _days(store, "login_day", since, until).groupBy(*PAIR).agg(
        F.count("fecha").alias("access_days"),
        F.sum("ingresos").alias("accesses"),
        F.min("primer_ts").alias("first_access"),
        F.max("ultimo_ts").alias("last_access"),
    )


def course_access_from_rollup(store: Store, since: str | None = None, until: str | None = None) -> DataFrame:
    """Views of the course itself per user and course: what the enrolled-user report counts."""
    return (
        _days(store, "login_day", since, until)
        .filter(F.col("vistas_curso") > 0)
        .groupBy(*PAIR)
        .agg(
            F.count("fecha").alias("access_days"),
            F.sum("vistas_curso").alias("accesses"),
            F.min("primera_vista").alias("first_access"),
            F.max("ultima_vista").alias("last_access"),
        )
    )


def tools_from_rollup(store: Store, since: str | None = None, until: str | None = None) -> DataFrame:
    """Module events per user, course and tool."""
    return (
        _days(store, "tool_activity_day", since, until)
        .groupBy(*PAIR, "herramienta")
        .agg(F.sum("cantidad").alias("cantidad"))
    )


def time_from_rollup(store: Store, since: str | None = None, until: str | None = None) -> DataFrame:
    """Estimated seconds per user, course and tool; each day counts on its own."""
    return (
        _days(store, "estimated_time_day", since, until)
        .groupBy(*PAIR, "herramienta")
        .agg(F.sum("segundos").alias("segundos"))
    )


def instances_from_rollup(store: Store, since: str | None = None, until: str | None = None) -> DataFrame:
    """Seconds per user, course and context instance, the gaps between days included.

    The same relation that the time report counts from the log: within a day from the time table,
    and from a day's last event to the first one of the pair's next active day from the edges. The
    window holds one row per active day of a pair.
    """
    inside = _days(store, "instance_time_day", since, until).select(
        *PAIR, F.col("modulo").alias("module_id"), F.col("segundos").alias("seconds")
    )
    following = F.lead("primer_ts").over(Window.partitionBy(*PAIR).orderBy("fecha"))
    across = (
        _days(store, "day_edge", since, until)
        .withColumn("seconds", timeontask.capped_gap(F.col("ultimo_ts"), following).cast("bigint"))
        .select(*PAIR, F.col("ultimo_modulo").alias("module_id"), "seconds")
    )
    return inside.unionByName(across).groupBy(*PAIR, "module_id").agg(F.sum("seconds").alias("seconds"))


def unique_users_from_rollup(store: Store, since: str | None = None, until: str | None = None) -> DataFrame:
    """Unique users per course over a range, recounted from the user-grain table."""
    return (
        _days(store, "login_day", since, until)
        .groupBy(F.col("course_id").alias("courseid"))
        .agg(F.count_distinct("userid").alias("usuarios_unicos"))
    )


def unique_users_from_bitmaps(store: Store, since: str | None = None, until: str | None = None) -> DataFrame:
    """Unique users per course over a range, by uniting the bitmaps of its days: one row for each day, course
    and range of ids is read, not one for each user."""
    united = (
        store.read("users_bitmap_day", since, until)
        .groupBy("courseid", "bucket")
        .agg(F.bitmap_or_agg("usuarios").alias("usuarios"))
    )
    return united.groupBy("courseid").agg(F.sum(F.bitmap_count("usuarios")).alias("usuarios_unicos"))

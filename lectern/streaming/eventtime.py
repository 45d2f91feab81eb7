"""Event-time streams: windows, timers and duplicates bounded by a watermark.

A stream is taken in two steps, each with a checkpoint of its own.

``receive`` splits the arrivals. A row is late if it lies behind the watermark: more than ``delay``
before the newest event of all earlier micro-batches. Late rows go to a side table, the others to a
staging table; both, and the newest event, are kept by batch number, so a batch that runs again
writes the same. Spark's own operators drop late rows without a trace, which is why they don't get to see them.

The stateful queries read the staging table. They hold back at most what the first step let pass,
so nothing is lost between the two: what is staged is counted, what is not lies in the side table.

* ``login_day``: tumbling windows of a local day; a day is written when the watermark has passed it.
* ``traffic_hour``: one row for each user, course and hour (``dropDuplicatesWithinWatermark``), then windows of
  an hour. State holds what the watermark has not passed, not every user ever seen.
* ``instance_time_day``: state machines that hold, for each user and course, the last event and those
  that may still be overtaken; timers in event time emit capped gaps. Pairs are dealt to a fixed number of
  machines, since state and timers of each pair apart would cost calls to the state store for every pair and day.

Event time is the local clock of the reports, so windows are local days and hours. Late rows are
brought in by ``repair``: as partial sums where the table allows it, else by building their days again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.functions.times import local_ts
from lectern.operators import tools
from lectern.operators.timeontask import MAX_GAP
from lectern.settings import Settings
from lectern.sources import LmsTables
from lectern.streaming import rollups

DELAY_SECONDS = 2 * 86400
COLUMNS = "id bigint, userid bigint, courseid bigint, action string, target string, contextinstanceid bigint, timecreated bigint"
_SCHEMA = f"{COLUMNS}, at timestamp, batch bigint"


class Arrivals:
    """Folder of a stream's staged rows, late rows and newest events, each by micro-batch."""

    def __init__(self, spark: SparkSession, root: str, delay_seconds: int = DELAY_SECONDS):
        if delay_seconds < 3600:
            raise ValueError("the delay must cover an hour, the longest time between two events of one count of users")
        self.spark, self.root, self.delay = spark, root, delay_seconds

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _read(self, name: str, schema: str) -> DataFrame:
        fs = rollups.DayTable(self.spark, self.root, "fecha date").folder
        if not fs.names(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def late(self) -> DataFrame:
        return self._read("late", _SCHEMA)

    def newest(self, before: int) -> datetime | None:
        """Newest event of all batches before a number; one row a batch is read."""
        return self._read("newest", "at timestamp, batch bigint").where(F.col("batch") < before).agg(F.max("at")).first()[0]

    def take(self, batch: DataFrame, number: int) -> None:
        """Split one micro-batch."""
        newest = self.newest(number)
        behind = F.lit(False) if newest is None else F.col("at") <= F.lit(newest - timedelta(seconds=self.delay))
        for name, rows in (("staged", batch.where(~behind)), ("late", batch.where(behind)), ("newest", batch.agg(F.max("at").alias("at")).where("at is not null"))):
            rows.write.mode("overwrite").parquet(f"{self.path(name)}/batch={number}")

    def staged_stream(self) -> DataFrame:
        """Staged rows as a stream; whole micro-batches at a time, since no limit of files is set."""
        rows = self.spark.readStream.schema(_SCHEMA).parquet(self.path("staged"))
        return rows.withWatermark("at", f"{self.delay} seconds")


def shaped(log: DataFrame, s: Settings) -> DataFrame:
    """The columns of the log that the streams use, with the local clock as event time."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    rows = log.filter((F.col("userid") > 0) & F.col("courseid").isNotNull() & F.col("timecreated").isNotNull())
    return rows.select(*names, local_ts(F.col("timecreated"), s.report_tz).alias("at"))


def _run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]):
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def receive(log: DataFrame, s: Settings, arrivals: Arrivals):
    """Split what has arrived on a stream of the log into staged and late rows."""
    return _run(shaped(log, s), arrivals.path("checkpoint"), arrivals.take)


# -- sinks -----------------------------------------------------------------------


def _added(store: rollups.Store, job: str):
    """Add each micro-batch to a table, once: the number of the last one is part of the manifest."""

    def each(batch: DataFrame, number: int) -> None:
        table = store.table(job)
        if table.manifest().batches.get("stream", -1) >= number:
            return
        change = table.change()
        change.add(batch)
        change.batch("stream", number)
        change.commit()

    return each


# -- login_day ---------------------------------------------------------------------


def login_days(staged: DataFrame) -> DataFrame:
    """Views per local day, user and course, each day once the watermark has passed it."""
    own = F.when(F.col("target") == "course", F.col("timecreated"))
    return (
        staged.filter(F.col("action") == "viewed")
        .groupBy(F.window("at", "1 day"), "userid", "courseid")
        .agg(
            F.count("*").alias("ingresos"),
            F.min("timecreated").alias("primer_ts"),
            F.max("timecreated").alias("ultimo_ts"),
            F.count(own).alias("vistas_curso"),
            F.min(own).alias("primera_vista"),
            F.max(own).alias("ultima_vista"),
        )
        .select(F.to_date("window.start").alias("fecha"), "*")
        .drop("window")
    )


def run_login_day(arrivals: Arrivals, store: rollups.Store):
    return _run(login_days(arrivals.staged_stream()), arrivals.path("checkpoint-login_day"), _added(store, "login_day"))


# -- traffic_hour ------------------------------------------------------------------


def traffic_hours(staged: DataFrame) -> DataFrame:
    """Unique users per local hour and course, each hour once the watermark has passed it.

    Two events of a user in one hour lie less than an hour apart, which the delay covers: while the second one
    may still come, the first one is remembered.
    """
    once = (
        staged.filter(F.col("action") == "viewed")
        .select("at", F.date_trunc("hour", "at").alias("hour"), "courseid", "userid")
        .dropDuplicatesWithinWatermark(["hour", "courseid", "userid"])
    )
    return (
        once.groupBy(F.window("at", "1 hour"), "courseid")
        .agg(F.count("*").alias("usuarios_unicos"))
        .select(F.to_date("window.start").alias("fecha"), F.hour("window.start").alias("hora"), "courseid", "usuarios_unicos")
    )


def run_traffic_hour(arrivals: Arrivals, store: rollups.Store):
    stream = traffic_hours(arrivals.staged_stream())
    return _run(stream, arrivals.path("checkpoint-traffic_hour"), _added(store, "traffic_hour"))


# -- time on task ------------------------------------------------------------------


class GapMachine(StatefulProcessor):
    """Gaps between the events of each user and course, in order of time and id, for the pairs of one slot.

    ``open`` holds events that an earlier one may still overtake, ``last`` the newest one of each pair that none can.
    When the watermark passes an event, the gap from the last one is booked on the last one's instance, if both
    are of one day; at the end of its day, the last event of a day is booked with 0. Both states are lists of
    packed arrays of events: a pair costs no call to the state store of its own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "events binary")
        self.last = handle.getListState("last", "events binary")
        # Slots that have taken all that the watermark of this micro-batch lets through.
        self.done: set[int] = set()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timers: set[int] = set()
        newest = None
        for frame in rows:
            events = _events(frame)
            self.open.appendValue((events.tobytes(),))
            newest = max(int(events["at"].max()), newest) if newest is not None else int(events["at"].max())
            timers.update((np.unique(events["at"] // _DAY) * _DAY + _DAY).tolist())
        # One timer for the newest event of a batch, one for the end of each of its days.
        for when in timers if newest is None else timers | {newest}:
            self.handle.registerTimer(when)
        self.done.discard(key[0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Timers of one slot often expire together, and the first one does the work of all.
        if key[0] in self.done:
            return
        self.done.add(key[0])
        passed = timerValues.getCurrentWatermarkInMs()
        waiting, last = _unpacked(self.open), _unpacked(self.last)
        ready = waiting["at"] <= passed
        # The last ones stand first, then the events that nothing can overtake any more.
        events = np.concatenate([last, waiting[ready]])
        later = np.arange(len(events)) >= len(last)
        order = np.lexsort((events["id"], events["timecreated"], later, events["courseid"], events["userid"]))
        booked, kept = _booked(events[order], passed)
        if ready.any():
            _put(self.open, waiting[~ready])
        if ready.any() or len(kept) < len(last):
            _put(self.last, kept)
        if len(booked):
            yield booked

    def close(self) -> None:
        pass


_DAY = 86_400_000
# Fixed value: user-course pairs are dealt to so many state machines. A running checkpoint depends on it.
SLOTS = 2048
# Events of one packed array at most.
PACKED = 50_000
_EVENT = np.dtype([(n, "i8") for n in ("userid", "courseid", "id", "timecreated", "module", "at")] + [("placed", "?")])


def _events(frame: pd.DataFrame) -> np.ndarray:
    events = np.empty(len(frame), _EVENT)
    for name in ("userid", "courseid", "id", "timecreated"):
        events[name] = frame[name]
    module = frame["contextinstanceid"].astype("Int64")
    events["module"], events["placed"] = module.fillna(0), module.notna()
    events["at"] = (frame["at"] - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)
    return events


def _unpacked(state) -> np.ndarray:
    return np.concatenate([np.empty(0, _EVENT), *(np.frombuffer(e[0], _EVENT) for e in state.get())])


def _put(state, events: np.ndarray) -> None:
    if len(events):
        state.put([(events[i : i + PACKED].tobytes(),) for i in range(0, len(events), PACKED)])
    else:
        state.clear()


def _booked(events: np.ndarray, passed: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Seconds per day, pair and instance of events in order, and the last ones of days that may still go on."""
    day, then = events["at"] // _DAY, np.append(events[1:], events[:1])
    follows = (events["userid"] == then["userid"]) & (events["courseid"] == then["courseid"])
    follows[-1:] = False
    gap = np.clip(then["timecreated"] - events["timecreated"], 0, MAX_GAP)
    seconds = np.where(follows & (day == then["at"] // _DAY), gap, 0)
    closed = follows | (day * _DAY + _DAY <= passed)
    rows = pd.DataFrame({
        "day": day[closed],
        "userid": events["userid"][closed],
        "courseid": events["courseid"][closed],
        "modulo": pd.array(events["module"][closed], dtype="Int64"),
        "segundos": seconds[closed],
    })
    rows.loc[~events["placed"][closed], "modulo"] = pd.NA
    sums = rows.groupby(["day", "userid", "courseid", "modulo"], dropna=False, as_index=False, sort=False)["segundos"].sum()
    sums.insert(0, "fecha", pd.to_datetime(sums.pop("day") * _DAY, unit="ms").dt.date)
    return sums, events[~closed]


def gaps(staged: DataFrame) -> DataFrame:
    """Capped gap seconds per local day, user, course and context instance, as partial sums."""
    return (
        staged.select("id", "userid", "courseid", "contextinstanceid", "timecreated", "at")
        .withColumn("slot", F.pmod(F.xxhash64("userid", "courseid"), F.lit(SLOTS)))
        .groupBy("slot")
        .transformWithStateInPandas(
            GapMachine(), "fecha date, userid bigint, courseid bigint, modulo bigint, segundos bigint", outputMode="Append", timeMode="EventTime"
        )
    )


def run_instance_time(arrivals: Arrivals, store: rollups.Store):
    stream = gaps(arrivals.staged_stream())
    return _run(stream, arrivals.path("checkpoint-instance_time_day"), _added(store, "instance_time_day"))


def time_per_tool(t: LmsTables, instances: DataFrame) -> DataFrame:
    """``estimated_time_day`` out of seconds per context instance."""
    return (
        instances.join(tools.modules(t, "all").select(F.col("module_id").alias("modulo"), "tool"), "modulo", "left")
        .groupBy("fecha", "userid", "courseid", F.coalesce("tool", F.lit("curso")).alias("herramienta"))
        .agg(F.sum("segundos").alias("segundos"))
    )


RUNS = {"login_day": run_login_day, "traffic_hour": run_traffic_hour, "instance_time_day": run_instance_time}


def run(log: DataFrame, s: Settings, arrivals: Arrivals, store: rollups.Store, jobs: tuple[str, ...]) -> None:
    """Take what has arrived, then bring the tables of ``jobs`` up to the watermark."""
    receive(log, s, arrivals)
    for job in jobs:
        RUNS[job](arrivals, store)


def repair(t: LmsTables, s: Settings, arrivals: Arrivals, store: rollups.Store, job: str) -> None:
    """Bring late rows into a table. Each batch of late rows counts once, however often this runs.

    Partial sums are added. Of other tables, whole days are built again from the log; that waits until
    the watermark has passed the day, and from then on the stream adds nothing to it.
    """
    table = store.table(job)
    done = table.manifest().batches.get("late", -1)
    late = arrivals.late().where(F.col("batch") > done).withColumn("fecha", F.to_date("at"))
    days = late.groupBy("fecha").agg(F.min("batch").alias("first"), F.max("batch").alias("last")).orderBy("fecha").collect()  # a row a day
    if not days:
        return
    change = table.change()
    if job in rollups.MERGED:
        newest = max(d.last for d in days)
        rows = late.where(F.col("batch") <= newest).drop("fecha", "at", "batch")
        change.add(rollups.BUILDERS[job](rollups._with_log(t, rows), s))
    else:
        passed = arrivals.newest(2**62) - timedelta(seconds=arrivals.delay)
        ready = [d for d in days if datetime(d.fecha.year, d.fecha.month, d.fecha.day) + timedelta(days=1) <= passed]
        newest = min([d.first - 1 for d in days if d not in ready], default=max(d.last for d in days))
        upto = rollups.newest_id(t)
        for first, last in rollups.day_ranges([d.fecha for d in ready]):
            rollups.run_range(t, s, change, job, first, last, upto)
    change.batch("late", newest)
    change.commit()


def closed(arrivals: Arrivals, store: rollups.Store, job: str) -> DataFrame:
    """The days of a table that the watermark has passed: those that only late rows can still change."""
    newest = arrivals.newest(2**62)
    if newest is None:
        return store.read(job).limit(0)
    passed = newest - timedelta(seconds=arrivals.delay)
    return store.read(job, until=(passed.date() - timedelta(days=1)).isoformat())

"""Tables of whole days whose changes are all or nothing.

Rows lie in version folders that are never changed (``data/v=<name>/fecha=<day>``). A manifest, one
small file, says which versions make up each day; the newest manifest is the table. A change writes its
rows into versions of their own and then a new manifest beside the old one, moved into place by one
rename. A reader that started before sees the old days, one that starts later the new ones, and a
run that dies in between leaves folders that no manifest names. Two writers can't both take the
same number: the slower one applies its change to the faster one's manifest.

A day may have several versions: the rows that it was built from, and rows added later. How they are
put together is up to the table's reader (``parts`` says which days need it).
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEPT_MANIFESTS = 2
GRACE_SECONDS = 24 * 3600


@dataclass
class Day:
    """Versions of a day, and the log id up to which they count everything (None: not known)."""

    versions: list[str]
    upto: int | None = None


@dataclass
class Manifest:
    number: int = 0
    days: dict[str, Day] = field(default_factory=dict)
    last_full_date: str | None = None
    last_id: int | None = None
    # Last micro-batch applied, by query: a batch that is run again changes nothing.
    batches: dict[str, int] = field(default_factory=dict)

    def to_json(self) -> str:
        days = {k: [d.versions, d.upto] for k, d in sorted(self.days.items())}
        return json.dumps([self.number, days, self.last_full_date, self.last_id, self.batches])

    @classmethod
    def from_json(cls, text: str) -> "Manifest":
        number, days, *rest = json.loads(text)
        return cls(number, {k: Day(*d) for k, d in days.items()}, *rest)


class Folder:
    """The few file operations a table needs, on whatever file system Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._gateway = spark.sparkContext._gateway

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self._conf)

    def names(self, name: str) -> list[str]:
        fs, where = self._fs(), self._path(name)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def age(self, name: str) -> float:
        return time.time() - self._fs().getFileStatus(self._path(name)).getModificationTime() / 1000

    def text(self, name: str) -> str:
        stream = self._fs().open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_new(self, name: str, text: str) -> bool:
        """Make a file appear whole under a name that must be free; False if it is taken."""
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        stream = self._fs().create(self._path(aside), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self._conf)
        no_options = self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(aside), self._path(name), no_options)
        except Exception as e:
            self.delete(aside)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self._fs().delete(self._path(name), True)


class DayTable:
    """A table partitioned by ``fecha`` under ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root = spark, root
        self.schema = T._parse_datatype_string(schema)
        self.folder = Folder(spark, root)

    # -- manifests --------------------------------------------------------------

    def _numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.folder.names("manifest") if n.endswith(".json"))

    def manifest(self) -> Manifest:
        """The newest manifest. One that expires while it is looked for has been followed by a newer one."""
        while numbers := self._numbers():
            try:
                return Manifest.from_json(self.folder.text(f"manifest/{numbers[-1]:012d}.json"))
            except Exception as e:
                if "FileNotFoundException" not in str(e):
                    raise
        return Manifest()

    def change(self) -> "Change":
        return Change(self)

    # -- reading ----------------------------------------------------------------

    def rows(self, days: dict[str, Day]) -> DataFrame:
        """All rows of some days of a manifest; only their folders are listed and read."""
        paths = [f"{self.root}/data/v={v}/fecha={day}" for day, d in days.items() for v in d.versions]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema.fields, T.StructField("v", T.StringType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*paths).drop("v")

    def parts(self, since: str | None = None, until: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Rows of days made of one version, and of days made of several, from one manifest."""
        days = {k: d for k, d in self.manifest().days.items() if (since is None or k >= since) and (until is None or k <= until)}
        single = {k: d for k, d in days.items() if len(d.versions) == 1}
        return self.rows(single), self.rows({k: d for k, d in days.items() if k not in single})

    # -- upkeep -----------------------------------------------------------------

    def expire(self, keep: int = KEPT_MANIFESTS, grace_seconds: float = GRACE_SECONDS) -> list[str]:
        """Delete manifests but the newest ``keep``, and versions that none of these names and that are older
        than ``grace_seconds`` (a younger one may belong to a run that has not finished)."""
        numbers = self._numbers()
        for n in numbers[:-keep]:
            self.folder.delete(f"manifest/{n:012d}.json")
        named = set()
        for n in numbers[-keep:]:
            for d in Manifest.from_json(self.folder.text(f"manifest/{n:012d}.json")).days.values():
                named |= {f"v={v}" for v in d.versions}
        gone = [v for v in self.folder.names("data") if v not in named and self.folder.age(f"data/{v}") >= grace_seconds]
        for v in gone:
            self.folder.delete(f"data/{v}")
        return gone


class Change:
    """Changes to a table that take effect together, at ``commit``."""

    def __init__(self, table: DayTable):
        self.table = table
        self._steps: list[Callable[[Manifest], None]] = []

    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """Rows in a version of their own, and its days. Rows are rebalanced by day: small days share a
        task, a heavy day is split over several."""
        version = uuid.uuid4().hex
        shaped = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.table.schema.fields])
        shaped = shaped.where(F.col("fecha").isNotNull())
        shaped.hint("rebalance", F.col("fecha")).write.partitionBy("fecha").parquet(f"{self.table.root}/data/v={version}")
        names = self.table.folder.names(f"data/v={version}")
        return version, [n.removeprefix("fecha=") for n in names if n.startswith("fecha=")]

    def replace(self, rows: DataFrame, since: date, until: date, upto: int | None = None) -> None:
        """Make the days of an inclusive range hold exactly ``rows``."""
        version, found = self._write(rows)
        inside = {since + timedelta(days=n) for n in range((until - since).days + 1)}
        new = {day for day in found if date.fromisoformat(day) in inside}

        def step(m: Manifest) -> None:
            for day in inside:
                m.days.pop(day.isoformat(), None)
            for day in new:
                m.days[day] = Day([version], upto)
            # A day without rows is known to be empty up to that id.
            for day in inside:
                if upto is not None and day.isoformat() not in new:
                    m.days[day.isoformat()] = Day([], upto)

        self._steps.append(step)

    def add(self, rows: DataFrame, upto: int | None = None) -> None:
        """Add rows to their days, beside what these hold. ``upto`` is then the last log id counted there. Without
        it, days that count everything up to some id stay as they are."""
        version, found = self._write(rows)

        def step(m: Manifest) -> None:
            for day in found:
                held = m.days.get(day, Day([]))
                if upto is None and held.upto is not None:
                    continue
                m.days[day] = Day([*held.versions, version], held.upto if upto is None else upto)

        self._steps.append(step)

    def swap(self, rows: DataFrame, days: dict[str, Day]) -> None:
        """Put the versions that ``days`` name into one, with ``rows`` for them. Versions that were added since then
        stay beside it; a day that was replaced since then stays as it is."""
        version, found = self._write(rows)

        def step(m: Manifest) -> None:
            for day, old in days.items():
                now = m.days.get(day, Day([])).versions
                if now[: len(old.versions)] == old.versions:
                    m.days[day].versions = [*([version] if day in found else []), *now[len(old.versions) :]]

        self._steps.append(step)

    def note(self, day: date, last_id: int | None) -> None:
        """The last full day and the last log id seen; neither ever falls."""

        def step(m: Manifest) -> None:
            m.last_full_date = max(day.isoformat(), m.last_full_date or "")
            m.last_id = last_id if m.last_id is None else m.last_id if last_id is None else max(last_id, m.last_id)

        self._steps.append(step)

    def batch(self, query: str, number: int) -> None:
        self._steps.append(lambda m: m.batches.update({query: max(number, m.batches.get(query, -1))}))

    def commit(self) -> Manifest:
        while True:
            m = self.table.manifest()
            for step in self._steps:
                step(m)
            m.number += 1
            if self.table.folder.put_new(f"manifest/{m.number:012d}.json", m.to_json()):
                return m

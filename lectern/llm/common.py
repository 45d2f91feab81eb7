"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import hashlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import scratch_path, size_of

# Bytes at most of one batch of rows on its way to Python. Engine and worker hold it several times over (buffers
# that double, objects made of it), so the engine's own 64 MB would let wide texts take hundreds of MB a task.
BATCH_BYTES = 4 << 20
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, whatever folder or path the driver was started with, and bound the
    batches that its functions get; a smaller bound of the session stays."""
    now = spark.conf.get(BATCHES)
    if now.startswith("-") or not 0 < size_of(now) <= BATCH_BYTES:
        spark.conf.set(BATCHES, str(BATCH_BYTES))
    sc = spark.sparkContext
    if not getattr(sc, "_lectern_archive", None):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        # The driver serves this file to its executors, so it stays as long as the context does.
        sc._lectern_archive = folder = tempfile.TemporaryDirectory()
        sc.addPyFile(shutil.make_archive(os.path.join(folder.name, "lectern_package"), "zip", root, "lectern"))


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names for intermediate results that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"__{stem}"
        while name.lower() in taken:
            name = f"__{stem}_{uuid.uuid4().hex[:8]}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A top-level column, also where its name holds a dot or a blank."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once a row."""
    return F.transform(F.array(value), body)[0]


_HELD: dict = {}
_ASKED: set = set()


def held(key, make: Callable[[], object]):
    """``make()``, kept by the worker process for later tasks that ask for ``key``. Tasks of
    ``per_text`` and ``per_row`` drop what they don't ask for, so no operator's tables outlast its tasks by much."""
    _ASKED.add(key)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def _started(make: Callable[[], Callable]) -> Callable:
    _ASKED.clear()
    run = make()
    for key in _HELD.keys() - _ASKED:
        del _HELD[key]
    return run


def lean(run: Callable[[Iterator], Iterator]):
    """A function for ``mapInArrow`` whose worker gives freed memory back at the end of a task: workers wait for
    later tasks, and allocators would keep up to the most that a task held."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def give_back() -> None:
    """Freed memory of this process, back to the system."""
    pa.default_memory_pool().release_unused()
    # Other C libraries than glibc lack the function.
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def per_text(make: Callable[[], Callable[..., tuple]], schema: str):
    """Arrow-batched UDF over a column: ``make()`` runs once a task and gives the function from a
    value to the fields of ``schema``. Rows never meet, so a task holds one batch at a time."""
    return _per_row(make, schema, False)


def per_row(make: Callable[[], Callable[..., tuple]], schema: str):
    """``per_text`` for functions of several columns."""
    return _per_row(make, schema, True)


def _per_row(make, schema: str, several: bool):
    ship_package(SparkSession.active())
    kind = T._parse_datatype_string(schema)
    names = kind.fieldNames()
    columns = {f.name: f.dataType for f in kind.fields}

    def frame(rows: list[tuple]) -> pd.DataFrame:
        parts = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pd.DataFrame(
            {n: pd.Series(list(p), dtype=_DTYPES.get(columns[n].typeName(), object)) for n, p in zip(names, parts, strict=True)},
            columns=names,
        )

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = _started(make)
        for values in batches:
            yield frame([run(v) for v in values])

    def many(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        run = _started(make)
        for columns_ in batches:
            yield frame([run(*values) for values in zip(*columns_, strict=True)])

    return F.pandas_udf(many if several else one, kind)


_DTYPES = {"long": "int64", "integer": "int32", "double": "float64", "boolean": "bool"}


def text_digest(text: Column) -> Column:
    """128-bit content key of a text as 16 bytes; texts are the same where it is, null is empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


# Shuffle files go as soon as the job that wrote them has ended, not when the driver collects its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the cluster's shared folder, which outlives executors. No later
    plan reads the shuffles behind it, so they are deleted."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, row_bytes: int, most: int = 8 << 20) -> DataFrame:
    """A written table as the small side of a join: broadcast if its rows, counted, fit into ``most``
    bytes; beyond that the join shuffles it."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df


def dropped(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


_KEPT = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: letters A-Z in lower case, digits, and everything beyond ASCII."""
    return (text or "").encode().translate(_KEPT).split()

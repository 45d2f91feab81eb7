"""Where the LMS tables come from.

A catalogue hands out one DataFrame per table name. Three kinds of storage are
supported: a folder of Parquet tables, a JDBC database read in parallel
slices, and the star-schema test tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import prepare, widen
from lectern.sources.schemas import SCHEMAS
from lectern.sources.star_views import STAR_TABLES, STAR_VIEWS

LOG = "mdl_logstore_standard_log"

# Tables that grow with use; one connection could not read them.
FACT_TABLES = frozenset(
    (
        LOG, "mdl_user_enrolments", "mdl_role_assignments", "mdl_forum_posts", "mdl_forum_discussions", "mdl_quiz_attempts",
        "mdl_assign_submission", "mdl_feedback_completed", "mdl_survey_answers", "mdl_chat_messages",
        "mdl_bigbluebuttonbn_logs",
    )
)

# Fixed value: rows fetched from the database per round trip.
FETCH_ROWS = 20_000
# Layout of a stored log: row groups that hold few courses and users, and distinct values a Bloom filter is made for.
ROW_GROUP_BYTES = 16 << 20
BLOOM_VALUES = 20_000


class LmsTables:
    """Read-only access to the LMS tables by name."""

    def __init__(self, spark: SparkSession, loader: Callable[[str], DataFrame], log_table: str = LOG):
        prepare(spark)
        self.spark = spark
        self._loader = loader
        self._log_table = log_table
        self._seen: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise KeyError(f"unknown LMS table {name!r}")
        if name not in self._seen:
            self._seen[name] = self._loader(name)
        return self._seen[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        full = name if name in SCHEMAS else f"mdl_{name}"
        if full not in SCHEMAS:
            raise AttributeError(name)
        return self.table(full)

    @property
    def log_name(self) -> str:
        return self._log_table

    @cached_property
    def log(self) -> DataFrame:
        return self.table(self._log_table)

    def with_log(self, log_table: str) -> "LmsTables":
        """The same catalogue reading its event log from another table."""
        other = LmsTables(self.spark, self._loader, log_table)
        other._seen = self._seen
        return other

    def derived(self, loader: Callable[[str], DataFrame]) -> "LmsTables":
        """A catalogue with the same choice of log over other tables."""
        return LmsTables(self.spark, loader, self._log_table)

    def register_views(self, *names: str) -> None:
        for name in names or SCHEMAS:
            self.table(name).createOrReplaceTempView(name)

    # -- constructors ---------------------------------------------------------

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "LmsTables":
        """One Parquet folder per table under ``root``.

        The log may be partitioned by ``event_date`` (UTC day); time-range scans
        then prune partitions.
        """

        read = _reader(spark)

        def load(name: str) -> DataFrame:
            df = read(f"{root}/{name}")
            extra = ["event_date"] if "event_date" in df.columns else []
            return df.select(*_typed(name), *extra)

        return cls(spark, load)

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        properties: dict[str, str],
        slices: dict[str, tuple[str, int, int, int]] | None = None,
        schema_of: dict[str, str] | None = None,
    ) -> "LmsTables":
        """Read tables over JDBC.

        ``slices`` maps a table to (column, lower, upper, partitions) so that
        executors read ranges in parallel; the bounds only place the cuts, rows
        beyond them are still read. The fact tables need an entry each; a dimension
        table without one is read whole by one connection.
        """
        slices = slices or {}
        schema_of = schema_of or {}

        def load(name: str) -> DataFrame:
            qualified = f"{schema_of[name]}.{name}" if name in schema_of else name
            reader = spark.read.format("jdbc").options(
                url=url, dbtable=qualified, fetchsize=str(FETCH_ROWS), **properties
            )
            if name in FACT_TABLES and name not in slices:
                raise ValueError(f"{name} grows with use: give it slices to be read in parallel")
            if name in slices:
                column, lower, upper, count = slices[name]
                reader = reader.options(
                    partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=str(count)
                )
            return reader.load().select(*_typed(name))

        return cls(spark, load)

    @classmethod
    def from_star(cls, spark: SparkSession, folder: str, log_table: str = LOG) -> "LmsTables":
        """LMS-shaped views over the star-schema Parquet files in ``folder``."""

        read = _reader(spark)

        def star(name: str) -> DataFrame:
            return read(f"{folder}/{name}.parquet")

        return cls(spark, lambda name: star_view(spark, name, star), log_table)

    def store(self, root: str, *names: str) -> "LmsTables":
        """Write tables (all, if none are named) under ``root`` as ``from_parquet`` reads them.

        An explicit load: one Parquet folder per table, the log partitioned by ``event_date``. Within a day its
        rows are laid along a curve through course and user (their bits in turn), so that a row group spans
        few of both, and carry Bloom filters on both: a filter on either skips most row groups, by their bounds or
        by the filter. Days are range partitions of the curve, so a heavy day is spread over several
        tasks and a hot course over several files.
        """
        for name in names or SCHEMAS:
            df = self.table(name)
            if "logstore" in name:
                widths = df.agg(*[F.length(F.bin(F.coalesce(F.max(c), F.lit(1)))) for c in ("courseid", "userid")]).first()
                rows = df.withColumn("event_date", F.to_date(F.timestamp_seconds("timecreated"))).withColumn("curve", interleaved("courseid", "userid", *widths))
                rows = rows.repartitionByRange("event_date", "curve", "id").sortWithinPartitions("event_date", "curve", "id").drop("curve")
                writer = rows.write.partitionBy("event_date")
                for column in ("courseid", "userid"):
                    writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
                    writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(BLOOM_VALUES))
                writer.option("parquet.block.size", str(ROW_GROUP_BYTES)).parquet(f"{root}/{name}")
            else:
                df.write.parquet(f"{root}/{name}")
        return LmsTables.from_parquet(self.spark, root)


def interleaved(first: str, second: str, first_bits: int = 31, second_bits: int = 31) -> Column:
    """The bits of two ids in turn, as one number: near on it are near in both. Both start with their highest bit
    in use (ids below 2 ** ``first_bits`` and 2 ** ``second_bits``), so that both are cut equally often, the first
    one first. Of larger ids the lower bits count, and NULL as 0: the order of rows depends on it, nothing else."""

    def apart(name: str, used: int) -> Column:
        """The bits of an id with a gap after each, by halving the blocks that move together."""
        x = F.coalesce(F.col(name).cast("bigint"), F.lit(0)).bitwiseAND(F.lit((1 << min(used, 31)) - 1))
        x = F.shiftleft(x, 31 - min(used, 31))
        for shift, mask in _SPREAD:
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
        return x

    return F.shiftleft(apart(first, first_bits), 1).bitwiseOR(apart(second, second_bits))


# Blocks of 16, 8, 4, 2, 1 bits, and the places that hold bits after each step.
_SPREAD = (
    (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555),
)


def _reader(spark: SparkSession) -> Callable[[str], DataFrame]:
    """Reads Parquet tables; shuffles get partitions for the bytes of all that it has read."""
    sizes: dict[str, int] = {}

    @cache
    def read(path: str) -> DataFrame:
        df = spark.read.parquet(path)
        sizes[path] = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        widen(spark, sum(sizes.values()))
        return df

    return read


def _typed(name: str) -> list:
    return [F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields]


def star_view(spark: SparkSession, name: str, star: Callable[[str], DataFrame]) -> DataFrame:
    """Build one LMS view; ``star`` may return batch or streaming DataFrames."""
    text = STAR_VIEWS[name]
    inputs: dict[str, DataFrame] = {}
    for other in STAR_VIEWS:
        if "{@" + other + "}" in text:
            text = text.replace("{@" + other + "}", "{" + other + "}")
            inputs[other] = star_view(spark, other, star)
    text = text.replace("{k}", "cast(get_json_object(props, '$.k') as int)")
    text = text.replace("{epoch}", "unix_timestamp(ts)")
    for source in STAR_TABLES:
        if "{" + source + "}" in text:
            inputs[source] = star(source)
    return spark.sql(text, **inputs).select(*_typed(name))

"""Catalogue of stored tables: pruning, pushdown, errors."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import access
from lectern.session import scratch_path
from lectern.sources import LmsTables
from tests.lms import event, tables


@pytest.fixture(scope="module")
def stored(spark):
    root = scratch_path(spark, "stored")
    logs = [event(n, 1 + n % 3, 2, 1704067200 + n * 7200) for n in range(120)]
    t = tables(spark, mdl_logstore_standard_log=logs)
    t.log.withColumn("event_date", F.to_date(F.timestamp_seconds("timecreated"))).write.partitionBy(
        "event_date"
    ).parquet(f"{root}/mdl_logstore_standard_log")
    return LmsTables.from_parquet(spark, root)


def test_time_range_prunes_days_and_pushes_filters(stored):
    df = access.log_between(stored, "2024-01-03", "2024-01-04", "America/Bogota").select("userid")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timecreated,1704258000)" in plan
    assert "LessThan(timecreated,1704430800)" in plan
    partitions = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "event_date" in partitions
    assert "eventname" not in plan.split("ReadSchema")[1]
    assert df.count() == 24


def test_unknown_table(stored):
    with pytest.raises(KeyError):
        stored.table("mdl_nothing")
    with pytest.raises(AttributeError):
        stored.nothing  # noqa: B018


def test_session_zone_is_pinned(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Lima")
    tables(spark)
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


def test_views_can_be_registered(spark):
    t = tables(spark, mdl_role=[{"id": 5, "shortname": "student", "name": "Aprendiz"}])
    t.register_views("mdl_role")
    assert spark.sql("select name from mdl_role").first()[0] == "Aprendiz"


class _FakeReader:
    """Records the options a JDBC read is asked for; no database is opened."""

    def __init__(self, spark, seen):
        self.spark, self.seen, self.given = spark, seen, {}

    def format(self, name):
        assert name == "jdbc"
        return self

    def options(self, **given):
        self.given.update(given)
        return self

    def load(self):
        from lectern.sources.schemas import SCHEMAS

        self.seen.append(self.given)
        return self.spark.createDataFrame([], SCHEMAS[self.given["dbtable"].split(".")[-1]])


class _FakeSession:
    def __init__(self, spark, seen):
        self.conf, self._spark, self._seen = spark.conf, spark, seen

    @property
    def read(self):
        return _FakeReader(self._spark, self._seen)


def test_jdbc_reads_big_tables_in_slices(spark):
    seen = []
    t = LmsTables.from_jdbc(
        _FakeSession(spark, seen),
        "jdbc:postgresql://replica/lms",
        {"user": "reader", "driver": "org.postgresql.Driver"},
        slices={"mdl_logstore_standard_log": ("id", 0, 10**9, 200)},
        schema_of={"regionales": "midb"},
    )
    assert t.log.columns[0] == "id" and t.regionales.columns == ["rgn_id", "nombre"]
    log, regions = seen
    assert log["fetchsize"] == "20000" and log["user"] == "reader"
    assert (log["partitionColumn"], log["lowerBound"], log["upperBound"], log["numPartitions"]) == (
        "id", "0", "1000000000", "200",
    )
    assert regions["dbtable"] == "midb.regionales" and "partitionColumn" not in regions


def test_jdbc_refuses_one_connection_for_a_fact_table(spark):
    t = LmsTables.from_jdbc(_FakeSession(spark, []), "jdbc:postgresql://replica/lms", {})
    with pytest.raises(ValueError):
        t.log

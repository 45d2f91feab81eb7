"""Layout of a stored log: a filter on course or user reads few row groups."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.session import scratch_path
from lectern.sources import LmsTables, catalog
from tests.lms import tables


def _log(spark, rows=60_000):
    """Many courses and users in one day; a third of the rows in one course."""
    return spark.range(rows).selectExpr(
        "id",
        "cast(1 + pmod(hash(id, 7), 900) as bigint) as userid",
        "cast(case when id % 3 = 0 then 2 else 3 + pmod(hash(id), 400) end as bigint) as courseid",
        "70 as contextlevel", "id % 50 as contextinstanceid", "uuid() as eventname", "cast(null as string) component", "'viewed' as action",
        "'course' as target", "cast(null as string) objecttable", "cast(null as bigint) objectid", "cast(null as string) ip",
        "cast(null as string) origin", "1704700000 + id as timecreated",
    )


def _groups(root):
    """Bounds of course and user of every row group of the log."""
    out = []
    for f in pq.ParquetDataset(f"{root}/{catalog.LOG}").files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = [meta.row_group(g).column(c) for c in range(meta.num_columns)]
            bounds = {c.path_in_schema: c.statistics for c in columns}
            out.append(tuple((bounds[c].min, bounds[c].max) for c in ("courseid", "userid")))
    return out


@pytest.fixture(scope="module")
def laid(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    empty = tables(spark)
    log = _log(spark)
    t = LmsTables(spark, lambda name: log if name == catalog.LOG else empty.table(name))
    root = scratch_path(spark, "laid")
    stored = t.store(root, catalog.LOG)
    yield log, stored, root
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_rows_survive(laid):
    log, stored, _ = laid
    columns = ["id", "userid", "courseid", "timecreated"]
    assert stored.log.select(columns).exceptAll(log.select(columns)).isEmpty() and stored.log.count() == log.count()


def _rows_read(spark, df):
    """Rows that a scan hands on: those of the row groups that it did not skip."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        query = df._jdf.queryExecution()
        query.toRdd().count()
        leaf = query.executedPlan().collectLeaves().head()
        return leaf.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("column, values", [("courseid", range(3, 400, 40)), ("userid", range(1, 900, 90))])
def test_a_filter_reads_few_row_groups(spark, laid, column, values):
    log, stored, root = laid
    total = log.count()
    share = [_rows_read(spark, stored.log.filter(F.col(column) == v).select("id")) / total for v in values]
    assert len(_groups(root)) > 100
    # Both share the curve, so either alone is met by about the root of the number of groups; courses are cut first. Those
    # beside the hot course share row groups with it.
    assert sorted(share)[len(share) // 2] < (0.1 if column == "courseid" else 0.2) and max(share) < 0.4, share


def test_the_hot_course_is_spread(laid):
    groups = [g for g in _groups(laid[2]) if g[0][0] == 2]
    assert len(groups) > 10


def test_curve_interleaves_bits(spark):
    df = spark.createDataFrame([(0b101, 0b011), (None, 1), (2**31 - 1, 2**31 - 1), (2**33 + 1, -1)], "a bigint, b bigint")
    got = [r[0] for r in df.select(catalog.interleaved("a", "b")).collect()]

    def want(a, b):
        return sum((((a or 0) >> i) & 1) << (2 * i + 1) | (((b or 0) >> i) & 1) << (2 * i) for i in range(31))

    assert got == [want(0b101, 0b011), want(None, 1), 2**62 - 1, want(2**33 + 1, -1)]


def test_reports_over_the_layout_are_the_same(spark, settings, laid):
    from lectern.operators import access

    log, stored, _ = laid
    assert stored.log.filter(F.col("courseid") == 17).count() == log.filter(F.col("courseid") == 17).count()
    a = access.course_access(stored, settings).agg(F.sum("accesses"), F.count("*")).first()
    b = log.filter("userid > 0").agg(F.count("*"), F.count_distinct("userid", "courseid")).first()
    assert tuple(a) == tuple(b)

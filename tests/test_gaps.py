"""Sliced gap windows equal the plain window, also for one hot key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lectern.operators import timeontask
from lectern.plans import reports
from tests.lms import event, tables

KEYS = ["userid", "course_id"]


def _rows(spark, seed):
    rng = random.Random(seed)
    data = []
    for n in range(800):
        hot = rng.random() < 0.5
        user, course = (1, 2) if hot else (rng.randint(1, 5), rng.randint(2, 4))
        data.append((n, user, course, rng.choice([None, 10, 11, 12]), 1_700_000_000 + int(rng.expovariate(1 / 9000))))
    return spark.createDataFrame(data, "id int, userid int, course_id int, contextinstanceid int, timecreated bigint")


@pytest.mark.parametrize("seed, width", [(1, 1), (2, 60), (3, 3600), (4, 10**9)])
def test_next_event_equals_plain_window(spark, seed, width):
    rows = _rows(spark, seed)
    plain = rows.withColumn(
        "next_time", F.lead("timecreated").over(Window.partitionBy(*KEYS).orderBy("timecreated", "id"))
    )
    sliced = timeontask.next_event(rows, KEYS, width)
    columns = ["id", "next_time"]
    assert sorted(sliced.select(*columns).collect(), key=lambda r: r.id) == sorted(
        plain.select(*columns).collect(), key=lambda r: r.id
    )


@pytest.mark.parametrize("seed, width", [(5, 1), (6, 600), (7, 3600), (8, 10**9)])
def test_early_sums_equal_row_gaps(spark, seed, width):
    rows = _rows(spark, seed)
    plain = (
        rows.withColumn(
            "next_time", F.lead("timecreated").over(Window.partitionBy(*KEYS).orderBy("timecreated", "id"))
        )
        .withColumn("s", timeontask.capped_gap(F.col("timecreated"), F.col("next_time")))
        .groupBy(*KEYS, F.col("contextinstanceid").alias("module_id"))
        .agg(F.sum("s").alias("seconds"))
    )
    early = timeontask.instance_seconds(rows, KEYS, width, F.col("contextinstanceid"))

    def bag(df):
        return sorted(map(tuple, df.select(*KEYS, F.coalesce("module_id", F.lit(-1)), "seconds").collect()))

    assert bag(early) == bag(plain)


def test_gap_rules(spark):
    df = spark.createDataFrame([(0, None), (0, 1800), (0, 1801), (5, 5), (9, 4)], "a bigint, b bigint")
    got = [r[0] for r in df.select(timeontask.capped_gap(F.col("a"), F.col("b"))).collect()]
    assert got == [0, 1800, 1800, 0, 0]


def test_course_level_events_may_count_as_module_time(spark, settings):
    """An instance equal to a module id is module time unless the context is tested."""
    t = tables(
        spark,
        mdl_course=[{"id": 7, "shortname": "m", "fullname": "Curso", "visible": 1, "startdate": 0, "enddate": 0}],
        mdl_user=[{"id": 3, "username": "1ti", "firstname": None, "lastname": "B", "deleted": 1, "suspended": 0}],
        mdl_enrol=[{"id": 1, "courseid": 7, "status": 0}],
        mdl_user_enrolments=[{"id": 1, "enrolid": 1, "userid": 3, "status": 0}],
        mdl_course_modules=[{"id": 7, "course": 9, "module": 4, "instance": 1, "deletioninprogress": 0}],
        mdl_modules=[{"id": 4, "name": "quiz"}],
        mdl_logstore_standard_log=[event(1, 3, 7, 1704100000), event(2, 3, 7, 1704100090), event(3, 3, 7, 1704100090)],
    )
    label = "Porcentaje de tiempo en Pruebas de Conocimientos"
    loose = reports.tiempo_permanencia(t, None, settings).first()
    strict = reports.tiempo_permanencia(t, None, settings, strict_context=True).first()
    assert (loose[label], strict[label]) == (100.0, 0.0)
    assert loose["Total tiempo en grupo/ficha"] == 1.5
    assert loose["Nombres y apellidos"] == " B"
    assert loose["Tipo de Identificación"] == "TI"
    assert loose["Número de ingresos del usuario a grupo/ficha"] == 2

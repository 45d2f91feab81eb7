"""Ordered parts, files, manifest, formats and retention."""

import glob
import json
import os
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lectern.operators import export


def _frame(spark, n):
    return spark.range(1, n + 1).select(
        "id", F.concat(F.lit("fila_"), F.col("id")).alias("nombre"), (F.col("id") * 1.5).alias("valor")
    )


CASES = [(0, 5, 1), (5, 5, 1), (6, 5, 2), (15, 5, 3), (7, 3, 3), (11, 5, 3), (13, 5, 3), (5, 4, 2)]


@pytest.mark.parametrize("rows, per_file, parts", CASES)
def test_part_counts(spark, rows, per_file, parts):
    assigned = export.assign_parts(_frame(spark, rows).repartition(3), [F.col("id")], per_file)
    assert [r.idx for r in assigned.orderBy("id").collect()] == list(range(rows))
    counts = {r.parte: r.filas for r in export.part_counts(assigned).collect()}
    assert len(counts) == parts and sum(counts.values()) == rows
    assert all(counts[p] == per_file for p in range(1, parts))


@pytest.mark.parametrize("rows, per_file, parts", [(0, 5, 1), (6, 5, 2), (13, 5, 3)])
def test_csv_files(spark, tmp_path, rows, per_file, parts):
    out = str(tmp_path / "out")
    counts = export.write_csv_parts(
        _frame(spark, rows), [F.col("id").desc()], out, "prueba", per_file, {"regional": "Huila", "nivel": None},
        "Reporte de prueba", datetime(2024, 1, 15, 8, 30),
    )
    names = [f"prueba_parte_{n:03d}.csv" for n in range(1, parts + 1)]
    assert sorted(r.archivo for r in counts.collect()) == names
    assert sorted(os.path.basename(p) for p in glob.glob(f"{out}/*.csv")) == names
    seen = []
    for name in names:
        with open(f"{out}/{name}", "rb") as file:
            assert file.read(3) == b"\xef\xbb\xbf"
        with open(f"{out}/{name}", encoding="utf-8-sig") as file:
            lines = file.read().splitlines()
        if name == names[0]:
            assert lines[:6] == [
                "Nombre del reporte,Reporte de prueba",
                "Fecha de generación,2024/01/15",
                "Hora de generación,08:30:00",
                "nivel,Todos",
                "regional,Huila",
                "",
            ]
            lines = lines[6:]
        assert lines[0] == "id,nombre,valor"
        seen += [int(line.split(",")[0]) for line in lines[1:]]
    assert seen == list(range(rows, 0, -1))
    with open(glob.glob(f"{out}/manifest/*.json")[0]) as file:
        manifest = [json.loads(line) for line in file]
    assert sum(m["filas"] for m in manifest) == rows and sorted(m["archivo"] for m in manifest) == names
    assert all(m["filtros"] == {"regional": "Huila"} for m in manifest)


def test_csv_keeps_values_exactly(spark, tmp_path):
    texts = [" lead", "trail ", 'quote " inside', "comma, here", "", None, "línea\ndos", "v", "id"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, v string")
    for _ in range(2):  # a second export replaces the first
        export.write_csv_parts(df, [F.col("id")], str(tmp_path / "o"), "r", 4)
    back = export.read_csv_parts(spark, str(tmp_path / "o"), "r", df.schema).collect()
    assert {int(r.id): r.v or "" for r in back} == {i: t or "" for i, t in enumerate(texts)}
    assert {int(r.id): r.parte for r in back} == {i: i // 4 + 1 for i in range(len(texts))}


def test_output_values(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5, 60), date(2024, 1, 2), Decimal("1.50"), None)],
        "a timestamp, b timestamp, c date, d decimal(6,2), e string",
    )
    row = export.preview_values(df).first()
    assert tuple(row) == ("2024-01-02T03:04:05", "2024-01-02T03:04:05.000060", "2024-01-02", 1.5, None)
    assert export.file_values(df).first().e == ""


def test_recent_requests_gives_as_many_as_asked(spark):
    df = spark.range(150).selectExpr("id", "'a@x' usuario_email", "id fecha_solicitud")
    assert export.recent_requests(df, "a@x", 120).count() == 120
    assert export.recent_requests(df, "a@x").count() == 100


def test_retention_keeps_newest(spark):
    rows = [(i, "a@x", "FINALIZADO", f"/{i}", 100 + i // 2) for i in range(7)]
    rows += [(20, "a@x", "ERROR", None, 500), (21, "b@x", "FINALIZADO", "/21", 1), (22, "a@x", "FINALIZADO", None, 900)]
    df = spark.createDataFrame(rows, "id bigint, usuario_email string, estado string, archivo_ruta string, fecha_fin bigint")
    out = {r.id: r.estado for r in export.expire_old_files(df, keep=3).collect()}
    assert {i for i, e in out.items() if e == "EXPIRADO"} == {0, 1, 2, 3}
    assert len(out) == len(rows)


def test_retention_ranks_before_the_shuffle(spark):
    df = spark.range(10).selectExpr(
        "id", "concat('u', id % 2) usuario_email", "'FINALIZADO' estado", "'/x' archivo_ruta", "id fecha_fin"
    )
    plan = export.expire_old_files(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan

"""Whole reports written as files."""

import csv
import glob
import json
from datetime import datetime

import pytest

from lectern.functions import params
from lectern.plans import generate
from tests.lms import stored

CODES = ("registro_usuarios", "trafico_diario", "usuarios_ambiente", "sesiones_online")


@pytest.mark.parametrize("code", CODES)
def test_files_hold_the_report_in_order(spark, settings, tmp_path, code):
    t = stored(spark)
    expected = [["" if v is None else str(v) for v in row] for row in generate.report(code, t, None, settings).collect()]
    out = str(tmp_path / "out")
    counts = generate.generate(code, t, out, None, settings, 40, datetime(2024, 1, 15, 8, 30))
    assert sum(r.filas for r in counts.collect()) == len(expected)
    got = []
    for part in range(1, counts.count() + 1):
        with open(f"{out}/{code}_parte_{part:03d}.csv", newline="", encoding="utf-8-sig") as file:
            rows = list(csv.reader(file))
        if part == 1:
            rows = rows[rows.index([]) + 1 :]
        assert rows[0] == generate.report(code, t, None, settings).columns
        got += rows[1:]
    assert got == expected


def test_heading_lists_every_parameter(spark, settings, tmp_path):
    t = stored(spark)
    out = str(tmp_path / "out")
    given = {"rango_consulta": "Mes", "origen_datos": " ", "otro": 1}
    generate.generate("trafico_diario", t, out, given, settings, made_at=datetime(2024, 1, 15, 8, 30))
    with open(f"{out}/trafico_diario_parte_001.csv", newline="", encoding="utf-8-sig") as file:
        rows = list(csv.reader(file))
    assert [tuple(r) for r in rows[: rows.index([])]] == [
        ("Nombre del reporte", "Tráfico Diario de Usuarios"),
        ("Fecha de generación", "2024/01/15"),
        ("Hora de generación", "08:30:00"),
        ("Rango de fecha desde", "Todos"),
        ("Rango de fecha hasta", "Todos"),
        ("Origen de datos", "Todos"),
        ("Rango de Consulta", "Mes"),
    ]
    (name,) = glob.glob(f"{out}/manifest/*.json")
    with open(name, encoding="utf-8") as file:
        assert json.loads(file.readline())["filtros"] == {"rango_consulta": "Mes"}


def test_unknown_report(spark, settings):
    with pytest.raises(KeyError):
        generate.report("nada", stored(spark), None, settings)


def test_first_rows_follow_report_order(spark, settings):
    t = stored(spark)
    assert generate.first_rows("usuarios_ambiente", t, None, settings).collect() == (
        generate.report("usuarios_ambiente", t, None, settings).collect()[:50]
    )


def test_every_parameter_has_a_label():
    for code, names in params.DECLARED.items():
        assert code in params.TITLES
        assert len(params.heading(code, {})) == len(names)

"""Parameters: blanks, unknown names, spellings, hours, wildcards."""

import pytest

from lectern.functions import filters, params, times


@pytest.mark.parametrize("value", ["", "   ", None])
def test_blank_means_not_set(value):
    assert params.blank_to_none(value) is None
    assert params.clean("trafico_diario", {"origen_datos": value})["origen_datos"] is None


def test_unknown_parameters_are_dropped():
    cleaned = params.clean("trafico_diario", {"origen_datos": "Manual", "nombre": "x"})
    assert cleaned == {"fecha_desde": None, "fecha_hasta": None, "origen_datos": "Manual", "rango_consulta": None}


@pytest.mark.parametrize(
    "given, normal",
    [("todas", None), ("TODOS", None), ("sofia plus", "Integración"), ("INTEGRACIÓN", "Integración"), ("manual", "Manual"),
     ("otra", "otra"), (None, None)],
)
def test_origin_spellings(given, normal):
    assert params.normal_origin(given) == normal


@pytest.mark.parametrize(
    "given, normal", [("dia", "Día"), ("DÍA", "Día"), ("mes", "Mes"), ("ano", "Año"), ("AÑO", "Año"), ("x", "Día"), (None, "Día")]
)
def test_range_spellings(given, normal):
    assert params.normal_range(given) == normal


@pytest.mark.parametrize("given, text", [("7", "07"), ("07", "07"), ("07:30", "07"), ("7:05", "07"), ("23:59", "23")])
def test_hour_spellings(given, text):
    assert times.hour_text(given) == text


def test_filter_text_is_literal_unless_raw(spark):
    df = spark.createDataFrame([("50%",), ("501",), (r"a\b",), ("a_b",), ("axb",)], "v string")

    def found(text, raw=False):
        return sorted(r[0] for r in df.filter(filters.contains(df.v, text, raw)).collect())

    assert found("50%") == ["50%"]
    assert found("50%", raw=True) == ["50%", "501"]
    assert found("A_B") == ["a_b"]
    assert found("a_b", raw=True) == [r"a\b", "a_b", "axb"]
    assert found("a\\") == [r"a\b"]


def test_day_bounds_are_local():
    assert times.day_start("2024-01-08", "America/Bogota") == 1704690000
    assert times.epoch_range("2024-01-08", "2024-01-08", "America/Bogota") == (1704690000, 1704776400)
    assert times.epoch_range(None, None, "America/Bogota") == (None, None)


def test_every_report_declares_its_parameters():
    from lectern.plans.reports import REPORTS

    assert set(REPORTS) == set(params.DECLARED)

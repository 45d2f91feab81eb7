"""Produce a report as files, or its first rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from lectern.functions import params as Q
from lectern.operators import export
from lectern.plans.reports import REPORTS, Params, preview
from lectern.settings import Settings
from lectern.sources import LmsTables


def report(code: str, t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    if code not in REPORTS:
        raise KeyError(f"unknown report {code!r}")
    return REPORTS[code](t, params, s)


def generate(
    code: str,
    t: LmsTables,
    path: str,
    params: Params = None,
    s: Settings = Settings(),
    rows_per_file: int = export.CSV_ROWS_PER_FILE,
    made_at: datetime | None = None,
) -> DataFrame:
    """Write a report as ordered CSV parts with heading and manifest; rows per part."""
    given = Q.clean(code, params)
    return export.write_csv_parts(
        report(code, t, given, s),
        None,
        path,
        code,
        rows_per_file,
        filters=given,
        title=Q.TITLES[code],
        made_at=made_at,
        heading=Q.heading(code, given),
    )


def first_rows(code: str, t: LmsTables, params: Params = None, s: Settings = Settings()) -> DataFrame:
    """The first 50 rows of a report, with dates as text and decimals as doubles."""
    return export.preview_values(preview(report(code, t, params, s)))

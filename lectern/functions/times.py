"""Epoch seconds, local times and validity predicates."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

STAMP = "yyyy/MM/dd HH:mm:ss"

# Bounds that stand for "since ever" and "for ever" (years 0001 and 9999).
OPEN_START = -62135596800
OPEN_END = 253402300799


def local_ts(epoch: Column, tz: str) -> Column:
    """Wall-clock timestamp in ``tz`` (the session zone is UTC)."""
    return F.from_utc_timestamp(F.timestamp_seconds(epoch), tz)


def local_date(epoch: Column, tz: str) -> Column:
    return F.to_date(local_ts(epoch, tz))


def stamp(epoch: Column, tz: str, fmt: str = STAMP) -> Column:
    return F.date_format(local_ts(epoch, tz), fmt)


def unset(epoch: Column) -> Column:
    return epoch.isNull() | (epoch == 0)


def stamp_or(epoch: Column, tz: str, label: str, null_is_unset: bool = True) -> Column:
    """Formatted local time, or ``label`` when the time is not set."""
    missing = unset(epoch) if null_is_unset else epoch == 0
    return F.when(missing, F.lit(label)).otherwise(stamp(epoch, tz))


def day_start(day: str | date, tz: str, plus_days: int = 0) -> int:
    """Epoch at which a local day begins; computed once, outside the plan."""
    d = date.fromisoformat(day) if isinstance(day, str) else day
    d = d + timedelta(days=plus_days)
    return int(datetime(d.year, d.month, d.day, tzinfo=ZoneInfo(tz)).timestamp())


def epoch_range(since: str | None, until: str | None, tz: str) -> tuple[int | None, int | None]:
    """Half-open epoch range of an inclusive range of local days."""
    return (
        day_start(since, tz) if since else None,
        day_start(until, tz, plus_days=1) if until else None,
    )


def in_epoch_range(epoch: Column, bounds: tuple[int | None, int | None]) -> Column | None:
    """Range test on the raw epoch column, so that it can be pushed to the scan."""
    lo, hi = bounds
    tests = []
    if lo is not None:
        tests.append(epoch >= F.lit(lo))
    if hi is not None:
        tests.append(epoch < F.lit(hi))
    if not tests:
        return None
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def valid_at(start: Column, end: Column, instant: Column) -> Column:
    """Instant within [start, end], where 0 or NULL leaves that side open."""
    return (unset(start) | (start <= instant)) & (unset(end) | (end >= instant))


def overlaps(start: Column, created: Column, end: Column, bounds: tuple[int | None, int | None]) -> Column | None:
    """Enrolment that overlaps a half-open period; open ends always do."""
    lo, hi = bounds
    tests = []
    if hi is not None:
        tests.append(F.coalesce(F.nullif(start, F.lit(0)), created) < F.lit(hi))
    if lo is not None:
        tests.append(unset(end) | (end >= F.lit(lo)))
    if not tests:
        return None
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def hour_text(value: str) -> str:
    """Two-digit hour of ``7``, ``07`` or ``07:30``."""
    return value.split(":")[0][:2].rjust(2, "0")


def at_hour(epoch: Column, tz: str, value: str) -> Column:
    return F.date_format(local_ts(epoch, tz), "HH") == F.lit(hour_text(value))


def ratio_2dp(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator rounded half up to two decimals, exactly.

    Integer arithmetic for non-negative inputs; a zero denominator gives NULL.
    """
    den = F.nullif(denominator, F.lit(0)).cast("bigint")
    hundredths = F.call_function("div", numerator.cast("bigint") * 200 + den, den * 2)
    return hundredths.cast("double") / F.lit(100.0)

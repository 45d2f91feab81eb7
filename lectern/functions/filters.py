"""Optional predicates. Each returns the frame unchanged when its value is None."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.times import at_hour, day_start, in_epoch_range


def like_text(value: str, raw: bool) -> str:
    """Escape the wildcards of user text so that it matches literally."""
    if raw:
        return value
    return value.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")


def contains(column: Column, value: str, raw: bool = False) -> Column:
    return column.ilike(f"%{like_text(value, raw)}%")


def any_contains(columns: list[Column], value: str, raw: bool = False) -> Column:
    return reduce(lambda a, b: a | b, [contains(c, value, raw) for c in columns])


def ilike_any(column: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [column.ilike(f"%{w}%") for w in words])


class Optional:
    """Chain of optional filters over a DataFrame."""

    def __init__(self, df: DataFrame, params: dict, tz: str, raw: bool = False):
        self.df, self.params, self.tz, self.raw = df, params, tz, raw

    def _value(self, name: str):
        return self.params.get(name)

    def keep(self, test: Column | None) -> "Optional":
        if test is not None:
            self.df = self.df.filter(test)
        return self

    def contains(self, name: str, *columns: Column) -> "Optional":
        value = self._value(name)
        return self if value is None else self.keep(any_contains(list(columns), value, self.raw))

    def whole(self, name: str, column: Column) -> "Optional":
        """Case-insensitive comparison of the whole value."""
        value = self._value(name)
        return self if value is None else self.keep(column.ilike(like_text(value, self.raw)))

    def equals(self, name: str, column: Column) -> "Optional":
        value = self._value(name)
        return self if value is None else self.keep(column == F.lit(value))

    def constant(self, name: str, label: str) -> "Optional":
        """Filter on a constant column: keeps every row or none."""
        value = self._value(name)
        return self if value is None or value == label else self.keep(F.lit(False))

    def hour(self, name: str, epoch: Column, must_be_set: bool = False) -> "Optional":
        value = self._value(name)
        if value is None:
            return self
        test = at_hour(epoch, self.tz, value)
        return self.keep((epoch > 0) & test if must_be_set else test)

    def on_day(self, name: str, epoch: Column, must_be_set: bool = False) -> "Optional":
        value = self._value(name)
        if value is None:
            return self
        test = in_epoch_range(epoch, (day_start(value, self.tz), day_start(value, self.tz, 1)))
        return self.keep((epoch > 0) & test if must_be_set else test)

    def since(self, name: str, epoch: Column, must_be_set: bool = False) -> "Optional":
        value = self._value(name)
        if value is None:
            return self
        test = epoch >= F.lit(day_start(value, self.tz))
        return self.keep((epoch > 0) & test if must_be_set else test)

    def until(self, name: str, epoch: Column, must_be_set: bool = False) -> "Optional":
        value = self._value(name)
        if value is None:
            return self
        test = epoch < F.lit(day_start(value, self.tz, 1))
        return self.keep((epoch > 0) & test if must_be_set else test)

    def number(self, name: str, column: Column) -> "Optional":
        value = self._value(name)
        return self if value is None else self.keep(column == F.lit(int(value)))

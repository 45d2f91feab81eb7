"""Joins of many rows per key against one short entry per key.

A user-course pair may hold a large part of the log or of the enrolments. How much, only the shuffle
knows: adaptive skew splitting measures its partitions, cuts those that hot keys fill into
tasks of bounded size, and gives each of these the entries that it needs. Keys that aren't hot are neither
cut nor repeated.

It can cut a join only where both sides come fresh from a shuffle for this join. The short side usually
is the outcome of an aggregation by the same keys and would be joined as it lies. So both sides get
a further key that is always 0, which no earlier partitioning has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR = ["userid", "course_id"]


def join_hot(many: DataFrame, short: DataFrame, how: str = "inner", keys=PAIR) -> DataFrame:
    """Join on ``keys``; rows of ``many`` with one key may fill many tasks."""
    zero = F.pmod(F.hash(*keys), F.lit(1)).alias("_zero")
    return many.select("*", zero).join(short.select("*", zero), [*keys, "_zero"], how).drop("_zero")

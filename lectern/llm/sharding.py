"""Proportional stratified interleaving of documents into shards.

Rows of each source are put into a seeded random order and given their fractional rank
(2 * rank - 1) / (2 * rows of the source). Sorted by it, all sources run through the corpus at their
own even pace, so that any stretch holds them in the mixture's proportions. The sorted sequence is
cut into equal stretches: row counts of shards differ by one at most (law ``rows``), and a source's
share in a shard by two rows at most.

No window spans a source or the corpus. The random key is cut into even ranges, ranks are counted
within (source, range) and shifted by the counts of the ranges before; the same is done with ranges
of the fractional rank. The number of ranges follows the row count, so a window holds about
``rows_per_range`` rows however large a source is. Only the table of counts is summed in order, by
range groups first, so that no task sees more than its square root.

Null sources form a source of their own; a null text has size 1 and the checksum of no bytes.
Rows equal in id and text are interchangeable and take neighbouring ranks. An empty table gives
no rows. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col

SHARDS = 16
SEED = 17
ROWS_PER_RANGE = 16384


def shuffle_key(seed: int) -> Column:
    """128 random-looking bits of a row, from its id and text."""
    return F.md5(
        F.concat_ws(":", F.lit(seed), F.coalesce(col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(col("text"), F.lit(""))))
    )


def _before(counts: DataFrame, by: list[str], place: str, group: int) -> DataFrame:
    """``before``: sum of ``n`` over the smaller places with the same ``by``, in two levels."""
    counts = counts.withColumn("grp", F.floor(F.col(place) / group))
    inner = W.partitionBy(*by, "grp").orderBy(place)
    outer = W.partitionBy(*by).orderBy("grp").rowsBetween(W.unboundedPreceding, -1)
    groups = counts.groupBy(*by, "grp").agg(F.sum("n").alias("gn")).select(
        *by, "grp", F.coalesce(F.sum("gn").over(outer), F.lit(0)).alias("base")
    )
    return counts.withColumn("within", F.sum("n").over(inner) - F.col("n")).join(groups, [*by, "grp"]).select(
        *by, place, (F.col("base") + F.col("within")).alias("before")
    )


def interleave(df: DataFrame, shards: int = SHARDS, seed: int = SEED, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per document: its shard, its slot there, and size and checksum of its text."""
    total = df.count()
    ranges = max(1, math.ceil(total / rows_per_range))
    group = math.ceil(math.sqrt(ranges))
    text = F.coalesce(col("text"), F.lit(""))
    rows = df.select(
        col("doc_id").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), col("source").cast("string")), F.lit("")).alias("source"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shuffle_key(seed).alias("key"),
    ).withColumn("part", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") * ranges / 2**32))

    counts = rows.groupBy("source", "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.groupBy("source").agg(F.sum("n").alias("of"))
    starts = _before(counts, ["source"], "part", group).join(sizes, "source")
    own = W.partitionBy("source", "part").orderBy("key", "doc_id")
    ranked = (
        rows.withColumn("row", F.row_number().over(own))
        .join(starts, ["source", "part"])
        .withColumn("share", (2 * (F.col("before") + F.col("row")) - 1) / (2 * F.col("of")))
        .select("doc_id", "size", "text_crc32", "source", "key", "share", F.floor(F.col("share") * ranges).alias("range"))
    )
    firsts = _before(ranked.groupBy("range").agg(F.count(F.lit(1)).alias("n")), [], "range", group)
    # The counts are joined beside the rows' own shuffle; ranges are even, so none is hot.
    near = W.partitionBy("range").orderBy("share", "source", "key", "doc_id")
    place = F.col("before") + F.col("row") - 1
    return (
        ranked.withColumn("row", F.row_number().over(near))
        .join(firsts, "range")
        .withColumn("at", place)
        .withColumn("shard", F.expr(f"cast(at * {shards} div {max(1, total)} as int)"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            F.expr(f"at - (shard * {total}L + {shards - 1}) div {shards}").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

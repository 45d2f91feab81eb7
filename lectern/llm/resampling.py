"""Quality selection by importance resampling.

Two generative models of hashed n-grams are counted: the target's over documents labelled good (a
bounded sample, ``TARGET_ROWS``), the raw one over all documents. The grams are single words and
pairs of neighbours, and the same over word shapes (runs of capitals, small letters, digits, marks).
A document's importance is the logarithm of its probability ratio; grams depend on each other, so
that is the mean a gram times at most ``MAX_GRAMS`` grams. Gumbel noise, drawn from a hash of id and
text, is added, and the ``SHARE`` of the rows with the largest sums is selected: a sample without
replacement with chances in proportion to importance.

The cut is found exactly without sorting: counts of the leading bits of the sums, twelve bits a
pass, narrow down to the one value where the wanted number is reached.

Null and empty texts have no grams and importance 0. Rows equal in id and text have equal sums and
are interchangeable; where they meet the cut, as many as fit are selected. Without labelled rows every
importance is 0. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, per_text, ship_package, written

BUCKETS = 1 << 14  # a half each for words and for shapes
TARGET_ROWS = 20_000
SHARE = 0.85
MAX_GRAMS = 64
SEED = 11
_BITS = 12


class Grams(dict):
    """Word to hashes of itself and of its shape, remembered up to a bound."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= 200_000:
            self.clear()
        shape: list[str] = []
        for c in word:
            kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c
            if not shape or shape[-1] != kind:
                shape.append(kind)
        value = self[word] = (
            xxhash.xxh3_64_intdigest(word.lower().encode("utf-8", "replace")),
            xxhash.xxh3_64_intdigest("".join(shape).encode("utf-8", "replace")),
        )
        return value


def _buckets(h: np.ndarray, offset: int) -> np.ndarray:
    """Buckets of single hashes and of neighbouring pairs."""
    pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    both = np.concatenate((h, pair ^ (pair >> np.uint64(31)))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (both >> np.uint64(64 - 13)).astype(np.int64) + offset


def gram_buckets(known: Grams, text: str | None) -> np.ndarray:
    words = (text or "").split()
    if not words:
        return np.zeros(0, dtype=np.int64)
    hashes = np.array([known[w] for w in words], dtype=np.uint64)
    return np.concatenate((_buckets(hashes[:, 0], 0), _buckets(hashes[:, 1], BUCKETS // 2)))


def _counts(batches):
    """(text) batches to one count a bucket and task."""
    known, total = Grams(), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total += np.bincount(gram_buckets(known, text), minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


def gram_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all buckets over all rows of a table with one text column; a fixed number of buckets
    reaches the driver."""
    ship_package(texts.sparkSession)
    found = texts.mapInArrow(_counts, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def target_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of a bounded sample of the documents labelled good."""
    good = labels.where(col("quality") == 1).select(col("doc_id").alias("doc_id")).where("doc_id is not null").distinct()
    share = min(1.0, TARGET_ROWS / max(1, good.count()))
    picked = good.where(F.pmod(F.xxhash64(F.lit("target"), "doc_id"), F.lit(1 << 20)) <= int(share * (1 << 20)))
    # At most about TARGET_ROWS numbers, whatever the table holds.
    return documents.select(col("doc_id").alias("doc_id"), col("text").alias("text")).join(F.broadcast(picked), "doc_id").select("text")


def ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target over raw probability of each bucket; the raw model stands in where the target
    has seen little. Words and shapes are models of their own."""
    out = np.zeros(BUCKETS)
    for half in (slice(0, BUCKETS // 2), slice(BUCKETS // 2, BUCKETS)):
        q = (raw[half] + 0.01) / (raw[half] + 0.01).sum()
        mass = target[half].sum()
        if mass:
            p = (target[half] + 100 * q) / (mass + 100)
            out[half] = np.log(p / q)
    return out


def weigh(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``log_weight`` and its sum with Gumbel noise, ``gumbel``."""
    raw = gram_counts(documents.select(col("text").alias("text")))
    target = gram_counts(target_rows(documents, labels))
    sent = documents.sparkSession.sparkContext.broadcast(ratios(target, raw))

    def make():
        known, table = Grams(), sent.value

        def run(text):
            at = gram_buckets(known, text)
            if not len(at):
                return 0, 0.0
            # Words and shapes carry two grams a place less one each.
            return len(at), float(table[at].mean() * 2 * min(len(at) / 2, MAX_GRAMS))

        return run

    found = per_text(make, "struct<n: bigint, weight: double>")
    text = F.coalesce(col("text"), F.lit(""))
    noise = (F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id"), text), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return documents.select(
        col("doc_id").alias("doc_id"), found(col("text")).alias("r"), (-F.log(-F.log(noise))).alias("noise")
    ).select("doc_id", F.col("r.n").alias("n_grams"), F.col("r.weight").alias("log_weight"), (F.col("r.weight") + F.col("noise")).alias("gumbel"))


def sortable(value):
    """A 64-bit integer that orders as the double does: its bits, turned round below zero. The double is
    rounded to 2^-20, which a long holds."""
    return (F.round(value * (1 << 20)).cast("bigint") + F.lit(1 << 46)).cast("bigint")


def top_cut(rows: DataFrame, key: str, k: int) -> tuple[int, int]:
    """The k-th largest value of a 48-bit key and how many rows with that very value are among the k."""
    prefix, left, shift = 0, k, 48
    while shift:
        shift -= _BITS
        digit = F.shiftright(F.col(key), shift)
        found = (
            rows.where(F.shiftright(F.col(key), shift + _BITS) == prefix).groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"))
        )
        for digit_value, n in sorted(((r.digit, r.n) for r in found.collect()), reverse=True):  # 4,096 at most
            if n >= left:
                prefix = digit_value
                break
            left -= n
    return prefix, left


def resample(documents: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per document: importance, noisy sum, and whether it is selected (``kept``)."""
    rows = written(weigh(documents, labels).withColumn("key", sortable(F.col("gumbel"))), "weights")
    total = rows.count()
    k = math.ceil(total * share)
    cut, ties = top_cut(rows, "key", k) if k else (1 << 48, 0)
    # Only rows at the cut itself are ranked: those whose sums agree in 2^-20.
    at_cut = rows.where(F.col("key") == cut).withColumn("place", F.row_number().over(W.partitionBy("key").orderBy("doc_id")))
    others = rows.where(F.col("key") != cut).withColumn("place", F.lit(None).cast("int"))
    return others.unionByName(at_cut).select(
        "doc_id",
        "n_grams",
        F.round("log_weight", 6).alias("log_weight"),
        F.round("gumbel", 6).alias("gumbel"),
        ((F.col("key") > cut) | F.coalesce(F.col("place") <= ties, F.lit(False))).alias("kept"),
    )

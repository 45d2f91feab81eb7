"""Language identification by Bayesian fusion of text, declared language, address and host.

Text: character trigrams, hashed, under one multinomial model a language, learned from distinct texts
that declare it: all of them, or about ``SAMPLE`` by hash where there are more. Every declared language
with ``MIN_TEXTS`` distinct texts has a model, and in small tables also one with ``MIN_SHARE`` of them;
a model takes 64 KB, so the models of a thousand languages 64 MB. A further model ``und`` spreads its
mass evenly and takes what fits no language. Grams aren't independent, so a text's likelihood is its
mean a gram times at most ``MAX_GRAMS`` grams.

The other evidence is counted over all rows by grouped aggregation of the text's posteriors: how
often a declared language (the markup's, or a column) and an address suffix occur with each language,
and how the languages are spread over hosts. The host's spread is smoothed towards that of its
registered domain, and this towards that of the whole table; a row's own share is taken out of its
host's counts, so it isn't its own witness. All logarithms are added up.

A row is kept if its best language isn't ``und``, holds more than half of the posterior, and its
text has a letter. Where a text fits no model and its declared language has none, the declaration
stands: nothing speaks against it, and the row is kept under that language. Null text is empty, null evidence is none; equal rows get equal results; an empty
table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, col, fresh, let, per_text, ship_package, text_digest, written

BUCKETS = 1 << 14
SAMPLE = 5_000  # distinct texts a language
MIN_TEXTS = 50  # distinct texts, for a language to have a model whatever its share
MIN_SHARE = 0.005  # of the distinct texts, for a language with fewer
MAX_GRAMS = 40
OTHER = "und"
OTHER_PRIOR = 0.01
STRENGTH = 10.0  # rows that a parent's spread weighs
_BLOCK = 1 << 18

_WORD = re.compile(r"[^\W\d_]+")


def gram_buckets(text: str | None) -> np.ndarray:
    """Buckets of the trigrams of a text's lower-case words, each between blanks."""
    words = " ".join(_WORD.findall((text or "").lower()))
    if not words:
        return np.zeros(0, dtype=np.int64)
    c = np.frombuffer(f" {words} ".encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(50)).astype(np.int64)


def _gram_counts(batches):
    """(lang, text) batches to counts of (lang, bucket)."""
    for batch in batches:
        counts: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in counts:
                counts[lang] = np.zeros(BUCKETS, dtype=np.int64)
            counts[lang] += np.bincount(gram_buckets(text), minlength=BUCKETS)
        out = [(lang, int(b), int(n[b])) for lang, n in counts.items() for b in np.flatnonzero(n)]
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64()), strict=True)],
                ["lang", "bucket", "n"],
            )


class TextModel:
    """Languages, ``und`` last, and the log-probability of each bucket in each of them."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages = languages
        self.table = table

    def log_likelihood(self, text: str | None) -> tuple[int, list[float]]:
        grams = gram_buckets(text)
        total = np.zeros(len(self.languages))
        for lo in range(0, len(grams), _BLOCK):
            total += self.table[grams[lo : lo + _BLOCK]].sum(axis=0, dtype=np.float64)
        n = len(grams)
        return n, (total / max(1, n) * min(n, MAX_GRAMS)).tolist()


def learn(df: DataFrame, text: str, declared: str) -> TextModel:
    """Trigram models of the declared languages, each from a bounded sample of its distinct texts."""
    spark = df.sparkSession
    ship_package(spark)
    rows = df.where(col(declared).isNotNull()).select(
        F.lower(col(declared)).alias("lang"), col(text).alias("text"), text_digest(col(text)).alias("tdig")
    )
    each = written(rows.select("lang", "tdig").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    whole = each.agg(F.sum("n")).first()[0] or 0
    sizes = {r.lang: r.n for r in each.where(F.col("n") >= min(MIN_TEXTS, MIN_SHARE * whole)).collect() if r.lang != OTHER}
    languages = sorted(sizes)
    shares = spark.createDataFrame([(x, int(min(1.0, SAMPLE / n) * (1 << 20))) for x, n in sizes.items()], "lang string, share bigint")
    sample = (
        rows.join(F.broadcast(shares), "lang")
        .where(F.pmod(F.xxhash64(F.lit("language"), "tdig"), F.lit(1 << 20)) <= F.col("share"))
        .groupBy("lang", "tdig")
        .agg(F.first("text").alias("text"))
        .select("lang", "text")
    )
    counts = sample.mapInArrow(_gram_counts, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = np.full((BUCKETS, len(languages) + 1), 0.2)
    if languages:
        place = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")).cast("int") - 1
        found = counts.select("bucket", place.alias("place"), "n").toArrow()
        np.add.at(table, (found["bucket"].to_numpy(), found["place"].to_numpy()), found["n"].to_numpy())
    table[:, -1] = 1.0
    return TextModel([*languages, OTHER], np.log(table / table.sum(axis=0)).astype(np.float32))


def markup_language(html: Column) -> Column:
    """The language that a page's html element declares; null without one."""
    lang = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    return F.when(lang != "", lang)


def page_text(html: Column) -> Column:
    """A page's text: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&[a-zA-Z#0-9]+;", " ")


def host(url: Column) -> Column:
    name = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(name != "", name)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _softmax(logs: Column) -> Column:
    odds = lambda a: F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return let(logs, lambda a: let(odds(a), lambda e: F.transform(e, lambda v: v / _total(e))))


def _spread(rows: DataFrame, key: str, size: int, name: str) -> DataFrame:
    """Sum of posteriors by language for every value of ``key``, as an array."""
    sums = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(F.col("post")[i]).alias(f"s{i}") for i in range(size)])
    return sums.select(F.col(key), F.array(*[F.col(f"s{i}") for i in range(size)]).alias(name))


def fuse(rows: DataFrame, size: int) -> DataFrame:
    """Posterior ``fused`` of rows with ``n``, ``logs`` (text), ``declared``, ``host``."""
    part = F.element_at(F.split("host", r"\."), -1)
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    rows = written(
        rows.withColumn("suffix", F.when(F.instr("host", ".") > 0, part))
        .withColumn("domain", F.when(domain != "", domain))
        .withColumn("post", F.when(F.col("n") > 0, _softmax(F.col("logs"))).otherwise(F.array(*[F.lit(0.0)] * size))),
        "language",
    )
    total = rows.agg(*[F.coalesce(F.sum(F.col("post")[i]), F.lit(0.0)).alias(f"s{i}") for i in range(size)]).first()
    mass = sum(total) + size
    overall = F.array(*[F.lit(OTHER_PRIOR if i == size - 1 else (s + 1) / mass) for i, s in enumerate(total)])
    totals = F.array(*[F.lit(float(s)) for s in total])

    out = rows
    for key, name in (("host", "by_host"), ("domain", "by_domain"), ("suffix", "by_suffix"), ("declared", "by_declared")):
        out = out.join(bounded(written(_spread(rows, key, size, name), name), 8 * size + 64), key, "left")
    none = F.array(*[F.lit(0.0)] * size)
    got = lambda name: F.coalesce(F.col(name), none)
    each = F.sequence(F.lit(0), F.lit(size - 1))

    def smooth(counts: Column, own: Column, parent: Column) -> Column:
        """(count without the row + STRENGTH * parent's share) / (rows + STRENGTH), by language."""
        left = F.transform(counts, lambda x, i: F.greatest(x - own[i], F.lit(0.0)))
        return let(left, lambda c: F.transform(c, lambda x, i: (x + STRENGTH * parent[i]) / (_total(c) + STRENGTH)))

    # Without an address the parent's spread is passed on.
    own = lambda name: F.when(F.col(name).isNotNull(), F.col("post")).otherwise(none)
    out = out.withColumn("at_domain", smooth(got("by_domain"), own("by_domain"), overall))
    out = out.withColumn("at_host", smooth(got("by_host"), own("by_host"), F.col("at_domain")))

    def evidence(name: str, kinds: int) -> Column:
        """log P(value | language), smoothed; 0 where the row has no such evidence."""
        seen = F.transform(
            each, lambda i: F.log((F.greatest(F.col(name)[i] - F.col("post")[i], F.lit(0.0)) + 0.5) / (totals[i] + 0.5 * kinds))
        )
        return F.when(F.col(name).isNotNull(), seen).otherwise(none)

    out = out.withColumn("e_suffix", evidence("by_suffix", 50)).withColumn("e_declared", evidence("by_declared", 50))
    logs = F.transform(
        each,
        lambda i: F.col("logs")[i] + F.log(F.col("at_host")[i]) + F.col("e_suffix")[i] + F.col("e_declared")[i],
    )
    return out.withColumn("fused", _softmax(logs))


def identify(df: DataFrame, model: TextModel, ids: list[str], text: str, declared: str | None, at: Column | None) -> DataFrame:
    """``ids``, ``lang_id``, ``posterior``, ``n_grams`` and ``kept`` of every row."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    score = per_text(lambda: sent.value.log_likelihood, "struct<n: bigint, logs: array<double>>")
    rows = df.select(
        *[col(c).alias(f"id_{i}") for i, c in enumerate(ids)],
        score(col(text)).alias("t"),
        (F.lower(col(declared).cast("string")) if declared else F.lit(None).cast("string")).alias("declared"),
        (at if at is not None else F.lit(None).cast("string")).alias("host"),
    ).select("*", "t.n", "t.logs").drop("t")
    names = F.array(*[F.lit(x) for x in model.languages])
    best = F.array_max("fused")
    fitting = names[F.array_position("fused", best).cast("int") - 1]
    alone = F.coalesce((fitting == OTHER) & ~F.array_contains(names, F.col("declared")) & (F.col("declared") != "") & (F.col("n") > 0), F.lit(False))
    return (
        fuse(rows, len(model.languages))
        .withColumn("alone", alone)
        .withColumn("lang_id", F.when(F.col("alone"), F.col("declared")).otherwise(fitting))
        .select(
            *[F.col(f"id_{i}").alias(c) for i, c in enumerate(ids)],
            "lang_id",
            F.round(best, 6).alias("posterior"),
            F.col("n").alias("n_grams"),
            (F.col("alone") | ((F.col("lang_id") != OTHER) & (best > 0.5) & (F.col("n") > 0))).alias("kept"),
        )
    )


def identify_documents(df: DataFrame) -> DataFrame:
    """Language of every document from its text, its declared language and its source as the host."""
    return identify(df, learn(df, "text", "lang"), ["doc_id"], "text", "lang", F.lower(col("source").cast("string")))


def identify_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Language of every page from its text, markup and address; the text models come from documents."""
    model = learn(documents, "text", "lang")
    rows = pages.select(col("page_id"), page_text(col("html")).alias("text"), markup_language(col("html")).alias("declared"), col("url"))
    return identify(rows, model, ["page_id"], "text", "declared", host(F.col("url")))


def keep_identified(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that identification keeps, with its columns. The verdict follows from text,
    lang and source alone, so equal rows share one."""
    (key,) = fresh(df, "key")
    mark = F.md5(F.concat_ws("\x01", F.coalesce(F.md5(col("text")), F.lit("-")), F.coalesce(F.concat(F.lit("="), col("lang")), F.lit("-")), F.coalesce(F.concat(F.lit("="), col("source")), F.lit("-"))))
    keyed = df.withColumn(key, mark)
    found = identify(
        keyed.select(col(key), col("text"), col("lang"), col("source")),
        learn(df, "text", "lang"), [key], "text", "lang", F.lower(col("source").cast("string")),
    )
    return keyed.join(found.where(~F.col("kept")).select(key).distinct(), key, "left_anti").drop(key)

"""Quality rules by distribution divergence.

Every document becomes two histograms: characters by class, and words by common function word (all
others in one bin). The pooled histograms of the documents of a language, from a grouped
aggregation over the whole table, are that language's references. A document fails when the
Jensen-Shannon distance (base 2, between 0 and 1) of either histogram to its language's reference
is over its limit. Distances of short documents are noise, so each has a minimum length below which
it isn't tried. Fixed base rules come first: too few words, or too many words in repeated windows.

DataFrame functions only. The per-document counts are made in one pass and written to the shared
folder without the text; references and verdicts read that narrow table. The references are one
row a language, broadcast while their counted size allows it.

Null text is empty: no words, so the base rules reject it. A null language is a language of its
own. Extra columns are not read. Windows are compared by 64-bit hashes of their eight words within
one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, col, let, written

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
MIN_CHARS_FOR_CLASSES = 200
MIN_WORDS_FOR_COMMON = 80
MAX_CLASS_DISTANCE = 0.28
MAX_COMMON_DISTANCE = 0.40

# Common function words of the languages met, lower case.
COMMON_WORDS = (
    "a", "al", "an", "and", "are", "as", "at", "au", "auf", "be", "by", "con", "da", "das", "de", "del", "dem", "den",
    "der", "des", "die", "du", "ein", "eine", "el", "elle", "en", "es", "est", "esta", "et", "for", "from", "für", "he",
    "il", "ils", "in", "ist", "it", "la", "las", "le", "les", "lo", "los", "mit", "nicht", "no", "not", "of", "on", "or",
    "par", "para", "pas", "por", "pour", "que", "qui", "se", "sich", "sie", "su", "that", "the", "this", "to", "un",
    "und", "une", "von", "was", "with", "y", "zu",
)
BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
# Each class is what its pattern takes out of what the ones before left; the rest is the last one.
CLASSES = (
    ("lower", "[a-z]+"),
    ("blank", BLANKS),
    ("upper", "[A-Z]+"),
    ("symbol", SYMBOLS),
    ("digit", "[0-9]+"),
    ("ascii", r"[\x00-\x7F]+"),
)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur at least twice in the same list of words."""

    def spread(hashes: Column) -> Column:
        def twins(rows: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(rows, i)["h"] == F.get(rows, j)["h"], F.lit(False))
            return F.filter(rows, lambda _, i: same(i, i - 1) | same(i, i + 1))

        rows = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = F.array_sort(F.transform(let(rows, twins), lambda r: r["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            places,
            start,
            lambda acc, p: F.struct(
                (acc["n"] + p + window - F.greatest(p, acc["end"])).alias("n"), (p + window).alias("end")
            ),
        )["n"]

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - window + 1), lambda i: F.xxhash64(F.slice(w, i, window)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(spread(h)))

    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(words, counted)).cast("bigint")


def _histogram(words: Column) -> Column:
    """Map from common word to its count in a list of words."""

    def runs(ordered: Column) -> Column:
        def counts(kinds: Column) -> Column:
            first = F.transform(kinds, lambda k: F.array_position(ordered, k))
            return let(
                first,
                lambda at: F.map_from_arrays(
                    kinds,
                    F.transform(at, lambda a, i: F.coalesce(F.get(at, i + 1), F.size(ordered).cast("bigint") + 1) - a),
                ),
            )

        return let(F.array_distinct(ordered), counts)

    known = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(*COMMON_WORDS))
    return let(F.sort_array(known), runs)


def document_counts(df: DataFrame) -> DataFrame:
    """Per document: base counts, characters by class, common words; no text."""
    rows = df.select(col("doc_id").alias("doc_id"), col("lang").alias("lang"), F.coalesce(col("text"), F.lit("")).alias("rest"))
    lines = F.filter(F.split("rest", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = (
        rows.withColumn("words", F.array_remove(F.split("rest", BLANKS), ""))
        .withColumn("lines", lines)
        .withColumn("left", F.length("rest"))
    )
    rows = rows.select(
        "doc_id",
        "lang",
        "rest",
        "left",
        F.size("words").cast("bigint").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        _histogram(F.col("words")).alias("common"),
    )
    for name, pattern in CLASSES:
        rows = (
            rows.withColumn("rest", F.regexp_replace("rest", pattern, ""))
            .withColumn(name, (F.col("left") - F.length("rest")).cast("bigint"))
            .withColumn("left", F.length("rest"))
        )
    return rows.withColumn("other", F.col("left").cast("bigint")).drop("rest", "left")


def references(counts: DataFrame) -> DataFrame:
    """One row a language: pooled shares of classes and of common words."""
    names = [*(n for n, _ in CLASSES), "other"]
    sums = counts.groupBy("lang").agg(*[F.sum(n).alias(n) for n in names], F.sum("n_words").alias("n_words"))
    chars = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    words = (
        counts.select("lang", F.explode("common").alias("word", "n"))
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "n")))).alias("ref_common"))
    )
    return (
        sums.select(
            F.col("lang").alias("ref_lang"),
            F.array(*[F.col(n) / F.greatest(chars, F.lit(1)) for n in names]).alias("ref_classes"),
            F.greatest(F.col("n_words"), F.lit(1)).alias("ref_words"),
        )
        .join(words.withColumnRenamed("lang", "word_lang"), F.col("ref_lang").eqNullSafe(F.col("word_lang")), "left")
        .drop("word_lang")
    )


def _part(p: Column, q: Column) -> Column:
    """A bin's part of the Jensen-Shannon divergence in bits."""
    half = lambda a: F.when(a > 0, a / 2 * F.log2(2 * a / (p + q))).otherwise(0.0)
    return half(p) + half(q)


def _distance(divergence: Column) -> Column:
    return F.sqrt(F.greatest(divergence, F.lit(0.0)))


def class_distance() -> Column:
    names = [*(n for n, _ in CLASSES), "other"]
    chars = F.greatest(sum((F.col(n) for n in names[1:]), F.col(names[0])), F.lit(1))
    return _distance(sum((_part(F.col(n) / chars, F.col("ref_classes")[i]) for i, n in enumerate(names[1:], 1)),
                         _part(F.col(names[0]) / chars, F.col("ref_classes")[0])))


def common_distance() -> Column:
    """Bins that a document lacks add half the reference's share each; so only its own are visited."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    ref = F.coalesce(F.col("ref_common"), F.create_map().cast("map<string,bigint>"))
    share = lambda k: F.coalesce(ref[k], F.lit(0)) / F.col("ref_words")
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    entries = F.map_entries("common")
    seen = total(F.transform(entries, lambda e: share(e["key"])))
    inside = total(F.transform(entries, lambda e: _part(e["value"] / words, share(e["key"]))))
    ours = total(F.transform(entries, lambda e: e["value"] / words))
    all_ref = total(F.transform(F.map_values(ref), lambda v: v / F.col("ref_words")))
    return _distance(inside + (all_ref - seen) / 2 + _part(F.greatest(1 - ours, F.lit(0.0)), F.greatest(1 - all_ref, F.lit(0.0))))


def judge(df: DataFrame) -> DataFrame:
    """One row per document with the base counts, both distances and the verdict ``kept``."""
    counts = written(document_counts(df), "divergence")
    # A reference holds a share for each common word at most.
    refs = bounded(written(references(counts), "references"), 64 * len(COMMON_WORDS))
    rows = counts.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    chars = F.col("n_chars")
    return (
        rows.withColumn("n_chars", sum((F.col(n) for n, _ in CLASSES[1:]), F.col("lower")) + F.col("other"))
        .withColumn("class_distance", F.when(chars >= MIN_CHARS_FOR_CLASSES, class_distance()))
        .withColumn("common_distance", F.when(F.col("n_words") >= MIN_WORDS_FOR_COMMON, common_distance()))
        .withColumn("base_failed", failed)
        .select(
            "doc_id",
            "n_words",
            (chars - F.col("blank")).alias("word_chars"),
            F.col("symbol").alias("n_symbols"),
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            (
                ~F.col("base_failed")
                & (F.coalesce("class_distance", F.lit(0.0)) <= MAX_CLASS_DISTANCE)
                & (F.coalesce("common_distance", F.lit(0.0)) <= MAX_COMMON_DISTANCE)
            ).alias("kept"),
            F.round("class_distance", 6).alias("class_distance"),
            F.round("common_distance", 6).alias("common_distance"),
        )
    )


def _sql() -> str:
    names = [*(n for n, _ in CLASSES), "other"]
    words = ", ".join(f"'{w}'" for w in COMMON_WORDS)
    part = lambda p, q: (
        f"(case when ({p}) > 0 then ({p}) / 2 * log2(2 * ({p}) / (({p}) + ({q}))) else 0 end"
        f" + case when ({q}) > 0 then ({q}) / 2 * log2(2 * ({q}) / (({p}) + ({q}))) else 0 end)"
    )
    classes = " + ".join(part(f"c.{n} / greatest(c.n_chars, 1)", f"r.{n} / greatest(r.n_chars, 1)") for n in names)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    length(t) AS n_chars,
    length(regexp_replace(t, '[^a-z]', '', 'g')) AS lower, length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS blank,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS symbol,
    length(regexp_replace(t, '[^0-9]', '', 'g')) AS digit, length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS other
  FROM d
), c AS (
  SELECT *, n_chars - lower - blank - upper - symbol - digit - other AS ascii, len(w) AS n_words,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines
  FROM w
), win AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS p
  FROM (SELECT rid, w, unnest(generate_series(1, n_words - 7)) AS i FROM c WHERE n_words >= 8)
), twin AS (
  SELECT rid, p FROM win GROUP BY rid, p HAVING count(*) > 1
), rep AS (
  SELECT rid, count(DISTINCT place) AS n_repeat_words
  FROM (SELECT rid, unnest(generate_series(i, i + 7)) AS place FROM win JOIN twin USING (rid, p)) GROUP BY rid
), common AS (
  SELECT rid, word, count(*) AS n FROM (SELECT rid, lower(unnest(w)) AS word FROM c) WHERE word IN ({words}) GROUP BY rid, word
), r AS (
  SELECT lang, sum(n_words) AS n_words, sum(n_chars) AS n_chars, {", ".join(f"sum({n}) AS {n}" for n in names)} FROM c GROUP BY lang
), rw AS (
  SELECT c.lang, word, sum(n) / max(greatest(r.n_words, 1)) AS q
  FROM common JOIN c USING (rid) JOIN r ON r.lang IS NOT DISTINCT FROM c.lang GROUP BY c.lang, word
), total AS (SELECT lang, sum(q) AS all_q FROM rw GROUP BY lang
), js AS (
  SELECT rid, sum({part("common.n / greatest(c.n_words, 1)", "rw.q")}) AS inside, sum(rw.q) AS seen,
    sum(common.n / greatest(c.n_words, 1)) AS ours
  FROM common JOIN c USING (rid) JOIN rw ON rw.word = common.word AND rw.lang IS NOT DISTINCT FROM c.lang GROUP BY rid
), e AS (
  SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
    case when c.n_chars >= {MIN_CHARS_FOR_CLASSES} then sqrt(greatest({classes}, 0)) end AS class_distance,
    case when c.n_words >= {MIN_WORDS_FOR_COMMON} then sqrt(greatest(coalesce(inside, 0)
      + (coalesce(all_q, 0) - coalesce(seen, 0)) / 2
      + {part("greatest(1 - coalesce(ours, 0), 0)", "greatest(1 - coalesce(all_q, 0), 0)")}, 0)) end AS common_distance
  FROM c JOIN r ON r.lang IS NOT DISTINCT FROM c.lang LEFT JOIN total ON total.lang IS NOT DISTINCT FROM c.lang
    LEFT JOIN rep USING (rid) LEFT JOIN js USING (rid)
), f AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM e
)
SELECT doc_id, n_words, n_chars - blank AS word_chars, symbol AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(class_distance, 0) <= {MAX_CLASS_DISTANCE}
    AND coalesce(common_distance, 0) <= {MAX_COMMON_DISTANCE} AS kept,
  round(class_distance, 6) AS class_distance, round(common_distance, 6) AS common_distance
FROM f
"""


SQL = _sql()

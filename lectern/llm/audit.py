"""Audit of how far the sources of a language diverge, by hash-consed segment trees.

Every (language, source) group has counts of the language's kept terms. A segment tree over term ids
holds them: a leaf is a count, an inner node the pair of its halves, and equal subtrees are one node,
whatever group they come from. Two groups are compared by walking their trees together; the price
of a pair of nodes (the summed difference of the terms below) is worked out once and remembered,
so the long empty or equal stretches of two trees cost one visit for each size.

The top of the tree is cut into segments of some thousand terms, dealt out by a hash of the term;
within one, ids fall with document frequency, which puts rare terms, mostly absent, side by side. A
task holds one segment for two blocks of groups, and prices of segments are added up. So neither a
language with many terms nor one with many sources meets in one task, and every pair of sources is
priced, since each is a row of the result.

Null text, language and source are empty strings. A group without terms has a count of 0 for every
term; a language without kept terms has distances 0 and no term rows. Repeated rows count as often
as they occur; texts of any length are read whole, one row at a time. An empty table gives no
rows. Extra columns are not read. Counts are integers and
products are decimals or Python integers, so nothing is rounded.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded, col, ship_package, written

MIN_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
SEGMENT = 4096
BLOCK = 32
HELD_TERMS = 500_000

# Bytes of terms (letters, and everything beyond ASCII), A-Z in lower case.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

_ROWS = "lang string, source string, term binary, n bigint, docs bigint"


def _term_counts(batches):
    """Occurrences and documents of each term by group, over a bounded number of terms at a time; a row
    with a null term says that the group occurs."""
    held: dict[tuple, list[Counter]] = {}
    size = 0

    def flush():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (len(terms) + 1), pa.string()),
                    pa.array([source] * (len(terms) + 1), pa.string()),
                    pa.array([None, *terms], pa.binary()),
                    pa.array([0, *[n[t] for t in terms]], pa.int64()),
                    pa.array([0, *[docs[t] for t in terms]], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            n, docs = held.setdefault((lang, source), [Counter(), Counter()])
            before = len(n)
            terms = text.translate(_TERM_BYTES).split()
            n.update(terms)
            docs.update(set(terms))
            size += len(n) - before
        if size >= HELD_TERMS:
            yield from flush()
            held, size = {}, 0
    yield from flush()


def share(n: Column, total: Column, kept: Column) -> Column:
    """Smoothed share of a term in billionths, from 1."""
    exact = lambda c: c.cast("decimal(20,0)")
    below = exact(total) + F.lit(SMOOTHING).cast("decimal(2,0)") * exact(kept).cast("decimal(16,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * (exact(n) + F.lit(SMOOTHING))
    return F.call_function("div", above, below) + 1


class Forest:
    """Segment trees of one segment; equal subtrees of one size are one node."""

    def __init__(self, size: int):
        self.width = 1
        while self.width < size:
            self.width *= 2
        self.size = size
        self.nodes: dict[tuple, int] = {}
        self.parts: list[tuple] = []
        self._empty: dict[tuple[int, int], int] = {}

    def _node(self, key: tuple) -> int:
        found = self.nodes.get(key)
        if found is None:
            found = self.nodes[key] = len(self.parts)
            self.parts.append(key)
        return found

    def _blank(self, lo: int, width: int) -> int:
        """Tree without occurrences over ids from ``lo``; beyond the last id there are no terms."""
        inside = max(0, min(width, self.size - lo))
        node = self._empty.get((width, inside))
        if node is None:
            if width == 1:
                node = self._node((0,) if inside else ())
            else:
                half = width // 2
                node = self._node((self._blank(lo, half), self._blank(lo + half, half)))
            self._empty[width, inside] = node
        return node

    def tree(self, counts: list[tuple[int, int]], lo: int = 0, width: int | None = None) -> int:
        """Root of the tree of (id, count) pairs, ordered by id."""
        width = self.width if width is None else width
        if not counts:
            return self._blank(lo, width)
        if width == 1:
            return self._node((counts[0][1],))
        half = width // 2
        cut = 0
        while cut < len(counts) and counts[cut][0] < lo + half:
            cut += 1
        return self._node((self.tree(counts[:cut], lo, half), self.tree(counts[cut:], lo + half, half)))

    def price(self, a: int, b: int, below_a: int, below_b: int, known: dict) -> int:
        """Sum of differences of shares of two trees, with the denominators of their groups. ``known`` remembers
        pairs of nodes for these two denominators."""
        if below_a == below_b and a == b:
            return 0
        found = known.get((a, b))
        if found is None:
            x, y = self.parts[a], self.parts[b]
            if len(x) == 2:
                found = self.price(x[0], y[0], below_a, below_b, known) + self.price(x[1], y[1], below_a, below_b, known)
            elif not x:
                found = 0
            else:
                found = abs(SCALE * (x[0] + SMOOTHING) // below_a - SCALE * (y[0] + SMOOTHING) // below_b)
            known[a, b] = found
        return found


_PRICES = "lang string, source string, other string, value bigint"


def _segment_prices(block: int):
    """Prices of one segment of a language between the groups of two blocks (or within one)."""

    def run(table: pa.Table) -> pa.Table:
        slots = table["slot"].to_numpy()
        heads = table.filter(pa.array(slots < 0)).sort_by("place").to_pylist()
        leaves = table.filter(pa.array(slots >= 0)).select(["place", "slot", "n"]).sort_by([("place", "ascending"), ("slot", "ascending")])
        place, slot, n = (leaves[c].to_numpy() for c in ("place", "slot", "n"))
        size = heads[0]["size"]
        forest = Forest(size)
        groups = []
        for r in heads:
            lo, hi = np.searchsorted(place, (r["place"], r["place"] + 1))
            root = forest.tree(list(zip(slot[lo:hi].tolist(), n[lo:hi].tolist(), strict=True))) if size else 0
            groups.append((r["place"] // block, r["source"], r["n"] + SMOOTHING * r["kept"], root))
        lang, low, high = (table[c][0].as_py() for c in ("lang", "low", "high"))
        known: dict[tuple[int, int], dict] = defaultdict(dict)
        found = []
        for i, (own, source, below, root) in enumerate(groups):
            for other_own, other, other_below, other_root in groups[i + 1 :]:
                if (own, other_own) != (low, high):
                    continue
                value = forest.price(root, other_root, below, other_below, known[below, other_below]) if size else 0
                found += [(source, other, value), (other, source, value)]
        parts = list(zip(*found, strict=True)) if found else [(), (), ()]
        return pa.table({
            "lang": pa.array([lang] * len(found), pa.string()),
            "source": pa.array(parts[0], pa.string()),
            "other": pa.array(parts[1], pa.string()),
            "value": pa.array(parts[2], pa.int64()),
        })

    return run


def audit(documents: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP_TERMS, segment: int = SEGMENT, block: int = BLOCK) -> DataFrame:
    """Distances between all sources of a language, and the terms that stick out in each source."""
    ship_package(documents.sparkSession)
    empty = F.lit("")
    texts = documents.select(
        F.coalesce(col("lang").cast("string"), empty).alias("lang"),
        F.coalesce(col("source").cast("string"), empty).alias("source"),
        F.coalesce(col("text"), empty).cast("binary").alias("text"),
    )
    counts = written(
        texts.mapInArrow(_term_counts, _ROWS)
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
        "audit-counts",
    )
    seen = counts.where("term is not null")
    kept = written(
        seen.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= least),
        "audit-kept",
    )

    # A language's terms in segments; their number and places follow from the terms alone.
    vocabulary = written(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")), "audit-languages")
    within = W.partitionBy("lang", "segment").orderBy(F.desc("docs"), "term")
    terms = written(
        kept.join(bounded(vocabulary, 100), "lang")
        .withColumn("segments", F.ceil(F.col("kept") / segment).cast("int"))
        .withColumn("segment", F.pmod(F.xxhash64("term"), F.col("segments")).cast("int"))
        .withColumn("slot", F.row_number().over(within) - 1),
        "audit-terms",
    )
    placed = written(
        seen.select("lang", "source", "term", "n").join(terms.drop("docs"), ["lang", "term"]), "audit-placed"
    )
    totals = placed.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sources = W.partitionBy("lang").orderBy("source")
    groups = written(
        counts.where("term is null")
        .select("lang", "source")
        .join(totals, ["lang", "source"], "left")
        .join(vocabulary, "lang", "left")
        .select(
            "lang",
            "source",
            *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "kept", "lang_total")],
            (F.row_number().over(sources) - 1).alias("place"),
        ),
        "audit-groups",
    )
    pairs = _pair_rows(groups, placed, terms, segment, block)
    sticking = _term_rows(groups, placed, top)
    return pairs.unionByName(sticking).select("lang", "source", "part", "item", "value", "rank")


def _ranked(rows: DataFrame) -> DataFrame:
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _pair_rows(groups: DataFrame, placed: DataFrame, terms: DataFrame, segment: int, block: int) -> DataFrame:
    """Distance of each ordered pair of sources of a language."""
    blocks = groups.groupBy("lang").agg((F.floor(F.max("place") / block) + 1).cast("int").alias("blocks"))
    sizes = terms.groupBy("lang", "segment").agg(F.count("*").alias("size"))
    spread = groups.withColumn("segments", F.greatest(F.ceil(F.col("kept") / segment), F.lit(1)).cast("int"))
    heads = (
        spread.withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)))
        .join(sizes, ["lang", "segment"], "left")
        .select("lang", "segment", "place", "source", F.lit(-1).alias("slot"), F.col("total").alias("n"), "kept",
                F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))
    )
    leaves = placed.join(groups.select("lang", "source", "place"), ["lang", "source"]).select(
        "lang", "segment", "place", F.lit(None).cast("string").alias("source"), "slot", "n",
        F.lit(0).cast("bigint").alias("kept"), F.lit(0).cast("bigint").alias("size"),
    )
    own = F.floor(F.col("place") / block).cast("int")
    met = (
        heads.unionByName(leaves)
        .join(blocks, "lang")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least(own, F.col("other")))
        .withColumn("high", F.greatest(own, F.col("other")))
        .drop("blocks", "other")
    )
    priced = met.groupBy("lang", "segment", "low", "high").applyInArrow(_segment_prices(block), _PRICES)
    summed = priced.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    return _ranked(summed.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value"))


def _term_rows(groups: DataFrame, placed: DataFrame, top: int) -> DataFrame:
    """Terms that are more frequent in a source than in its language."""
    rows = placed.select("lang", "source", "term", "n", "lang_n").join(groups, ["lang", "source"])
    value = share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), value.alias("value"))
    return _ranked(rows.where("value > 0")).where(F.col("rank") <= top)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
s AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (cast(coalesce(c.n, 0) AS hugeint) + 5)) // (coalesce(total, 0) + 5 * v) AS p,
         1 + (1000000000 * (cast(k.lang_n AS hugeint) + 5)) // (lang_total + 5 * v) AS q
  FROM s JOIN kept k USING (lang) JOIN v USING (lang)
  LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
  LEFT JOIN total ON total.lang = s.lang AND total.source = s.source
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z
    ON z.lang = a.lang AND z.source = a.source AND z.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows
)
SELECT lang, source, part, item, cast(value AS bigint) AS value, cast(rank AS integer) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""

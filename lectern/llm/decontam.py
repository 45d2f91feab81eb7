"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The alphabet is words. Patterns are the benchmark's windows of ten words; an item with fewer words
is one pattern of its own length. A scan looks at the block of two words on which a window would
end: the shift table says how far the next possible end lies, a block that is in no pattern lets it
leap a whole window. Where the shift is 0, the block's bucket holds the patterns that end with it;
those whose first block agrees too are compared word by word. Patterns of another length have
tables of their own.

The benchmark is sent to the tasks in blocks of bounded size, whose number follows from its size, one
after the other; every document passes through all of them, and the spans they mark are united at the
end, by a digest of the text. Null and empty texts have no words, and an item without words marks
nothing. Items that share an id count once; a null id counts as the empty string. Repeated rows get equal
results; an empty table gives no rows, an empty benchmark no hits. Extra columns are left as they are.
"""

from __future__ import annotations

import math
from collections import defaultdict
from functools import reduce
from itertools import chain

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh, per_text, text_digest, words_of, written

WINDOW = 10
BLOCK_BYTES = 16 << 20


class _Tables:
    """Shift and bucket tables of the patterns of one length."""

    def __init__(self, patterns: dict[tuple[int, ...], set[str]], length: int, base: int):
        self.length, self.base = length, base
        self.pair = min(2, length)
        self.far = length - self.pair + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[int, list[tuple[list[int], set[str]]]]] = defaultdict(lambda: defaultdict(list))
        for p, items in patterns.items():
            for end in range(self.pair - 1, length):
                block = self._block(p, end)
                self.shift[block] = min(self.shift.get(block, self.far), length - 1 - end)
            self.buckets[self._block(p, length - 1)][self._block(p, self.pair - 1)].append((list(p), items))

    def _block(self, ids, end: int) -> int:
        return ids[end] if self.pair == 1 else ids[end - 1] * self.base + ids[end]

    def scan(self, ids: list[int]):
        """Start and item ids of every occurrence, in order."""
        n, length, base, far, pair = len(ids), self.length, self.base, self.far, self.pair
        shift, buckets = self.shift.get, self.buckets
        at = length - 1
        while at < n:
            last = ids[at]
            if not last:  # a word of no pattern: no window may hold it
                at += length
                continue
            block = last if pair == 1 else ids[at - 1] * base + last
            step = shift(block, far)
            if step:
                at += step
                continue
            start = at - length + 1
            first = ids[start] if pair == 1 else ids[start] * base + ids[start + 1]
            for p, items in buckets[block].get(first, ()):
                if ids[start : at + 1] == p:
                    yield start, items
                    break  # patterns of one length differ
            at += 1


class Matcher:
    """All patterns of some benchmark items, given as (item id, text)."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in words_of(text)]
            length = min(window, len(ids))
            if length:
                for i in range(len(ids) - length + 1):
                    by_length[length][tuple(ids[i : i + length])].add(item)
        self.tables = [_Tables(p, n, len(self.ids) + 1) for n, p in sorted(by_length.items())]

    def find(self, text: str | None) -> tuple[int, list[int], list[str]]:
        """Word count, flat list of the starts and ends of united spans, items that occur."""
        words = words_of(text)
        get = self.ids.get
        ids = [get(w, 0) for w in words]
        spans: list[int] = []
        found: set[str] = set()
        for table in self.tables:
            for start, items in table.scan(ids):
                found |= items
                if spans and spans[-2] <= start <= spans[-1]:
                    spans[-1] = max(spans[-1], start + table.length)
                else:
                    spans += (start, start + table.length)
        return len(words), spans, sorted(found)


def _blocks(benchmark: DataFrame, block_bytes: int):
    """The benchmark in parts of about ``block_bytes`` of text, one at a time on the driver."""
    items = benchmark.select(
        F.coalesce(col("item_id").cast("string"), F.lit("")).alias("item"), col("text").alias("text")
    )
    held = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.length("item") + 64)).first()[0] or 0
    parts = max(1, math.ceil(held / block_bytes))
    part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
    for k in range(parts):
        yield [tuple(r) for r in items.where(part == k).collect()]


def _search(df: DataFrame, items: list[tuple], text: str) -> tuple[Column, Broadcast]:
    sent = df.sparkSession.sparkContext.broadcast(items)
    found = per_text(lambda: Matcher(sent.value).find, "struct<n_words: bigint, spans: array<int>, items: array<string>>")
    return found(col(text)), sent


def with_hits(df: DataFrame, benchmark: DataFrame, out: str, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``df`` with a struct column ``out``: n_words, spans (flat, in words), items found.

    A benchmark of one block is searched as the rows pass by. Of several blocks a task holds one at a time:
    what a block finds is written, without the texts, before the next one is sent."""
    blocks = _blocks(benchmark, block_bytes)
    first = next(blocks)
    second = next(blocks, None)
    if second is None:
        return df.withColumn(out, _search(df, first, text)[0])
    key, spans, items, words = fresh(df, "key", "spans", "items", "words")
    parts = []
    for block in chain((first, second), blocks):
        hits, sent = _search(df, block, text)
        found = df.select(text_digest(col(text)).alias(key), hits.alias("r")).where(F.size("r.spans") > 0)
        # Equal texts have equal hits.
        parts.append(written(found.groupBy(key).agg(F.first("r.spans").alias(spans), F.first("r.items").alias(items)), "hits"))
        sent.unpersist()
    united = reduce(DataFrame.unionByName, parts).groupBy(key).agg(
        F.flatten(F.collect_list(spans)).alias(spans), F.array_distinct(F.flatten(F.collect_list(items))).alias(items)
    )
    count = per_text(lambda: lambda t: (len(words_of(t)),), "struct<n: bigint>")
    return (
        df.withColumn(key, text_digest(col(text)))
        .withColumn(words, count(col(text))["n"])
        .join(united, key, "left")
        .withColumn(
            out,
            F.struct(
                col(words).alias("n_words"),
                F.coalesce(col(spans), F.array().cast("array<int>")).alias("spans"),
                F.coalesce(col(items), F.array().cast("array<string>")).alias("items"),
            ),
        )
        .drop(key, spans, items, words)
    )


def decontaminate(df: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: words, words hit, items found and their digest."""
    found = with_hits(df.select(col("doc_id"), col("text")), benchmark, "hits", block_bytes=block_bytes)
    spans = F.array_sort(F.arrays_zip(
        F.filter("hits.spans", lambda _, i: i % 2 == 0).alias("a"), F.filter("hits.spans", lambda _, i: i % 2 == 1).alias("b")
    ))
    reach = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(s["a"], acc["end"]))).alias("n"),
            F.greatest(acc["end"], s["b"]).alias("end"),
        ),
    )
    return (
        found.withColumn("n_hit", reach["n"].cast("bigint"))
        .select(
            "doc_id",
            F.col("hits.n_words").alias("n_words"),
            "n_hit",
            F.size("hits.items").cast("bigint").alias("n_items"),
            F.sha2(F.array_join(F.array_sort("hits.items"), ",").cast("binary"), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def clean(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``df`` in which no benchmark window occurs, with its columns."""
    (out,) = fresh(df, "hits")
    return with_hits(df, benchmark, out).where(F.size(col(out)["items"]) == 0).drop(out)


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT cast(item_id AS varchar) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), pat AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
  FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), win AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS p
  FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
        FROM d, (SELECT DISTINCT n FROM pat) WHERE len(w) >= n)
), hit AS (SELECT rid, win.i, win.n, item FROM win JOIN pat USING (n, p)
), places AS (
  SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS place FROM hit) GROUP BY rid
), found AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid
)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit,
       cast(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN found USING (rid)
"""

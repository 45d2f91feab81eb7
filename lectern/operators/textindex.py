"""Contains-filters by an index of letter triples.

``ilike '%value%'`` reads every text. The index holds, for each triple of neighbouring letters of a text in lower
case, the ids whose text has it, sorted by triple; another small table says how many. A value's rarest
triples are looked up, which reads the row groups that hold these, their ids are intersected, and only the
rows that remain are tested with the exact ``ilike``. A text that contains the value has all its triples,
so nothing is lost. Values without three letters in a row between wildcards are tested on all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.filters import contains, like_text

GRAM = 3
# Triples of a value that are intersected, rarest first; the exact test does the rest.
ASKED = 8
ROW_GROUP_BYTES = 8 << 20
# Parts that the ids of one triple are cut into.
CUTS = 64


def triples(text: Column) -> Column:
    """Distinct triples of neighbouring letters, lower case; none for shorter texts and NULL."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.length(low) - (GRAM - 1))
    found = F.array_distinct(F.transform(places, lambda i: F.substr(low, i, F.lit(GRAM))))
    return F.when(F.length(low) >= GRAM, found).otherwise(F.array().cast("array<string>"))


def _place(gram: str) -> Column:
    """The letters of a triple as one number, in the order of the triples (21 bits hold any letter)."""
    at = [F.ascii(F.substr(F.col(gram), F.lit(k), F.lit(1))).cast("bigint") for k in range(1, GRAM + 1)]
    return reduce(lambda number, letter: F.shiftleft(number, 21) + letter, at)


def literal_pieces(value: str, raw: bool) -> list[str]:
    """The parts of a value that a match holds letter by letter: all of it, or what lies between wildcards."""
    pieces, escaped = [""], False
    for c in like_text(value, raw):
        if escaped:
            pieces[-1] += c
            escaped = False
        elif c == "\\":
            escaped = True
        elif c in "%_":
            pieces.append("")
        else:
            pieces[-1] += c
    return [p for p in pieces if len(p) >= GRAM]


class TextIndex:
    """Index of some text columns of a table, under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @classmethod
    def build(cls, df: DataFrame, key: str, texts: dict[str, Column], root: str) -> "TextIndex":
        """Index the columns ``texts`` of ``df`` by their names; ``key`` is the column of ids."""
        named = {f"text{k}": c for k, c in enumerate(texts.values())}
        # A table of ids and names is small beside its triples: dealt out, it fills all tasks, however few files it has.
        spread = df.select(F.col(key).alias("id"), *[F.lower(c).alias(n) for n, c in named.items()]).repartition("id")
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(c).alias("low")) for n, c in zip(texts, named, strict=True)]))
        low = spread.select("id", each.alias("t")).select("id", "t.field", "t.low").filter(F.length("low") >= GRAM)
        # A row a place, and of a triple that a text has more than once its first place.
        places = low.select("*", F.explode(F.sequence(F.lit(1), F.length("low") - (GRAM - 1))).alias("at"))
        rows = places.withColumn("gram", F.substr("low", "at", F.lit(GRAM))).filter(F.instr(F.col("low"), F.col("gram")) == F.col("at"))
        # Dealt out by hash: range partitions would need all triples made once more, to sample them. A triple of
        # many ids is cut by hash of the id, so it is spread over many tasks and files. One number, in the
        # order of the triples, is sorted much faster than texts.
        cut = F.pmod(F.xxhash64("id"), F.lit(CUTS))
        dealt = rows.select("field", "gram", "id").repartition("gram", "field", cut)
        dealt.sortWithinPartitions(_place("gram")).write.option("parquet.block.size", str(ROW_GROUP_BYTES)).option(
            "parquet.bloom.filter.enabled#gram", "true"
        ).parquet(f"{root}/ids")
        index = cls(df.sparkSession, root)
        counts = index._read("ids").groupBy("field", "gram").agg(F.count("*").alias("n"))
        counts.repartitionByRange("field", "gram").sortWithinPartitions("field", "gram").write.parquet(f"{root}/counts")
        return index

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def rarest(self, field: str, value: str, raw: bool = False) -> list[str] | None:
        """The rarest triples of a value, at most ``ASKED``; ``None`` if it has none to go by."""
        pieces = literal_pieces(value, raw)
        if not pieces:
            return None
        # The engine's own lower case, as ``ilike`` uses it.
        row = self.spark.range(1).select(F.array_distinct(F.flatten(F.array(*[triples(F.lit(p)) for p in pieces]))).alias("grams")).first()
        if not row.grams:
            return None
        known = self._read("counts").filter((F.col("field") == field) & F.col("gram").isin(row.grams))
        sizes = {r.gram: r.n for r in known.collect()}  # a row a triple of the value
        return sorted(row.grams, key=lambda g: (sizes.get(g, 0), g))[:ASKED]

    def candidates(self, field: str, value: str, raw: bool = False) -> DataFrame | None:
        """Ids whose text has all triples asked for, or ``None`` if the value has none."""
        grams = self.rarest(field, value, raw)
        if grams is None:
            return None
        found = self._read("ids").filter((F.col("field") == field) & F.col("gram").isin(grams))
        return found.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams)).select("id")

    def contains(self, df: DataFrame, key: str, columns: dict[str, Column], value: str, raw: bool = False) -> DataFrame:
        """Rows of ``df`` in which one of ``columns`` (by their names in the index) contains ``value``."""
        sets = [self.candidates(name, value, raw) for name in columns]
        test = F.lit(False)
        for column in columns.values():
            test = test | contains(column, value, raw)
        if any(s is None for s in sets):
            return df.filter(test)
        ids = sets[0]
        for more in sets[1:]:
            ids = ids.union(more)
        return df.join(ids.select(F.col("id").alias(key)), key, "left_semi").filter(test)

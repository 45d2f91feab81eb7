"""Phrase collocations by sorted count streams.

The layout is that of external language-model estimation: counts live in streams that are sorted and
merged, never in tables that are probed.

1. Tasks turn documents into runs: for every word its first two followers within the piece, counted
   over some millions of words and sorted.
2. The runs travel packed, in compressed blocks of many keys. Sampled keys cut all of them into parts of some
   hundred thousand keys, and a task merges one part at a time in prefix order. One pass adds up neighbours: a
   run of equal first words is that word's count, of equal first two words that pair's, and so on. A family
   that touches an edge of its part is emitted as a part and added up with those of the
   neighbouring parts; of the others only counts that reach the minimum go on, since no part of a
   candidate is rarer than the candidate.
3. Words, pairs and triples, in prefix order, go through one lockstep pass: it holds the word and the
   pair that a triple begins with, so it reads off the left counts, and gives each pair the count of its
   most frequent extension to the right.
4. The same stream in suffix order gives right counts, extensions to the left, and the scores.

Where a family is cut by the border of a partition, the rows it begins with are sent to the later
partitions as guests (at most two for each partition).

Null and empty texts have no words; a null language is ``und``. Repeated rows count as often as they
occur. An empty table gives no rows; extra columns are not read. Texts of any length are cut between
pieces, so memory follows the longest piece. Scores use Python's integers, without rounding.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, dropped, lean, ship_package, written

MIN_COUNT = 10
COVERED_PERCENT = 50
TOP = 2000
SCALE = 1_000_000
HELD_WORDS = 3_000_000
HELD_VOCABULARY = 500_000
HELD_BYTES = 64 << 20  # of text
WIDEST_VOCABULARY = 2_000_000  # its cube is under 2**63
SPREAD = 8
PART_KEYS = 250_000  # keys that a task merges at a time, about
PARTS_A_TASK = 8  # about
MARKS = 20  # sampled keys for each part
_SLICE = 50_000
_BLOCK_BYTES = 1 << 16  # small beside the pages of a Parquet file, which hold 100 rows at least
_TEXT_BLOCK = 1 << 22
_CODEC = pa.Codec("zstd", compression_level=1)

# Separators of pieces; the comma stands for all of them.
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x2C if b in _SEPARATORS else 0x20 if b == 9 else b for b in range(256))


def _closed(data: bytes) -> bytes:
    """Bytes compressed: engine and workers hold a block several times over on its way."""
    return len(data).to_bytes(8, "little") + _CODEC.compress(data, asbytes=True)


def _opened(data: bytes) -> bytes:
    return _CODEC.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _blocks(data: bytes, size: int):
    """A long text in parts that end between pieces."""
    start = 0
    while len(data) - start > size:
        cut = data.find(b",", start + size)
        if cut < 0:
            break
        yield data[start : cut + 1]
        start = cut + 1
    yield data[start:]


def _quoted(lang: str) -> bytes:
    """A language as the first word of a key."""
    return quote(lang, safe="").encode()


class _Vocabulary(dict):
    """Word to number; 0 is the break between pieces."""

    def __init__(self):
        self[b","] = 0

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class _Runs:
    """Words of a task, counted in sorted runs of bounded size."""

    def __init__(self, held: int = HELD_WORDS):
        self.most = held
        self.clear()

    def clear(self) -> None:
        self.words, self.parts, self.held, self.size = _Vocabulary(), {}, 0, 0

    def add(self, lang: str, block: bytes) -> None:
        words = self.words
        ids = [words[w] for w in block.replace(b",", b" , ").split()]
        ids.append(0)
        self.parts.setdefault(lang, []).append(np.array(ids, dtype=np.int32))
        self.held += len(ids) - 1
        self.size += len(block)

    def full(self) -> bool:
        return self.held >= self.most or len(self.words) >= HELD_VOCABULARY or self.size >= HELD_BYTES

    def flush(self):
        known, parts = pa.array(list(self.words), pa.binary()), self.parts  # the break is the first
        self.clear()
        order = pc.sort_indices(known.slice(1)).to_numpy()
        rank = np.zeros(len(known), dtype=np.int32)
        rank[order + 1] = np.arange(1, len(known), dtype=np.int32)
        spelled = pa.concat_arrays([pa.array([b""], pa.binary()), known.slice(1).take(pa.array(order))])
        base = len(known)
        del known, order
        for lang in sorted(parts):
            a = rank[np.concatenate([*parts.pop(lang), np.zeros(2, dtype=np.int32)])]
            first, second, third = a[:-2], a[1:-1], a[2:]
            codes = first.astype(np.int64)
            codes *= base
            codes += second
            codes = codes[first > 0]
            # A very long piece may bring so many words that triples pass 64 bits: their pairs are numbered then.
            pairs, codes = (None, codes) if base < WIDEST_VOCABULARY else np.unique(codes, return_inverse=True)
            codes *= base
            codes += np.where(second > 0, third, 0)[first > 0]
            del a, first, second, third
            codes.sort()
            edges = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1], [True]))) if len(codes) else codes
            for at in range(0, len(edges) - 1, _SLICE):
                edge = edges[at : at + _SLICE + 1]
                c = codes[edge[:-1]]
                two = c // base if pairs is None else pairs[c // base]
                words = [spelled.take(pa.array(x)) for x in (two // base, two % base, c % base)]
                key = pc.binary_join_element_wise(pa.scalar(_quoted(lang), pa.binary()), *words, b" ")
                yield pa.RecordBatch.from_arrays([key, pa.array(np.diff(edge), pa.int64())], ["key", "n"])


def _sorted_runs(step: int):
    """Documents to runs, packed: keys one line each, their counts, the first and the last key, and every ``step``-th as a mark."""

    def packed(keys: pa.Array, n: pa.Array) -> pa.RecordBatch:
        width = np.cumsum(pc.binary_length(keys).to_numpy() + 1, dtype=np.int64) // _BLOCK_BYTES
        starts = np.concatenate(([0], np.flatnonzero(np.diff(width)) + 1, [len(keys)]))
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), keys), b"\n")
        spans = list(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True))
        marks = [keys.take(pa.array(np.arange(i + min(step, j - i) // 2, j, step))).to_pylist() for i, j in spans]
        sums = [_closed(n.slice(i, j - i).to_numpy().tobytes()) for i, j in spans]
        lines = [_closed(x.as_py()) for x in lines]
        ends = [keys.take(pa.array(x)) for x in (starts[:-1], starts[1:] - 1)]
        columns = [*(pa.array(x, pa.binary()) for x in (lines, sums)), *ends, pa.array(marks, pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["keys", "n", "head", "tail", "marks"])

    def run(batches):
        runs = _Runs()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for block in _blocks(text.translate(_TABLE), _TEXT_BLOCK):
                    runs.add(lang, block)
                    if runs.full():
                        yield from (packed(*b.columns) for b in runs.flush())
        yield from (packed(*b.columns) for b in runs.flush())

    return run


def _fields(key: bytes) -> list[bytes]:
    return key.split(b" ")


def _cuts(runs: DataFrame, step: int, size: int) -> list[list[bytes]]:
    """Keys that cut all runs into parts of about ``size`` keys, from a sample of some marks a part."""
    marks = runs.select(F.explode("marks").alias("mark"))
    many = marks.count()
    parts = many * step // size
    if parts < 2:
        return []
    sample = marks.sample(min(1.0, MARKS * parts / many), seed=1).toArrow().column(0).to_pylist()
    found = sorted(map(_fields, sample))
    cuts = [found[i * len(found) // parts] for i in range(1, parts)] if found else []
    return [c for i, c in enumerate(cuts) if not i or c != cuts[i - 1]]


def _tasks(parts: int, usual: int) -> int:
    """Tasks that merge the parts: as many as is usual, or more, so that what a task gets does not grow with the corpus."""
    return max(-(-parts // PARTS_A_TASK), min(parts, usual))


_PART = [pa.int32(), pa.binary(), pa.binary()], ["part", "keys", "n"]


def _dealt_out(sent):
    """Blocks of runs, cut where parts begin."""

    def run(batches):
        cuts = sent.value
        for batch in batches:
            for whole, n, head, tail in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                lo, hi = bisect_right(cuts, _fields(head)), bisect_right(cuts, _fields(tail))
                if lo == hi:
                    yield _columns([(lo, whole, n)], *_PART)
                    continue
                lines, n, out, start = _opened(whole).split(b"\n"), _opened(n), [], 0
                for part in range(lo, hi + 1):
                    end = bisect_left(lines, cuts[part], lo=start, key=_fields) if part < hi else len(lines)
                    if end > start:
                        out.append((part, _closed(b"\n".join(lines[start:end])), _closed(n[8 * start : 8 * end])))
                    start = end
                yield _columns(out, *_PART)

    return run


_COUNTS = "lang string, w1 binary, w2 binary, w3 binary, f bigint"


def _in_order(ids: np.ndarray, base: int) -> np.ndarray:
    """Places of the rows of numbered fields, in their order."""
    langs, lang = np.unique(ids[:, 0], return_inverse=True)
    if len(langs) * base**3 < 1 << 63 and base < WIDEST_VOCABULARY:
        return np.argsort(((lang * base + ids[:, 1]) * base + ids[:, 2]) * base + ids[:, 3])
    return np.lexsort(ids.T[::-1])


def _added(blocks: list[tuple[bytes, bytes]], least: int):
    """Sums of the families of a part: those at its edges, and of the others what reaches ``least``."""
    text = b"\n".join([_opened(keys) for keys, _ in blocks]).replace(b"\n", b" ")
    n = np.frombuffer(b"".join([_opened(x) for _, x in blocks]), dtype=np.int64)
    fields = pc.split_pattern(pa.array([text], pa.binary()), b" ").flatten().dictionary_encode()
    order = pc.sort_indices(fields.dictionary)
    spelled = fields.dictionary.take(order)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    ids = rank[fields.indices.to_numpy()].reshape(-1, 4)
    by = _in_order(ids, len(order))
    ids, n = ids[by], n[by]
    # Only the empty word's number; a language may be empty too.
    nothing = 0 if spelled[0].as_py() == b"" else -1
    change = np.zeros(len(n), dtype=bool)
    change[0] = True
    for level in range(4):
        change[1:] |= ids[1:, level] != ids[:-1, level]
        starts = np.flatnonzero(change)
        sums = np.add.reduceat(n, starts)
        # A family at an edge may go on in the part beside; those of languages are too few to leave out.
        wanted = sums >= least if level else np.ones(len(sums), dtype=bool)
        wanted[[0, -1]] = True
        if level:
            wanted &= ids[starts, level] != nothing
        chosen = starts[wanted]
        for at in range(0, len(chosen), _SLICE):
            rows = ids[chosen[at : at + _SLICE]]
            known, place = np.unique(rows[:, 0], return_inverse=True)
            langs = pa.array([unquote(spelled[int(i)].as_py().decode()) for i in known], pa.string())
            blank = pa.array([b""] * len(rows), pa.binary())
            words = [spelled.take(pa.array(rows[:, k])) if k <= level else blank for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(place)), *words, pa.array(sums[wanted][at : at + _SLICE])], ["lang", "w1", "w2", "w3", "f"]
            )


def _added_up(least: int):
    """Counts of words, pairs, triples, and of all words of a language, part by part."""

    def run(batches):
        at, held = None, []
        for batch in batches:
            for part, keys, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and part != at:
                    yield from _added(held, least)
                    held = []
                at = part
                held.append((keys, n))
        if held:
            yield from _added(held, least)

    return run


def counts(documents: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """Counts of words, pairs and triples that occur ``least`` times or more in a language; the row
    without words (``w1`` empty) counts all words of the language."""
    spark = documents.sparkSession
    ship_package(spark)
    texts = documents.select(
        F.coalesce(col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(col("text"), F.lit("")).cast("binary").alias("text"),
    )
    step = max(1, PART_KEYS // MARKS // 25)
    runs = written(texts.mapInArrow(lean(_sorted_runs(step)), "keys binary, n binary, head binary, tail binary, marks array<binary>"), "phrase-runs")
    found = _cuts(runs, step, PART_KEYS)
    cuts = spark.sparkContext.broadcast(found)
    blocks = runs.drop("marks").mapInArrow(lean(_dealt_out(cuts)), "part int, keys binary, n binary")
    # In the order of parts, so that a task holds one of them at a time.
    tasks = _tasks(len(found) + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    merged = blocks.repartition(tasks, "part").sortWithinPartitions("part")
    parts = merged.mapInArrow(lean(_added_up(least)), _COUNTS)
    whole = parts.groupBy("lang", "w1", "w2", "w3").agg(F.sum("f").alias("f"))
    out = written(whole.where((F.col("f") >= least) | (F.length("w1") == 0)), "phrase-counts")
    dropped(runs)
    return out


# -- lockstep ------------------------------------------------------------------------

_STREAM = "lang string, path array<binary>, f bigint, extended bigint, near array<bigint>, far array<bigint>"


def _columns(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    parts = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds, strict=True)], names)


_STREAM_NAMES = ["lang", "path", "f", "extended", "near", "far"]
_STREAM_KINDS = [pa.string(), pa.list_(pa.binary()), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _lockstep(batches):
    """Rows in the order of their paths: each gets the counts of the paths it begins with (``near``),
    each pair the largest count of a triple that begins with it (``extended``)."""

    def merged():
        """Rows as lists; copies of one row (a guest met before) become one."""
        held = None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", *_STREAM_NAMES)]
            for row in zip(*columns, strict=True):
                if held and held[:3] == list(row[:3]):
                    held[4] = max(held[4], row[4])
                    continue
                if held:
                    yield held
                held = list(row)
        if held:
            yield held

    def closed():
        where = word = pair = None
        for r in merged():
            path, f = r[2], r[3]
            if pair and (len(path) < 3 or (r[0], r[1]) != where):
                yield pair
                pair = None
            where = (r[0], r[1])
            if len(path) == 1:
                word, r[5] = f, []
                yield r
            elif len(path) == 2:
                r[5] = [word]
                pair = r
            else:
                pair[4] = max(pair[4], f)
                r[5] = [word, pair[3]]
                yield r
        if pair:
            yield pair

    rows = []
    for r in closed():
        rows.append(r[1:])
        if len(rows) == 10_000:
            yield _columns(rows, _STREAM_KINDS, _STREAM_NAMES)
            rows = []
    yield _columns(rows, _STREAM_KINDS, _STREAM_NAMES)


def in_lockstep(rows: DataFrame, name: str, take=_lockstep, schema: str = _STREAM) -> DataFrame:
    """The lockstep pass over ``rows`` in the order of ``lang`` and ``path``; ``take`` is the pass, maybe with what follows it."""
    ordered = rows.repartitionByRange("lang", "path").withColumn("part", F.spark_partition_id())
    stream = written(ordered, name)
    # What the first row of each partition begins with, if it lies in an earlier one: two rows a partition.
    heads = stream.groupBy("part").agg(F.min(F.struct("lang", "path")).alias("head"))
    wanted = heads.select(
        F.col("part").alias("to_part"),
        F.col("head.lang").alias("lang"),
        F.explode(F.filter(F.array(*[F.slice("head.path", 1, k) for k in (1, 2)]), lambda p: F.size(p) < F.size("head.path"))).alias("path"),
    )
    guests = stream.join(F.broadcast(wanted), ["lang", "path"]).where("to_part <> part").withColumn("part", F.col("to_part")).drop("to_part")
    lines = stream.unionByName(guests).repartition("part").sortWithinPartitions("part", "lang", "path")
    return lines.mapInArrow(lean(take), schema)


def _best_cut(batches):
    """Score of each candidate: the lowest of its cuts, at the first place that gives it."""
    names = ["lang", "phrase", "a", "l", "r", "score", "extended"]
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        found = []
        for lang, path, a, extended, near, far in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if len(path) < 2:
                continue
            # ``far`` holds counts of the first k words by k, ``near`` of the last k.
            cuts = zip(far, reversed(near), strict=True)
            score, _, left, right = min((SCALE * a * a // (x * y), k, x, y) for k, (x, y) in enumerate(cuts))
            found.append((lang, b" ".join(reversed(path)), a, left, right, score, extended))
        yield _columns(found, kinds, names)


def _lockstep_scored(batches):
    """Lockstep and scores in one worker: two steps of a stage would hold two workers a task."""
    yield from _best_cut(_lockstep(batches))


def _words(*names: str) -> Column:
    return F.filter(F.array(*names), lambda w: F.length(w) > 0)


def scored(found: DataFrame) -> DataFrame:
    """Candidates of ``counts`` with score, the counts of the two parts of its cut, and the most
    frequent triple around it (``extended``)."""
    nothing = F.array().cast("array<bigint>")
    rows = found.where(F.length("w1") > 0).select(
        "lang", _words("w1", "w2", "w3").alias("path"), "f", F.lit(0).cast("bigint").alias("extended"), nothing.alias("near"), nothing.alias("far")
    )
    forward = in_lockstep(rows, "phrase-prefixes")
    candidates = in_lockstep(
        forward.select("lang", F.reverse("path").alias("path"), "f", "extended", nothing.alias("near"), F.col("near").alias("far")),
        "phrase-suffixes",
        _lockstep_scored,
        "lang string, phrase binary, a bigint, l bigint, r bigint, score bigint, extended bigint",
    )
    # A pair that was a guest has a row a partition.
    return candidates.groupBy("lang", "phrase").agg(
        *[F.max(c).alias(c) for c in ("a", "l", "r", "score", "extended")]
    )


def collocations(documents: DataFrame, least: int = MIN_COUNT, covered: int = COVERED_PERCENT, top: int = TOP) -> DataFrame:
    """The ``top`` best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found = counts(documents, least)
    kept = (
        scored(found)
        .where(100 * F.col("extended").cast("decimal(38,0)") < covered * F.col("a").cast("decimal(38,0)"))
        .withColumn("phrase", F.col("phrase").cast("string"))
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each of some parts of a language first, so that no task ranks a whole language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
    leading = kept.withColumn("part", part).withColumn("place", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order)))
    ranked = (
        leading.where(F.col("place") <= top)
        .withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint"))
        .where(F.col("rank") <= top)
    )
    totals = found.where(F.length("w1") == 0).select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
u AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM w),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM u, (VALUES (1), (2), (3)) AS z (k) WHERE i + k - 1 <= len(w)
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cut AS (
  SELECT c.lang, c.phrase, c.a, j, l.f AS l, r.f AS r,
         cast(1000000 * cast(c.a AS hugeint) * c.a // (cast(l.f AS hugeint) * r.f) AS bigint) AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:j], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j + 1:], ' ')
), best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longest
  FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3
        UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE coalesce(100 * longest < 50 * a, true)
)
SELECT lang, rank, phrase, a, l, r, cast(n AS bigint) AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang)
WHERE rank <= 2000
"""

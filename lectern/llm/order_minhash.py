"""Near-duplicates by order MinHash, verified by banded alignment.

A document is its sequence of words. Its five-word shingles are labelled with their occurrence, so
a repeated shingle counts as different ones. Each of ``SKETCHES`` random orders picks the two
smallest labelled shingles and keeps them in text order: two documents agree on a sketch where they
share both and share their order, which follows edit similarity, not only the sets.

Copies (equal word sequences) are one unit. Units that agree on a sketch form a bucket. A bucket is
known by its smallest and its largest unit in a random order, its leaders; members are compared to
leaders, never to each other, so a bucket of any size costs two comparisons a member. Leaders are
members of other buckets and thereby tie these together. First every unit meets only the extreme
leaders of all of its buckets. Then links are gathered to components, and of the other pairs of
member and leader those are compared whose components still differ, whatever their number.

Members that are neither leaders nor linked to one another are then compared by one rule, whatever the size
of their bucket: they meet in groups of a prefix filter. A unit's shingles are ordered from rare to
frequent, by a table of counts of fixed size, which is one order for all units; units with a
shingle similarity of ``SIMILARITY`` share one of the first 1 - ``SIMILARITY`` of each (and lie in the
same or neighbouring classes of length). Groups elect leaders in rounds, more in each round, until every
two members are in one component or one of them has been compared with the other as a leader.

A pair is a link if its edit similarity, 1 - distance / longer length in words, is at least 0.8. The
distance is that of an alignment within the band this leaves, by furthest-reaching diagonals, which
takes O(length + distance^2), all diagonals at a time where they are many. Pairs that differ too much in length or in their bags of words are
ruled out beforehand, exactly. Classes are the connected components of links.

Defined results: null text is empty; documents without a word are copies where their texts are
equal; documents under five words have one shingle, all their words. Null ids, equal rows and
equal ids are all kept apart as rows; a class is named by its smallest id (null if it has none). An
empty table gives no rows. Extra columns are left as they are.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, col, dropped, fresh, per_row, per_text, text_digest, words_of, written

SHINGLE = 5
SKETCHES = 20
SIMILARITY = 0.8
COUNTERS = 1 << 18  # of shingle hashes, for their order
LABEL_BYTES = 64  # of a unit and its label
_ROWS = 4096
_WIDE = 100  # edits from which on diagonals are followed as arrays

_RANDOM = np.random.Generator(np.random.PCG64(2024))
_ADD = _RANDOM.integers(0, 2**64, size=SKETCHES, dtype=np.uint64)
_MUL = _RANDOM.integers(0, 2**64, size=SKETCHES, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NEXT = np.uint64(0xC2B2AE3D27D4EB4F)


class WordHashes(dict):
    """Word to a 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _NEXT
    return x ^ (x >> np.uint64(29))


def labelled_shingles(ids: np.ndarray) -> np.ndarray:
    """Hashes of the shingles in text order, each with the number of its earlier occurrences."""
    size = min(SHINGLE, len(ids))
    n = len(ids) - size + 1
    s = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        s = _mixed(s * _STEP + ids[k : k + n])
    by = np.argsort(s, kind="stable")
    same = s[by]
    at = np.arange(n)
    head = np.concatenate(([True], same[1:] != same[:-1]))
    earlier = at - np.maximum.accumulate(np.where(head, at, 0))
    if earlier.any():
        s[by] = np.where(earlier > 0, _mixed(same + earlier.astype(np.uint64) * _STEP), same)
    return s


def sketches(ids: np.ndarray) -> list[int]:
    """One 64-bit key for each random order: its two smallest shingles in text order."""
    s = labelled_shingles(ids)
    if len(s) == 1:
        return _mixed(s[0] * _MUL + _ADD).view(np.int64).tolist()
    values, places = [], []
    for lo in range(0, len(s), _ROWS):
        part = _mixed((s[lo : lo + _ROWS, None] ^ _ADD) * _MUL)
        two = np.argpartition(part, min(1, len(part) - 1), axis=0)[:2]
        values.append(np.take_along_axis(part, two, axis=0))
        places.append(two + lo)
    value, place = np.concatenate(values), np.concatenate(places)
    if len(value) > 2:
        two = np.argpartition(value, 1, axis=0)[:2]
        place = np.take_along_axis(place, two, axis=0)
    place.sort(axis=0)
    return _mixed(_mixed(s[place[0]] * _STEP + _ADD) + s[place[1]] * _MUL).view(np.int64).tolist()


def _sketcher():
    known = WordHashes()

    def run(text):
        words = words_of(text)
        if not words:
            return hashlib.md5(b"\0" + (text or "").encode()).digest(), 0, []
        ids = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        return hashlib.md5(b" ".join(words)).digest(), len(words), sketches(ids)

    return run


def edit_distance_within(a: list, b: list, most: int) -> int | None:
    """Edit distance of two sequences if at most ``most``: the furthest place reached on each diagonal
    of the band for 0, 1, 2 ... edits."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    reach: dict[int, int] = {}
    for edits in range(most + 1):
        now: dict[int, int] = {}
        low, high = max(-edits, -n), min(edits, m)
        for k in range(low, high + 1):
            if edits:
                i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
                i = min(i, n, m - k)
            else:
                i = 0
            if i < 0 or i + k < 0:
                continue
            while i < n and i + k < m and a[i] == b[i + k]:
                i += 1
            if i == n and i + k == m:
                return edits
            now[k] = i
        reach = now
    return None


def wide_distance_within(a: list, b: list, most: int) -> int | None:
    """``edit_distance_within`` with all diagonals of one number of edits as arrays."""
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return None
    known: dict = {}
    x, y = (np.array([known.setdefault(w, len(known)) for w in z] + [end], dtype=np.int64) for z, end in ((a, -1), (b, -2)))
    # Places reached on the diagonals -most-1 to most+1; beyond the band nothing is reached.
    never = -(n + m + 10)
    reach = np.full(2 * most + 3, never, dtype=np.int64)
    zero = most + 1
    for edits in range(most + 1):
        low, high = max(-edits, -n), min(edits, m)
        k = np.arange(low, high + 1)
        if edits:
            left, here, right = (reach[zero + low + d : zero + high + 1 + d] for d in (-1, 0, 1))
            i = np.maximum(np.maximum(here + 1, left), right + 1)
            i = np.minimum(np.minimum(i, n), m - k)
        else:
            i = np.zeros(1, dtype=np.int64)
        alive = (i >= 0) & (i + k >= 0)
        run = np.flatnonzero(alive)
        while len(run):
            run = run[x[i[run]] == y[i[run] + k[run]]]
            i[run] += 1
        i[~alive] = never
        if low <= m - n <= high and i[m - n - low] == n:
            return edits
        reach[zero + low : zero + high + 1] = i
    return None


def similar(a: str | None, b: str | None, least: float = SIMILARITY) -> bool:
    """Whether two texts have at least this edit similarity over words."""
    x, y = words_of(a), words_of(b)
    longer = max(len(x), len(y))
    most = int((1 - least) * longer + 1e-9)
    if longer - sum((Counter(x) & Counter(y)).values()) > most:
        return False
    lo, n = 0, min(len(x), len(y))
    while lo < n and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    distance = wide_distance_within if most >= _WIDE else edit_distance_within
    return distance(x[lo : len(x) - hi], y[lo : len(y) - hi], most) is not None


def components(links: DataFrame) -> DataFrame:
    """``cid``, ``label`` for every end of a link: the smallest ``cid`` its links lead to.

    Labels move along links and along labels, so paths halve from round to round; every round is
    written to the shared folder. Labels of few units are broadcast, so a round shuffles once."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        held = bounded(labels, LABEL_BYTES)
        near = both.join(held.withColumnRenamed("cid", "b"), "b").select(F.col("a").alias("cid"), "label")
        own = labels.select("cid", "label", F.col("label").alias("old"))
        moved = near.unionByName(own, allowMissingColumns=True).groupBy("cid").agg(F.min("label").alias("next"), F.max("old").alias("old"))
        on = held.select(F.col("cid").alias("next"), F.col("label").alias("far"))
        moved = moved.join(on, "next", "left").select("cid", F.coalesce(F.least("far", "next"), "next").alias("label"), "old")
        after = written(moved, "labels")
        dropped(labels)
        labels = after.select("cid", "label")
        if after.where("label != old").isEmpty():
            dropped(both)
            return labels


def _packed(text: str | None) -> tuple[bytes]:
    """A text as it travels: pairs take their texts along, which is most of what is shuffled."""
    return (zlib.compress((text or "").encode(), 1),)


def _unpacked(data: bytes) -> str:
    return zlib.decompress(data).decode()


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` whose texts are similar."""
    left = texts.select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b"))
    same = per_row(lambda: lambda x, y: (similar(_unpacked(x), _unpacked(y)),), "struct<same: boolean>")
    return pairs.join(left, "a").join(right, "b").where(same("text_a", "text_b")["same"]).select("a", "b")


def _shingle_set(known: WordHashes, text: str | None) -> np.ndarray:
    words = words_of(text)
    return np.unique(labelled_shingles(np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))))


def _counted(batches):
    """(text) batches to one count a counter and task."""
    known, total = WordHashes(), np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            total += np.bincount((_shingle_set(known, _unpacked(text)) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["counter", "n"])


def _frequencies(texts: DataFrame) -> np.ndarray:
    """How many texts hold a shingle, by the counter it falls into: a table of fixed size. What shares a
    counter is taken for more frequent than it is, which costs time and no pair."""
    found = texts.mapInArrow(_counted, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, dtype=np.int64)
    out[found["counter"].to_numpy()] = found["n"].to_numpy()
    return out


def _prefixes(sent):
    """The first shingles of a text in the order from rare to frequent."""

    def make():
        known, often = WordHashes(), sent.value

        def run(text):
            s = _shingle_set(known, _unpacked(text))
            order = np.lexsort((s, often[(s % np.uint64(COUNTERS)).astype(np.int64)]))
            # Two sets of similarity t share t times the larger one at least.
            first = len(s) - math.ceil(SIMILARITY * len(s) - 1e-9) + 1
            return (s[order[:first]].view(np.int64).tolist(),)

        return run

    return per_text(make, "struct<s: array<bigint>>")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with the ``label`` of their component; a unit without a link is one by itself."""
    return rows.join(bounded(labels, LABEL_BYTES), "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def _open_groups(sketched: DataFrame, buckets: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """``key``, ``cid``, ``h``, ``n_words``: groups in which members of different components still have to
    be compared. Leaders of buckets were compared with all members."""
    units = sketched.groupBy("cid", "h").agg(F.first("n_words").alias("n_words"), F.first("keys").alias("keys"))
    member = units.select(F.explode(F.array_distinct("keys")).alias("key"), "cid", "h", "n_words").join(buckets, "key")
    member = _labelled(member.where("h != lo and h != hi").drop("lo", "hi"), labels)
    sizes = member.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    sizes = sizes.where("x != y").select("key")
    open_ = written(member.join(sizes, "key", "left_semi").select("cid", "h", "n_words").distinct().join(texts, "cid"), "open")
    sent = sketched.sparkSession.sparkContext.broadcast(_frequencies(open_.select("text")))
    held = open_.select("cid", "h", "n_words", F.explode(_prefixes(sent)("text")["s"]).alias("s"))
    # A length and 0.8 of it lie in the same class or in neighbours.
    size = F.floor(F.log("n_words") / math.log(1 / SIMILARITY))
    held = held.withColumn("class", F.explode(F.array(size, size + 1)))
    groups = written(held.select(F.xxhash64("s", "class").alias("key"), "cid", "h", "n_words"), "prefixes")
    dropped(open_)
    return groups


def _settled(groups: DataFrame, links: DataFrame, labels: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components once no group has two members of different components that weren't compared."""
    turn = 0
    while True:
        rows = _labelled(groups, labels)
        sizes = rows.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.min("h").alias("least"), F.min("label").alias("x"), F.max("label").alias("y")
        )
        rows = rows.join(sizes.where("x != y").select("key", "n", "least"), "key")
        # One leader, and by chance others, twice as many in every round.
        drawn = F.pmod(F.xxhash64(F.lit(turn), "h"), F.col("n")) < (2 << min(turn, 40))
        rows = written(rows.withColumn("leads", (F.col("h") == F.col("least")) | drawn), "groups")
        dropped(groups)
        if rows.isEmpty():
            dropped(rows)
            return links, labels
        leaders = rows.where("leads").select("key", *[F.col(c).alias(f"{c}_b") for c in ("cid", "h", "n_words", "label")])
        pairs = (
            rows.join(leaders, "key")
            .where("label != label_b and (not leads or h < h_b)")
            .where(F.abs(F.col("n_words") - F.col("n_words_b")) <= F.floor((1 - SIMILARITY) * F.greatest("n_words", "n_words_b") + 1e-9))
            .select(F.least("cid", "cid_b").alias("a"), F.greatest("cid", "cid_b").alias("b"))
            .distinct()
        )
        more = written(_verified(pairs, texts), "links")
        if not more.isEmpty():
            links = links.union(more)
            labels = _relabelled(labels, more)
        groups = written(rows.where("not leads").select("key", "cid", "h", "n_words"), "groups")
        dropped(rows)
        turn += 1


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components once further links have come in: those links tie earlier components, and units that had no
    link, to each other. What takes several rounds is as large as the new links only."""
    held = bounded(labels, LABEL_BYTES)
    name = lambda end: held.select(F.col("cid").alias(end), F.col("label").alias(f"label_{end}"))
    ties = links.join(name("a"), "a", "left").join(name("b"), "b", "left")
    moved = components(ties.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a != b"))
    # A label is the smallest unit of its component, so every label has a row in ``labels`` itself.
    further = bounded(moved, LABEL_BYTES).select(F.col("cid").alias("label"), F.col("label").alias("further"))
    kept = labels.join(further, "label", "left").select("cid", F.coalesce("further", "label").alias("label"))
    after = written(kept.unionByName(moved.join(held, "cid", "left_anti")), "labels")
    dropped(labels, moved)
    return after


def classes(df: DataFrame) -> DataFrame:
    """``doc_id``, ``tdig`` (digest of the text), ``n_words``, ``label`` (16 bytes that name the class) and ``n_links``
    (different texts that its text was found similar to) of every row."""
    rows = df.select(col("doc_id").alias("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text")).withColumn(
        "tdig", text_digest(F.col("text"))
    )
    sketched = written(
        rows.withColumn("s", per_text(_sketcher, "struct<cid: binary, n_words: bigint, keys: array<bigint>>")("text")).select(
            "doc_id", "tdig", "s.*", F.xxhash64("s.cid").alias("h")
        ),
        "sketches",
    )
    member = sketched.select(F.explode("keys").alias("key"), "h", "cid", "n_words")
    buckets = member.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo != hi")
    # One row for each unit and bucket that it shares with another unit.
    shared = member.join(buckets, "key").select("cid", "h", "n_words", "lo", "hi").distinct()
    units = sketched.select(F.col("h").alias("leader"), F.col("cid").alias("of"), F.col("n_words").alias("length")).distinct()
    # The extreme leaders of a unit come first; the length alone rules out most false pairs.
    extremes = shared.groupBy("cid").agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    pairs = (
        shared.join(extremes, "cid")
        .select("cid", "h", "n_words", F.explode(F.array(F.struct(F.col("lo").alias("leader"), (F.col("lo") == F.col("first")).alias("now")), F.struct(F.col("hi").alias("leader"), (F.col("hi") == F.col("last")).alias("now")))).alias("p"))
        .select("cid", "h", "n_words", "p.*")
        .where("leader != h")
        .join(units, "leader")
        .where(F.abs(F.col("n_words") - F.col("length")) <= F.floor((1 - SIMILARITY) * F.greatest("n_words", "length") + 1e-9))
        .groupBy(F.least("cid", "of").alias("a"), F.greatest("cid", "of").alias("b"))
        .agg(F.max("now").alias("now"))
    )
    pairs = written(pairs, "pairs")
    wanted = shared.select("cid").distinct()
    chosen = sketched.groupBy("cid").agg(F.min("tdig").alias("tdig")).join(wanted, "cid")
    packed = rows.select("tdig", per_text(lambda: _packed, "struct<z: binary>")("text")["z"].alias("text"))
    once = packed.groupBy("tdig").agg(F.first("text").alias("text"))
    texts = written(once.join(chosen, "tdig").select("cid", "text"), "texts")

    links = written(_verified(pairs.where("now").select("a", "b"), texts), "links")
    labels = components(links)
    held = bounded(labels, LABEL_BYTES)
    name = lambda end: held.select(F.col("cid").alias(end), F.col("label").alias(f"label_{end}"))
    rest = (
        pairs.where("not now")
        .join(name("a"), "a", "left")
        .join(name("b"), "b", "left")
        .where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
        .select("a", "b")
    )
    more = written(_verified(rest, texts), "links")
    dropped(pairs)
    if not more.isEmpty():
        links = links.union(more)
        labels = _relabelled(labels, more)
    links, labels = _settled(_open_groups(sketched, buckets, labels, texts), links, labels, texts)
    ends = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count(F.lit(1)).alias("n_links"))
    found = written(labels.join(ends, "cid"), "classes")
    dropped(links, labels, texts)
    return sketched.join(found, "cid", "left").select(
        "doc_id", "tdig", "n_words", F.coalesce("label", "cid").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def near_duplicates(df: DataFrame) -> DataFrame:
    """One row per document: its class, the size of the class, and the links of its text to others."""
    rows = classes(df)
    whole = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(whole, "label").select(
        "doc_id", "class_id", "class_size", F.lower(F.hex("label")).alias("class_key"), "n_words", "n_links"
    )


def one_of_each(df: DataFrame) -> DataFrame:
    """The rows of ``df`` with one document of each class: that with the smallest id. Among rows equal in
    id and text any one stays."""
    tdig, doc = fresh(df, "tdig", "doc")
    rows = classes(df)
    best = rows.groupBy("label").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "tdig")).alias("best")
    )
    stay = best.select(F.col("best.tdig").alias(tdig), F.col("best.id").alias(doc))
    keyed = df.withColumn(tdig, text_digest(col("text"))).withColumn(doc, col("doc_id"))
    return (
        keyed.join(stay.alias("s"), (F.col(f"s.{tdig}") == keyed[tdig]) & F.col(f"s.{doc}").eqNullSafe(keyed[doc]), "left_semi")
        .dropDuplicates([tdig, doc])
        .drop(tdig, doc)
    )

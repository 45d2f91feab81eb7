"""Removal of long repeats with a run-length compressed Burrows-Wheeler index.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else in the
corpus, the same document included. Whole UTF-8 texts count, matches never cross documents, and
strings are judged on the input.

Strings are dealt out so that equal ones meet. The anchor of a string is the first of its 16-byte
grams with the smallest hash. Its key is made of that hash, of the range of ``width`` offsets in which
the anchor lies inside the string, and of the bytes that all strings with this anchor and range have
in common (``length`` - ``width`` + 1 of them): a function of its content. A document's strings with
one anchor and range form a part, and every string lies in exactly one part. Keys held by a single
part are settled at once. Parts are then counted by key and content, so a group of copies becomes one
part with a weight, however large: with a weight of two or more all its strings are repeats.

What remains are keys with several different parts. A key with more than ``HOT_SEGMENTS`` of them is
dealt out again by ranges half as wide, and so on until no such key is left; at a width of 1 all parts
of a key are equal, so this ends, and no task ever holds more than that many parts of a key. The parts
are fetched, sorted by key and indexed in blocks of bounded size: suffix order, Burrows-Wheeler
transform, its runs, and the suffix positions sampled at both ends of every run. The longest match of
a position elsewhere (its matching statistic) is compared directly at the samples; between them it
falls by one a byte, so one pass streams all of them. Marked spans go back to their documents and are
cut out of the bytes.

Null text is empty; documents under ``length`` bytes keep everything. Texts are identified by a
128-bit digest of their content, so equal rows, repeated ids and null ids get equal results. An
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, dropped, per_row, ship_package, text_digest, written

LENGTH = 400
GRAM = 16
BLOCK_BYTES = 2 << 20
HOT_SEGMENTS = 2000  # different parts of a key that are indexed together
_AT_ONCE = 1 << 20  # bytes of text that are cut into parts at a time
_ROWS = 4096

_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93]


def gram_hashes(data: bytes) -> np.ndarray:
    """Hash of every 16-byte gram."""
    n = len(data) - 7
    words = np.ndarray((n,), dtype="<u8", buffer=data, strides=(1,))
    a, b = np.uint64(_ODD[0]), np.uint64(_ODD[1])
    h = words[: n - 8] * a
    h ^= h >> np.uint64(32)
    h += words[8:]
    h *= b
    h ^= h >> np.uint64(29)
    h *= a
    h ^= h >> np.uint64(32)
    return h


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of ``w`` values, from running minima of blocks both ways."""
    n = len(h)
    padded = np.full(-(-n // w) * w, np.iinfo(h.dtype).max, dtype=h.dtype)
    padded[:n] = h
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def parts(texts: list[bytes], length: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first string, number of strings and key of every part of some texts, none of them shorter
    than ``length``. No string occurs twice in a part."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    h = gram_hashes(b"".join(texts))
    inside = length - GRAM + 1
    least = sliding_min(h, inside)
    places = len(least)
    # Strings that share an anchor, apart from those across two texts.
    new = np.ones(places, dtype=bool)
    new[1:] = (h[: places - 1] == least[:-1]) | (least[1:] != least[:-1])
    new[begins] = True
    across = np.zeros(places + 1, dtype=np.int8)
    across[ends[:-1] - length + 1] += 1
    across[ends[:-1]] -= 1
    across = np.cumsum(across[:-1], dtype=np.int8) > 0
    new[1:] |= across[1:] != across[:-1]
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, places))
    own = ~across[starts]
    starts, counts = starts[own], counts[own]
    anchors = np.empty(len(starts), dtype=np.int64)
    for lo in range(0, len(starts), _ROWS):
        some = starts[lo : lo + _ROWS]
        anchors[lo : lo + _ROWS] = some + (h[some[:, None] + np.arange(inside)] == least[some][:, None]).argmax(axis=1)
    # Offsets of the anchor inside the strings, cut at multiples of the width.
    far = anchors - starts
    near = far - counts + 1
    pieces = far // width - near // width + 1
    of = np.repeat(np.arange(len(starts)), pieces)
    turn = near[of] // width + np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    low, high = np.maximum(near[of], turn * width), np.minimum(far[of], turn * width + width - 1)
    first = anchors[of] - high
    # Sums of gram hashes times powers, moved back to the start of what the range has in common.
    up = np.multiply.accumulate(np.full(len(h), _ODD[2], dtype=np.uint64))
    down = np.multiply.accumulate(np.full(len(h), pow(_ODD[2], -1, 1 << 64), dtype=np.uint64))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(h * up, dtype=np.uint64)))
    a = anchors[of] - turn * width
    b = np.maximum(a, a - width + 1 + inside)
    key = (sums[b] - sums[a]) * down[a] ^ least[starts[of]] + turn.astype(np.uint64) * np.uint64(_ODD[0])
    key ^= key >> np.uint64(32)
    key *= np.uint64(_ODD[1])
    key ^= key >> np.uint64(29)
    text = np.searchsorted(ends, first, side="right")
    return text, first - begins[text], high - low + 1, key.view(np.int64)


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Place of each key in the order; equal keys share the first one's."""
    order = np.argsort(keys)
    ordered = keys[order]
    head = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))
    return rank


def _doubled(rank: np.ndarray, ends: np.ndarray, depth: int, longest: int) -> np.ndarray:
    """Ranks of whole suffixes out of ranks of their first ``depth`` symbols, by doubling; a suffix ends
    at ``ends``. Only places that still share a rank are sorted again."""
    n = len(rank)
    active = np.arange(n)
    while depth < longest:
        size = np.bincount(rank, minlength=n)
        active = active[size[rank[active]] > 1]
        if not len(active):
            break
        ahead = active + depth
        second = np.where(ahead < ends[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + second
        by = np.argsort(key)
        key, of = key[by], active[by]
        old = rank[of]
        at = np.arange(len(of))
        first = np.maximum.accumulate(np.where(np.concatenate(([True], old[1:] != old[:-1])), at, 0))
        same = np.maximum.accumulate(np.where(np.concatenate(([True], key[1:] != key[:-1])), at, 0))
        rank[of] = old + same - first
        depth *= 2
    return rank


def _suffix_ranks(texts: list[bytes]) -> np.ndarray:
    """Ranks of all suffixes of some texts, each ending with its text; equal ones share a rank."""
    data = np.frombuffer(b"".join([*texts, bytes(8)]), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    n = int(sizes.sum())
    ends = np.repeat(np.cumsum(sizes), sizes)
    left = ends - np.arange(n)
    # Seven bytes, and how many of them there are.
    head = np.ndarray((n,), dtype=">u8", buffer=data, strides=(1,)).astype(np.uint64)
    near = np.flatnonzero(left < 7)
    head[near] &= ~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - left[near].astype(np.uint64)))
    head = head & ~np.uint64(0xFF) | np.minimum(left, 7).astype(np.uint64)
    return _doubled(_ranked(head), ends, 7, int(sizes.max()))


class RunIndex:
    """Run-compressed transform of some short texts, with sampled run ends.

    The suffix order comes from prefix-free parsing: the texts are cut into phrases that overlap in
    the 8-byte strings whose hash is 0 in five bits. No phrase suffix is the start of another, so two
    text suffixes compare as their phrase suffixes do and, where these are equal, as the next
    phrases. Repetitive texts have few different phrases, and only those are sorted by bytes.
    """

    def __init__(self, texts: list[bytes], length: int = LENGTH):
        self.length = length
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.ends = np.repeat(np.cumsum(sizes), sizes)  # of the text that a place is in
        self.firsts = np.cumsum(sizes) - sizes
        self.order = self._order()
        before = self.data[self.order - 1].astype(np.int16)  # the transform
        is_first = np.zeros(len(self.data), dtype=bool)
        is_first[self.firsts] = True
        before[is_first[self.order]] = -1
        new = np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] < 0)))
        self.run_heads = np.flatnonzero(new)
        self.run_letters = before[self.run_heads]
        ends = np.append(self.run_heads[1:], len(before)) - 1
        self.samples = np.union1d(self.run_heads, ends)  # places in the order, at both ends of runs

    def _order(self) -> np.ndarray:
        n, ends = len(self.data), self.ends
        place = np.arange(n)
        padded = np.concatenate((self.data, np.zeros(8, dtype=np.uint8)))
        words = np.ndarray((n,), dtype="<u8", buffer=padded, strides=(1,))
        cut = ((words * np.uint64(_ODD[0])) >> np.uint64(59) == 0) & (place + 8 <= ends)
        # The first cut after each place; from the end of its text on there is none.
        after = np.minimum.accumulate(np.where(cut, place, n)[::-1])[::-1]
        after = np.append(after[1:], n)
        cut[self.firsts] = True
        starts = np.flatnonzero(cut)
        stops = np.where(after[starts] < ends[starts], after[starts] + 8, ends[starts])
        raw = self.data.tobytes()
        known: dict[bytes, int] = {}
        kind = np.array(
            [known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], dtype=np.int64
        )
        phrases = list(known)
        rank = _suffix_ranks(phrases)
        begins = np.cumsum([0, *map(len, phrases)])[:-1]
        number = np.cumsum(cut) - 1  # of the phrase that a place is in
        inside = rank[begins[kind[number]] + place - starts[number]]
        # The sequence of phrases, ranked in the same way.
        last = np.searchsorted(starts, ends[starts], side="left")
        along = _doubled(_ranked(inside[starts]), last, 1, int((last - np.arange(len(starts))).max()))
        follows = np.where(after < ends, along[np.minimum(number + 1, len(starts) - 1)] + 1, 0)
        both = inside * (len(starts) + 1) + follows
        if (int(both.max()) + 1) * n >= 1 << 63:
            both = _ranked(both)
        # Equal suffixes stand in the order of their places, as those one letter longer then do.
        return np.argsort(both * n + place)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of suffixes; 0 where it is under ``length`` and so of no interest."""
        out = np.zeros(len(a), dtype=np.int64)
        most = np.minimum(self.ends[a] - a, self.ends[b] - b)
        near = np.flatnonzero(most >= self.length)
        for at in (0, self.length - 1, self.length // 2, self.length // 4, 3 * self.length // 4):
            near = near[self.data[a[near] + at] == self.data[b[near] + at]]
        longest = int(most[near].max(initial=0))
        steps = np.arange(longest)
        last = len(self.data) - 1
        for lo in range(0, len(near), 1024):
            part = near[lo : lo + 1024]
            x = self.data[np.minimum(a[part][:, None] + steps, last)]
            y = self.data[np.minimum(b[part][:, None] + steps, last)]
            differs = (x != y) | (steps >= most[part][:, None])
            found = np.where(differs.any(axis=1), differs.argmax(axis=1), longest)
            out[part] = np.where(found >= self.length, found, 0)
        return out

    def matching_statistics(self) -> np.ndarray:
        """Longest match of every place with another place; where it is under ``length``, the value
        may be any smaller one."""
        n, rows = len(self.data), self.samples
        here = self.order[rows]
        # Neighbours in the order: a pair of samples is compared once.
        below = np.where(rows < n - 1, self._common(here, self.order[np.minimum(rows + 1, n - 1)]), 0)
        above = np.zeros(len(rows), dtype=np.int64)
        beside = np.flatnonzero(rows[1:] == rows[:-1] + 1) + 1
        above[beside] = below[beside - 1]
        alone = np.setdiff1d(np.flatnonzero(rows > 0), beside)
        above[alone] = self._common(here[alone], self.order[rows[alone] - 1])
        at = np.full(n, -1, dtype=np.int64)
        at[here] = here
        best = np.zeros(n, dtype=np.int64)
        best[here] = np.maximum(above, below)
        sampled = np.maximum.accumulate(at)  # the first place of each text is a sample
        return best[sampled] - (np.arange(n) - sampled)


def _spans(repeated: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte stretches covered by marked strings."""
    starts = np.flatnonzero(repeated)
    if not len(starts):
        return []
    jump = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.append(0, jump + 1)].tolist(), (starts[np.append(jump, len(starts) - 1)] + length).tolist(), strict=True))


def _part_rows(length: int, width: int, keys_only: bool = False):
    """Arrow batches of (tdig, text) to rows of parts: where strings start, packed with their number."""

    def rows(owners: list[bytes], texts: list[bytes]) -> pa.RecordBatch:
        text, start, n, key = parts(texts, length, width)
        if keys_only:
            return pa.RecordBatch.from_arrays([pa.array(key)], ["key"])
        digests = [
            xxhash.xxh3_64_intdigest(texts[t][a:b])
            for t, a, b in zip(text.tolist(), start.tolist(), (start + n + length - 1).tolist(), strict=True)
        ]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(key),
                pa.array(np.array(digests, dtype=np.uint64).view(np.int64)),
                pa.array(owners, pa.binary()).take(pa.array(text)),
                pa.array(start << 10 | n),
                pa.array(np.ones(len(key), dtype=bool)),
            ],
            ["key", "sdig", "tdig", "place", "single"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, texts, held = [], [], 0
            for owner, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = text.encode()
                if len(data) >= length:
                    owners.append(owner)
                    texts.append(data)
                    held += len(data)
                if held >= _AT_ONCE:
                    yield rows(owners, texts)
                    owners, texts, held = [], [], 0
            if texts:
                yield rows(owners, texts)

    return run


PART_SCHEMA = "key bigint, sdig bigint, tdig binary, place bigint, single boolean"
PIECE_SCHEMA = "key bigint, tdig binary, start bigint, n int, single boolean, bytes binary"


def _narrower(piece: bytes, key: int, n: int, width: int, length: int) -> Iterator[tuple[int, int, int]]:
    """Key, first string and number of strings of the parts, in ranges of ``width``, of a wider part."""
    anchor = int(gram_hashes(piece)[: length - GRAM + 1].argmin())
    for turn in range((anchor - n + 1) // width, anchor // width + 1):
        low, high = max(anchor - n + 1, turn * width), min(anchor, turn * width + width - 1)
        common = piece[anchor - turn * width : anchor - turn * width - width + 1 + length]
        mixed = xxhash.xxh3_64_intdigest(common, seed=(key + turn * _ODD[0]) % (1 << 64))
        yield mixed - (mixed >> 63 << 64), anchor - high, high - low + 1


def _narrower_rows(length: int, width: int):
    """(tdig, text, wanted parts) to rows of their narrower parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for owner, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode()
                for w in wanted:
                    start, n = w["place"] >> 10, w["place"] & 1023
                    piece = data[start : start + n + length - 1]
                    for key, at, size in _narrower(piece, w["key"], n, width, length):
                        digest = xxhash.xxh3_64_intdigest(piece[at : at + size + length - 1])
                        rows.append((key, digest - (digest >> 63 << 64), owner, start + at << 10 | size, w["single"]))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["key", "sdig", "tdig", "place", "single"],
                )

    return run


def _piece_rows(length: int):
    """(tdig, text, wanted parts) to rows of index pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for owner, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode()
                for w in wanted:
                    start, n = w["place"] >> 10, w["place"] & 1023
                    rows.append((w["key"], owner, start, n, w["single"], data[start : start + n + length - 1]))
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["key", "tdig", "start", "n", "single", "bytes"],
                )

    return run


def _index_rows(length: int, block_bytes: int):
    """Pieces sorted by key, indexed in blocks of whole keys; out come spans of single segments."""

    def marks(block: list[tuple]) -> Iterator[tuple]:
        # The same text twice under a key is one index text, and all of its strings are repeats.
        texts: dict[tuple[int, bytes], int] = {}
        times: list[int] = []
        for key, _, _, _, _, piece in block:
            at = texts.setdefault((key, piece), len(times))
            if at == len(times):
                times.append(0)
            times[at] += 1
        index = RunIndex([t for _, t in texts], length)
        repeated = index.matching_statistics() >= length
        for key, owner, start, n, single, piece in block:
            if single:
                at = texts[key, piece]
                first = index.firsts[at]
                found = np.ones(n, dtype=bool) if times[at] > 1 else repeated[first : first + n]
                for a, b in _spans(found, length):
                    yield owner, start + a, start + b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        held = 0
        out: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if held >= block_bytes and row[0] != block[-1][0]:
                    out += marks(block)
                    block, held = [], 0
                block.append(row)
                held += len(row[5])
            if out:
                yield _span_batch(out)
                out = []
        if block:
            out += marks(block)
        if out:
            yield _span_batch(out)

    return run


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    owner, a, b = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(owner, pa.binary()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["tdig", "a", "b"]
    )


def repeated_spans(texts: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``tdig``, ``a``, ``b``: stretches to remove, of the table ``tdig``, ``text`` with a row for each
    document. Stretches of a text may overlap."""
    ship_package(texts.sparkSession)
    width = max(1, length // 2)
    # Only keys that occur twice matter; this keeps the rest out of every later step.
    keys = texts.mapInArrow(_part_rows(length, width, keys_only=True), "key bigint")
    # Written, so that joins have both sides fresh from a shuffle and hot keys can be cut there.
    shared = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "shared")
    rows = written(texts.mapInArrow(_part_rows(length, width), PART_SCHEMA).join(shared, "key"), "parts")
    one = texts.where(F.octet_length("text") >= length).groupBy("tdig").agg(F.first("text").alias("text"))

    def with_parts(chosen: DataFrame) -> DataFrame:
        # A text's parts are no longer than a multiple of the text.
        lists = chosen.groupBy("tdig").agg(F.collect_list(F.struct("key", "place", "single")).alias("wanted"))
        return one.join(lists, "tdig").select("tdig", "text", "wanted")

    whole, near, used = [], [], [shared]
    while True:
        kinds = written(
            rows.groupBy("key", "sdig")
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tdig", "place", "single")).alias("one"))
            .select("key", "sdig", "n", "one.tdig", "one.place", (F.col("one.single") & (F.col("n") == 1)).alias("single")),
            "kinds",
        )
        twice = kinds.where("n > 1").select("key", "sdig")
        whole.append(rows.where("single").join(twice, ["key", "sdig"]).select("tdig", "place").distinct())
        # Where every part has its double there is nothing left to find.
        several = written(
            kinds.groupBy("key")
            .agg(F.count(F.lit(1)).alias("kinds"), F.count_if("single").alias("singles"))
            .where("kinds > 1 and singles > 0")
            .select("key", ((F.col("kinds") > HOT_SEGMENTS) & F.lit(width > 1)).alias("hot")),
            "several",
        )
        chosen = written(kinds.join(several, "key").select("key", "tdig", "place", "single", "hot"), "chosen")
        used += [rows, kinds, several, chosen]
        near.append(chosen.where("not hot"))
        if chosen.where("hot").isEmpty():
            break
        width //= 2
        rows = written(with_parts(chosen.where("hot")).mapInArrow(_narrower_rows(length, width), PART_SCHEMA), "parts")
    pieces = with_parts(reduce(DataFrame.unionByName, near)).mapInArrow(_piece_rows(length), PIECE_SCHEMA)
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    indexed = pieces.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(_index_rows(length, block_bytes), "tdig binary, a bigint, b bigint")
    first = F.shiftright("place", 10)
    doubled = reduce(DataFrame.unionByName, whole).select(
        "tdig", first.alias("a"), (first + F.col("place").bitwiseAND(1023) + (length - 1)).alias("b")
    )
    spans = written(doubled.unionByName(indexed), "spans")
    dropped(*used)
    return spans


def _cut(text, spans):
    data = (text or "").encode()
    kept, removed, n, at = hashlib.sha256(), 0, 0, 0
    for a, b in sorted(spans) if spans is not None else ():
        if a > at or not n:
            kept.update(data[at:a])
            n += 1
            removed += b - a
            at = b
        elif b > at:
            removed += b - at
            at = b
    kept.update(data[at:])
    return len(data), removed, n, kept.hexdigest()


def _cutter():
    return lambda row_text, a, b: _cut(row_text, None if a is None else list(zip(a.tolist(), b.tolist(), strict=True)))


def remove_repeats(df: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: bytes, bytes removed, removed runs, digest of what is left."""
    docs = df.select(col("doc_id").alias("doc_id"), F.coalesce(col("text"), F.lit("")).alias("text")).withColumn(
        "tdig", text_digest(F.col("text"))
    )
    spans = repeated_spans(docs.select("tdig", "text"), length, block_bytes)
    lists = spans.groupBy("tdig").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    cut = per_row(_cutter, "struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string>")
    return (
        docs.join(lists, "tdig", "left")
        .select("doc_id", cut("text", F.col("spans.a"), F.col("spans.b")).alias("r"))
        .select("doc_id", "r.*")
    )

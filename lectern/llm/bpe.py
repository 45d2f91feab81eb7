"""Byte-pair encoding and decoding with a given vocabulary.

A word's symbols stand in a doubly linked list; a priority queue holds the merge rank and place of
every adjacent pair. The lowest rank is merged, leftmost first; a queue entry whose symbols have
changed since it was put in is stale and skipped. That is O(n log n) for a word of n bytes, so one
unbroken run of a million letters costs no more a byte than a sentence. Decoding looks up the
vocabulary string of each id and joins them.

Words end at white space, so each blank-free chunk is encoded by itself and kept in a bounded
cache per task. Null text is empty; an empty text has no ids and decodes to the empty string.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from array import array

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import col, held, per_text, sha256_hex

CACHED = 200_000
CACHED_LENGTH = 48
OLD_LETTERS = "\u0558"

# Unicode White_Space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_CHUNKS = re.compile(f"[^{SPACES}]+")
# Python's split() also takes these four for blanks.
_CONTROLS = re.compile("[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next
    unused letter from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class WordBpe:
    """Vocabulary, merges, normalisation and word pattern of one tokenizer file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[left], self.vocab[right]] = rank, self.vocab[left + right]
        letters = byte_letters()
        self.inner = [self.vocab[x] for x in letters]
        self.final = [self.vocab[x + self.suffix] for x in letters]
        pattern = next(p["pattern"]["Regex"] for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern = pattern.replace(r"\s", SPACES)
        self.words = regex.compile(pattern)
        # The same words of ASCII text, which needs no Unicode classes.
        plain = pattern.replace(r"\p{L}", "a-zA-Z").replace(r"\p{N}", "0-9")
        self.ascii_words = self.words if r"\p" in plain.lower() else re.compile(plain)
        # Letters from here on differ between Unicode versions; their classes are the library's.
        self.library = Tokenizer.from_str(spec)
        self.letters = {x: b for b, x in enumerate(letters)}
        self.specials = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        # Chunks and words, each in two generations.
        self.cache: tuple[dict[str, tuple[bytes, str]], ...] = {}, {}
        self.known: tuple[dict[bytes, tuple[bytes, str]], ...] = {}, {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one word given as its UTF-8 bytes."""
        ids = [self.inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r[0], i, ids[i], ids[i + 1], r[1]) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, whole = heapq.heappop(queue)
            j = after[i]
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j] = whole, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := ranks.get((whole, ids[k])):
                    heapq.heappush(queue, (r[0], i, whole, ids[k], r[1]))
            if (h := before[i]) >= 0 and (r := ranks.get((ids[h], whole))):
                heapq.heappush(queue, (r[0], h, ids[h], whole, r[1]))
        return [x for x in ids if x >= 0]

    def _words(self, chunk: str) -> list[bytes]:
        """Normalised words of a chunk, as the merges see them."""
        if chunk.isascii():
            return [w.encode() for w in self.ascii_words.findall(chunk.lower())]
        if max(chunk) < OLD_LETTERS:
            # Lower case letter by letter: no letter depends on its place in the word.
            low = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
            return [w.encode() for w in self.words.findall(low)]
        low = self.library.normalizer.normalize_str(chunk)
        return [bytes([self.letters[x] for x in w]) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(low)]

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        if out := self.cache[1].get(chunk):
            return _keep(self.cache, chunk, out)
        get, own = self.known[0].get, self._word
        parts = [get(w) or own(w) for w in self._words(chunk)]
        out = parts[0] if len(parts) == 1 else (b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts]))
        return _keep(self.cache, chunk, out)

    def _word(self, word: bytes) -> tuple[bytes, str]:
        out = self.known[1].get(word)
        if not out:
            ids = self.merge(word)
            out = _pack(ids), self.join(ids)
        return _keep(self.known, word, out)

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        chunks = _CHUNKS.findall(text) if _CONTROLS.search(text) else text.split()
        get, own = self.cache[0].get, self._chunk
        return [get(c) or own(c) for c in chunks]

    def pieces(self, text: str | None) -> list[tuple[bytes, str]]:
        """Packed ids and joined strings, chunk by chunk. Special tokens are found in the raw text."""
        text = text or ""
        out, at = [], 0
        if "<" in text:
            for m in self.specials.finditer(text):
                out += self._plain(text[at : m.start()])
                out.append((_pack([self.special[m[0]]]), m[0]))
                at = m.end()
        return out + self._plain(text[at:] if at else text)

    def encode(self, text: str | None) -> list[int]:
        ids = array("I")
        ids.frombytes(b"".join([p[0] for p in self.pieces(text)]))
        return list(ids)

    def join(self, ids: list[int]) -> str:
        """Vocabulary strings, one blank apart: the file names no decoder that says otherwise."""
        strings = self.strings
        return " ".join([strings[i] for i in ids])

    def digests(self, text: str | None) -> tuple[int, str, str]:
        parts = self.pieces(text)
        ids = b"".join([p[0] for p in parts])
        return len(ids) // 4, sha256_hex(ids), sha256_hex(" ".join([p[1] for p in parts]).encode())


def _keep(cache: tuple[dict, dict], key, value):
    """Remember a short key. Half of the bound is for the newest keys; once that is full it becomes the
    older half, from which keys in use come back."""
    if len(key) <= CACHED_LENGTH:
        young, old = cache
        if len(young) >= max(1, CACHED // 2):
            old.clear()
            old.update(young)
            young.clear()
        young[key] = value
    return value


def _pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _loaded(spec: str) -> WordBpe:
    """One parsed vocabulary a worker process."""
    return held(("bpe", hash(spec)), lambda: WordBpe(spec))


def tokenizer_spec(spark: SparkSession, path: str):
    """The tokenizer file, read where the driver is and sent to the tasks: 49,408 entries at most
    for the file used here, whatever the corpus holds."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoded(df: DataFrame, path: str, text: str = "text") -> Column:
    """Struct ``ids``, ``decoded`` of a text column."""
    spec = tokenizer_spec(df.sparkSession, path)

    def make():
        bpe = _loaded(spec.value)

        def run(value):
            ids = bpe.encode(value)
            return ids, bpe.join(ids)

        return run

    return per_text(make, "struct<ids: array<int>, decoded: string>")(col(text))


def token_digests(df: DataFrame, path: str, text: str = "text") -> Column:
    """Struct ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of a text column."""
    spec = tokenizer_spec(df.sparkSession, path)
    return per_text(
        lambda: _loaded(spec.value).digests, "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"
    )(col(text))


def tokenize(df: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id and the digests of its ids and of their decoded text."""
    return df.select(col("doc_id"), token_digests(df, path).alias("r")).select("doc_id", F.col("r.*"))

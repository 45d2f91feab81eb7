"""Toxicity from a learned lexicon, matched through Levenshtein automata, read in context.

The lexicon holds terms that mark toxic documents in the training rows: over-represented there,
frequent enough, and met between many different neighbours (a term that only copies of one text
carry isn't one). Training rows are distinct texts, so copies neither add to a term nor take from it,
and no other limit than these tests holds the lexicon's size. It is stored as a trie. A word is looked up by walking the trie together with the
Levenshtein automaton of the word: a state is the row of edit distances to the word's prefixes, and a
branch ends where no entry of the row is within the limit. So misspelled terms are found as well,
within one edit from five letters on and two from eight on; words that at least two training rows
use innocently are no misspellings.

Around every hit a window of words and quotation marks decides how much of it is abuse and how much
quotation: marks around the hit and reporting words before it lower the share, direct address raises
it. A logistic model over the three masses (exact, misspelled, quoted), fitted on at most about
``TRAIN_ROWS`` labelled rows, gives the score. Labels of rows with crc32(doc_id) mod 5 = 0 are never read, and
labels, lang, source and doc_id are no inputs of a score.

Null and empty texts have no hits and get the score of hit-free text. Rows whose label is missing are
scored like all others. Without labelled rows the lexicon is empty. Ids that occur more than once
take the highest of their labels. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, col, per_text, text_digest, written

TRAIN_ROWS = 20_000
MIN_LOG_ODDS = 3.0
MIN_SHARE = 0.01
MIN_ROWS = 4
MIN_DIVERSITY = 0.6
MIN_TERM = 4
MIN_INNOCENT = 2
WINDOW = 6
CACHED = 200_000
PRIOR = (-2.0, 3.0, 2.0, 0.7)  # intercept, exact, misspelled, quoted

_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’‹›…¿¡–—"
_QUOTES = re.compile("[\"«»„“”‹›]")
REPORTING = frozenset(
    "said says say quote quoted quotes quoting called calls calling word words term terms wrote writes reported insult "
    "insults slur slurs sagte wort zitat zitiert nannte dit mot cite citation dijo palabra cita llamó".split()
)
ADDRESS = frozenset("you your you're yourself du dich dir ihr euch tu te toi vous tú eres usted ustedes".split())

Hit = tuple[int, int]  # place of the word, edits


def words_at_blanks(text: str | None) -> list[str]:
    return (text or "").lower().split()


def bare(word: str) -> str:
    return word.strip(_EDGES)


def edits_allowed(length: int) -> int:
    return 0 if length < 5 else 1 if length < 8 else 2


def _pieces(term: str, edits: int) -> list[tuple[int, str]]:
    """The term in edits + 1 parts with their places: a word within that many edits holds one of them
    unchanged, and no further from its place than the edits allow."""
    cuts = [len(term) * i // (edits + 1) for i in range(edits + 2)]
    return [(x, term[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


class Lexicon:
    """Tries of terms, one for each number of edits allowed, searched with the Levenshtein automaton of
    a word."""

    def __init__(self, terms: list[str], ordinary: frozenset[str] = frozenset()):
        self.exact = frozenset(terms)
        self.ordinary = ordinary - self.exact
        self.longest = max(map(len, terms), default=0)
        self.tries: list[tuple[int, dict, frozenset[int], re.Pattern, dict[int, set[tuple[int, str]]]]] = []
        for k in (1, 2):
            own = [t for t in terms if edits_allowed(len(t)) == k]
            if own:
                root: dict = {}
                for term in own:
                    node = root
                    for c in term:
                        node = node.setdefault(c, {})
                    node[""] = term
                sizes = frozenset(len(t) + d for t in own for d in range(-k, k + 1))
                pieces = {piece for t in own for piece in _pieces(t, k)}
                parts = re.compile("|".join(sorted({re.escape(x) for _, x in pieces})))
                places: dict[int, set[tuple[int, str]]] = {}
                for at, x in pieces:
                    places.setdefault(len(x), set()).update((at + d, x) for d in range(-k, k + 1))
                self.tries.append((k, root, sizes, parts, places))
        self.cache: dict[str, int] = {}
        self.known: dict[str, int | None] = {}

    def nearest(self, word: str) -> int | None:
        """Fewest edits to a term that the term's length allows."""
        if word in self.exact:
            return 0
        best = None
        for k, root, sizes, parts, places in self.tries:
            if len(word) in sizes and parts.search(word) and _in_place(word, places):
                d = _walk(root, word, k)
                if d is not None and (best is None or d < best):
                    best = d
        return best

    def look_up(self, word: str) -> int:
        """Edits to the lexicon, or -1; ``word`` as it stands between blanks. Remembered up to a bound."""
        plain = bare(word)
        found = -1
        if MIN_TERM - 1 <= len(plain) <= self.longest + 2 and plain not in self.ordinary:
            if plain not in self.known:
                if len(self.known) >= CACHED:
                    self.known.clear()
                self.known[plain] = self.nearest(plain)
            d = self.known[plain]
            found = -1 if d is None else d
        if len(self.cache) >= CACHED:
            self.cache.clear()
        self.cache[word] = found
        return found

    def hits(self, words: list[str]) -> list[Hit]:
        get, look = self.cache.get, self.look_up
        found = [get(w) for w in words]
        out = []
        for i, d in enumerate(found):
            if d is None:
                d = look(words[i])
            if d >= 0:
                out.append((i, d))
        return out


def _in_place(word: str, places: dict[int, set[tuple[int, str]]]) -> bool:
    """Whether the word holds a term's piece near the piece's place."""
    n = len(word)
    return any((i, word[i : i + size]) in found for size, found in places.items() for i in range(n - size + 1))


def _walk(root: dict, word: str, k: int) -> int | None:
    """Fewest edits, k at most, from a word to a term of the trie. The automaton's state after d
    letters is the band of edit distances to the word's prefixes of d - k to d + k letters."""
    n, far, wide = len(word), k + 1, 2 * k + 1
    best = far
    todo = [(root, 0, [abs(o - k) if o >= k else far for o in range(wide)])]
    while todo:
        node, depth, row = todo.pop()
        for c, child in node.items():
            if not c:
                o = n - depth + k
                if 0 <= o < wide:
                    best = min(best, row[o])
                continue
            i, step, least = depth + 1, [], far
            for o in range(wide):
                j = i + o - k
                d = far
                if 0 <= j <= n:
                    if j:
                        d = row[o] + (word[j - 1] != c)
                        if o and step[o - 1] + 1 < d:
                            d = step[o - 1] + 1
                    if o + 1 < wide and row[o + 1] + 1 < d:
                        d = row[o + 1] + 1
                step.append(d)
                if d < least:
                    least = d
            if least < far and least <= best:
                todo.append((child, i, step))
    return best if best < far else None


def quoted_share(words: list[str], at: int) -> float:
    """How much of a hit is quotation, from 0 to 1, by the words around it."""
    before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
    here = words[at]
    core = bare(here)
    cut = here.find(core)
    opens = len(_QUOTES.findall(here[:cut])) + sum(len(_QUOTES.findall(w)) for w in before)
    closes = len(_QUOTES.findall(here[cut + len(core) :])) + sum(len(_QUOTES.findall(w)) for w in after)
    share = 0.5 * (opens % 2 == 1 and closes > 0) + 0.5 * any(bare(w) in REPORTING for w in before)
    if any(bare(w) in ADDRESS for w in before[-3:] + after[:3]):
        share -= 0.25
    return min(1.0, max(0.0, share))


def masses(lexicon: Lexicon, text: str | None) -> tuple[float, float, float]:
    """Exact, misspelled and quoted mass of a text's hits."""
    words = words_at_blanks(text)
    exact = near = quoted = 0.0
    for at, edits in lexicon.hits(words):
        share = quoted_share(words, at)
        quoted += share
        if edits:
            near += 1 - share
        else:
            exact += 1 - share
    return math.log1p(exact), math.log1p(near), math.log1p(quoted)


def fit(features: np.ndarray, labels: np.ndarray) -> list[float]:
    """Logistic regression by Newton steps, held by a quadratic pull towards ``PRIOR``."""
    x = np.column_stack((np.ones(len(features)), features.reshape(len(features), 3)))
    prior = np.array(PRIOR)
    w = prior.copy()
    pull = np.diag([0.01, 1.0, 1.0, 5.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - labels) + pull @ (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w.tolist()


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``text`` and ``toxic`` of a bounded sample of labelled documents outside the held-out fold, copies
    with equal labels once."""
    known = (
        labels.select(col("doc_id").alias("doc_id"), col("toxic").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    share = min(1.0, TRAIN_ROWS / max(1, known.count()))
    picked = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 20)) <= int(share * (1 << 20)))
    # At most about TRAIN_ROWS pairs of numbers, whatever the table holds.
    rows = documents.select(col("doc_id").alias("doc_id"), col("text").alias("text")).join(F.broadcast(picked), "doc_id")
    once = rows.groupBy(text_digest(F.col("text")).alias("tdig"), (F.col("toxic") > 0).alias("marked"))
    return once.agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _contexts():
    """Distinct bare words of a text with the neighbours of their first place."""

    def run(text):
        words = [bare(w) for w in words_at_blanks(text)]
        first: dict[str, str] = {}
        for i, w in enumerate(words):
            if len(w) >= MIN_TERM and w not in first:
                first[w] = f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"
        return list(first), list(first.values())

    return run


def learn_lexicon(train: DataFrame) -> tuple[list[str], list[str]]:
    """Terms, and words near them that innocent training rows use."""
    n = {r.toxic: r.n for r in train.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    if not toxic or not clean:
        return [], []
    words = train.select(
        (F.col("toxic") > 0).alias("toxic"),
        per_text(_contexts, "struct<words: array<string>, near: array<string>>")("text").alias("c"),
    ).select("toxic", F.explode(F.arrays_zip("c.words", "c.near")).alias("x")).select("toxic", "x.words", "x.near")
    counts = words.groupBy("words").agg(F.count_if("toxic").alias("pos"), F.count_if(~F.col("toxic")).alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (toxic + 1)) - F.log((F.col("neg") + 0.5) / (clean + 1))
    # The support alone bounds these: a hundred times the distinct words of a toxic text at most.
    likely = counts.where((F.col("pos") >= max(MIN_ROWS, MIN_SHARE * toxic)) & (odds >= MIN_LOG_ODDS))
    around = (
        words.where("toxic")
        .join(bounded(written(likely.select("words", "pos"), "likely"), 64), "words")
        .groupBy("words", "pos")
        .agg(F.countDistinct("near").alias("kinds"))
        .where(F.col("kinds") >= MIN_DIVERSITY * F.col("pos"))
    )
    terms = sorted(r.words for r in around.collect())
    if not terms:
        return [], []
    sent = train.sparkSession.sparkContext.broadcast(terms)

    def near():
        lexicon = Lexicon(sent.value)
        return lambda word: ((lexicon.nearest(word) or 0) > 0,)

    # The counts are a few bytes a word, which would end up in few tasks; the walks are dealt out anew.
    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    innocent = (
        counts.where((F.col("neg") >= MIN_INNOCENT) & (F.length("words") <= max(map(len, terms)) + 2))
        .repartition(parts)
        .where(per_text(near, "struct<near: boolean>")("words")["near"])
        .select("words")
    )
    return terms, sorted(r.words for r in innocent.collect())


def learn(documents: DataFrame, labels: DataFrame) -> tuple[list[str], list[str], list[float]]:
    """Lexicon, innocent neighbours of it, and the weights of the logistic model."""
    train = written(training_rows(documents, labels), "toxic")
    terms, innocent = learn_lexicon(train)
    rows = train.select("toxic", _masses(train, terms, innocent)(F.col("text")).alias("m")).select("toxic", "m.*").collect()
    if not rows:
        return terms, innocent, list(PRIOR)
    x = np.array([(r.exact, r.near, r.quoted) for r in rows])
    return terms, innocent, fit(x, np.array([float(r.toxic > 0) for r in rows]))


def _masses(df: DataFrame, terms: list[str], innocent: list[str]):
    sent = df.sparkSession.sparkContext.broadcast((terms, innocent))

    def make() -> Callable:
        lexicon = Lexicon(sent.value[0], frozenset(sent.value[1]))
        return lambda text: masses(lexicon, text)

    return per_text(make, "struct<exact: double, near: double, quoted: double>")


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: fold, score, verdict, and the masses behind them."""
    terms, innocent, w = learn(documents, labels)
    found = _masses(documents, terms, innocent)
    rows = documents.select(col("doc_id").alias("doc_id"), found(col("text")).alias("m"))
    logit = w[0] + w[1] * F.col("m.exact") + w[2] * F.col("m.near") + w[3] * F.col("m.quoted")
    return rows.withColumn("score", 1 / (1 + F.exp(-logit))).select(
        "doc_id",
        (remainder(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.col("m.exact").alias("exact_mass"),
        F.col("m.near").alias("misspelled_mass"),
        F.col("m.quoted").alias("quoted_mass"),
    )

"""Secret scans with formats learned by grammar inference.

Fixed patterns find the labelled credentials: values assigned to telling names, access keys, long
hexadecimal strings. From a bounded sample of them (``SAMPLE_DOCS`` documents by hash, ``SAMPLE``
values a kind) one probabilistic automaton a kind is inferred, and one from ``ORDINARY`` of the long ordinary
tokens beside them, among which addresses, numbers and capitals are rare (without those that prove to be
credentials, once it is there): the values form a prefix tree over character classes, and states whose counts of
endings and of each next class are statistically compatible (Hoeffding's bound, at every pair of
states that the merge would fold together) are merged, red and blue as usual. Every long token with letters
and digits that no fixed pattern covers is then scored: where a credential automaton gives it
more than ``MIN_BITS`` bits a character over the ordinary one, its span is added as ``learned``.

Offsets count code points, ends are exclusive. Null and empty texts have no spans. Without labelled
credentials in the sample nothing is added. Repeated rows have equal spans. An empty table gives no rows. Extra
columns are not read by ``scan`` and stay as they are in ``redact``.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, fresh, per_text, sha256_hex

SAMPLE_DOCS = 20_000
SAMPLE = 400
ORDINARY = 8000
LONGEST = 4096
ALPHA = 0.05
MIN_BITS = 0.5
REDACTED = "[REDACTED]"
KINDS = ("assign", "access", "hex", "learned")
# Fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
MIN_VALUE = 12

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and not overlapping within a kind. Runs of one class are
    maximal, so asking for their length in the pattern finds what dropping short ones would."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def other_tokens(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Long tokens that do not lie wholly inside one span."""
    out = []
    for m in TOKEN.finditer(text):
        if not any(a <= m.start() and m.end() <= b for a, _, b in spans):
            out.append(m.span())
    return out


def ordinary_tokens(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Long tokens that no span touches."""
    return [(x, y) for x, y in other_tokens(text, spans) if not any(a < y and x < b for a, _, b in spans)]


def _classes() -> dict[int, str]:
    out = {}
    for c in range(128):
        x = chr(c)
        out[c] = "0" if x.isdigit() else "h" if x in "abcdef" else "l" if x.islower() else "H" if x in "ABCDEF" else "U" if x.isupper() else x
    return out


_CLASSES = _classes()


class Automaton:
    """Probabilistic automaton inferred from strings by state merging."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.seen = [0]
        self.ends = [0]
        self.next: list[dict[str, int]] = [{}]
        self.counts: list[Counter] = [Counter()]
        for v in values:
            at = 0
            self.seen[0] += 1
            for x in v.translate(_CLASSES):
                self.counts[at][x] += 1
                if x not in self.next[at]:
                    self.next[at][x] = len(self.seen)
                    self.seen.append(0)
                    self.ends.append(0)
                    self.next.append({})
                    self.counts.append(Counter())
                at = self.next[at][x]
                self.seen[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()
        self.alphabet = len({x for c in self.counts for x in c} | {""}) + 1

    def _near(self, a: int, n: int, b: int, m: int) -> bool:
        return not n or not m or abs(a / n - b / m) < self.bound * (n**-0.5 + m**-0.5)

    def _compatible(self, red: int, blue: int) -> bool:
        todo = [(red, blue)]
        while todo:
            p, q = todo.pop()
            n, m = self.seen[p], self.seen[q]
            if not self._near(self.ends[p], n, self.ends[q], m):
                return False
            for x in self.counts[p].keys() | self.counts[q].keys():
                if not self._near(self.counts[p][x], n, self.counts[q][x], m):
                    return False
                if x in self.next[p] and x in self.next[q]:
                    todo.append((self.next[p][x], self.next[q][x]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add a tree of blue states to the states that the red one already leads to."""
        todo = [(red, blue)]
        while todo:
            p, q = todo.pop()
            self.seen[p] += self.seen[q]
            self.ends[p] += self.ends[q]
            self.counts[p] += self.counts[q]
            for x, child in self.next[q].items():
                if x in self.next[p]:
                    todo.append((self.next[p][x], child))
                else:
                    self.next[p][x] = child

    def _infer(self) -> None:
        red = [0]
        blue = deque((0, x) for x in sorted(self.next[0]))
        done = {0}
        while blue:
            parent, x = blue.popleft()
            state = self.next[parent][x]
            if state in done:
                continue
            for r in red:
                if self._compatible(r, state):
                    self.next[parent][x] = r
                    self._fold(r, state)
                    # Folding may have given red states new children.
                    blue.extend((p, y) for p in red for y in sorted(self.next[p]) if self.next[p][y] not in done)
                    break
            else:
                red.append(state)
                done.add(state)
                blue.extend((state, y) for y in sorted(self.next[state]))

    def bits(self, value: str) -> float:
        """Minus the binary logarithm of the probability of a string, a class never seen counting half."""
        at, total = 0, 0.0
        for x in value.translate(_CLASSES):
            n = self.seen[at] + 0.5 * self.alphabet
            total -= math.log2((self.counts[at][x] + 0.5) / n)
            at = self.next[at].get(x, at)
        return total - math.log2((self.ends[at] + 0.5) / (self.seen[at] + 0.5 * self.alphabet))


class Formats:
    """The automata of credential kinds beside that of ordinary tokens."""

    def __init__(self, values: dict[str, list[str]]):
        self.kinds = [Automaton(v) for k, v in sorted(values.items()) if k != "ordinary" and v]
        tokens = values.get("ordinary", [])
        self.ordinary = Automaton(tokens)
        # Credentials without a telling name are among them: what a credential automaton explains better goes.
        self.ordinary = Automaton([t for t in tokens if self.gain(t) <= 0])
        self.known: dict[str, bool] = {}

    def gain(self, token: str) -> float:
        """Bits a character by which the best credential automaton beats the ordinary one."""
        if not self.kinds:
            return -math.inf
        return (self.ordinary.bits(token) - min(k.bits(token) for k in self.kinds)) / len(token)

    def is_secret(self, token: str) -> bool:
        """Whether the formats make a token a credential; short tokens are remembered up to a bound."""
        verdict = self.known.get(token)
        if verdict is None:
            verdict = self.gain(token) > MIN_BITS
            if len(token) <= 64:
                if len(self.known) >= 50_000:
                    self.known.clear()
                self.known[token] = verdict
        return verdict

    def spans(self, text: str) -> list[Span]:
        found = base_spans(text)
        more = [(a, 3, b) for a, b in other_tokens(text, found) if self.is_secret(text[a:b])]
        return sorted(found + more)


def _labelled():
    """Kind and value of the credentials and of the ordinary long tokens of a text."""

    def run(text):
        text = text or ""
        spans = base_spans(text)
        out = []
        for a, kind, b in spans:
            value = ASSIGN.match(text, a)[2] if kind == 0 else text[a:b]
            out.append((KINDS[kind], value))
        out += [("ordinary", text[a:b]) for a, b in ordinary_tokens(text, spans)]
        out = [(k, v) for k, v in out if len(v) <= LONGEST]
        kinds, values = zip(*out, strict=True) if out else ((), ())
        return list(kinds), list(values)

    return run


def learn(df: DataFrame, text: str = "text") -> dict[str, list[str]]:
    """A bounded sample of labelled strings: the values with the smallest hashes, of documents with
    small hashes."""
    total = df.count()
    share = min(1.0, SAMPLE_DOCS / max(1, total))
    rows = df.select(col(text).alias("text")).where(
        F.pmod(F.xxhash64(F.lit("formats"), "text"), F.lit(1 << 20)) <= int(share * (1 << 20))
    )
    found = (
        rows.select(per_text(_labelled, "struct<kinds: array<string>, vals: array<string>>")("text").alias("r"))
        .select(F.explode(F.arrays_zip("r.kinds", "r.vals")).alias("x"))
        .select(F.col("x.kinds").alias("kind"), F.col("x.vals").alias("value"))
        .distinct()
        .withColumn("h", F.xxhash64("value"))
        .withColumn("most", F.when(F.col("kind") == "ordinary", ORDINARY).otherwise(SAMPLE))
    )
    # The smallest hashes of parts of a kind first: nearly all tokens are of one kind.
    for keys in (["kind", F.pmod("h", F.lit(64))], ["kind"]):
        found = found.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy("h", "value"))).where("place <= most")
    out: dict[str, list[str]] = {}
    for kind, value in sorted((r.kind, r.value) for r in found.collect()):
        out.setdefault(kind, []).append(value)
    return out


def _formats(df: DataFrame):
    """The automata, inferred once and sent to the tasks; their size follows from the sample's bounds."""
    formats = Formats(learn(df))
    return df.sparkSession.sparkContext.broadcast(formats)


def _joined(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def scan(df: DataFrame) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    sent = _formats(df)

    def make():
        formats = sent.value

        def run(text):
            spans = formats.spans(text or "")
            base = [s for s in spans if s[1] < 3]
            n = Counter(s[1] for s in base)
            return n[0], n[1], n[2], sha256_hex(_joined(base).encode()), _joined(spans)

        return run

    found = per_text(make, "struct<n_assign: bigint, n_access: bigint, n_hex: bigint, base_sha256: string, spans: string>")
    return df.select(col("doc_id"), found(col("text")).alias("r")).select("doc_id", "r.*")


def redact(df: DataFrame) -> DataFrame:
    """``df`` with every found secret in ``text`` replaced; ``n_chars``, where there is one, follows."""
    sent = _formats(df)

    def make():
        formats = sent.value

        def run(text):
            if text is None:
                return (None,)
            out, at = [], 0
            for a, _, b in formats.spans(text):
                if a >= at:
                    out += (text[at:a], REDACTED)
                at = max(at, b)
            return ("".join(out) + text[at:],)

        return run

    (name,) = fresh(df, "redacted")
    df = df.withColumn(name, per_text(make, "struct<text: string>")(col("text"))["text"])
    changed = ~col(name).eqNullSafe(col("text"))
    columns = {"text": col(name)}
    if "n_chars" in df.columns:
        columns["n_chars"] = F.when(changed, F.length(col(name)).cast(df.schema["n_chars"].dataType)).otherwise(col("n_chars"))
    return df.withColumns(columns).drop(name)

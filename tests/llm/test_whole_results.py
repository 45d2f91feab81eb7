"""Learned operators recomputed in plain Python over whole tables, from their definitions."""

import collections
import math

import pytest
import xxhash

from lectern.llm import language, resampling, toxicity

M64 = (1 << 64) - 1


# -- toxicity -------------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_masses(text, terms, innocent, known):
    """Every word against every term, one by one."""
    words = toxicity.words_at_blanks(text)
    exact = near = quoted = 0.0
    for at, word in enumerate(words):
        w = toxicity.bare(word)
        if w not in known:
            reach = [levenshtein(w, t) for t in terms if abs(len(w) - len(t)) <= toxicity.edits_allowed(len(t))]
            sizes = [toxicity.edits_allowed(len(t)) for t in terms if abs(len(w) - len(t)) <= toxicity.edits_allowed(len(t))]
            found = [d for d, k in zip(reach, sizes, strict=True) if d <= k]
            known[w] = min(found) if found and (w in terms or w not in innocent) and len(w) >= toxicity.MIN_TERM - 1 else None
        if known[w] is not None:
            share = toxicity.quoted_share(words, at)
            quoted += share
            if known[w]:
                near += 1 - share
            else:
                exact += 1 - share
    return math.log1p(exact), math.log1p(near), math.log1p(quoted)


@pytest.mark.parametrize("table", ["small", "odd"])
def test_toxicity_of_every_document(spark, request, labels, table):
    df = request.getfixturevalue(table)
    marks = spark.read.parquet("/root/testdata/sf0.001/labels.parquet") if table == "small" else labels
    if table == "small":  # enough toxic rows for a lexicon
        rude = [(10_000 + i, f"you w{i} zzgrunk x{i} and y{i} VILEWORD! z{i} he said \"zzgrunk v{i}\" zzgrunc, vilewrd", "en", "s", 1) for i in range(40)]
        df = df.unionByName(spark.createDataFrame(rude, df.schema))
        marks = marks.select("doc_id", "toxic").unionByName(spark.createDataFrame([(r[0], 1) for r in rude], marks.select("doc_id", "toxic").schema))
    terms, innocent, w = toxicity.learn(df, marks)
    assert table == "odd" or "zzgrunk" in terms
    known, want = {}, collections.Counter()
    for r in df.collect():
        m = plain_masses(r.text, terms, set(innocent), known)
        score = 1 / (1 + math.exp(-(w[0] + sum(a * b for a, b in zip(w[1:], m, strict=True)))))
        want[r.doc_id, round(score, 9), int(score >= 0.5), *(round(x, 9) for x in m)] += 1
    got = collections.Counter(
        (r.doc_id, round(r.score, 9), r.predicted, *(round(x, 9) for x in (r.exact_mass, r.misspelled_mass, r.quoted_mass)))
        for r in toxicity.score(df, marks).collect()
    )
    assert got == want


# -- importance -----------------------------------------------------------------------


def shape(word):
    out = []
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c
        if out[-1:] != [kind]:
            out.append(kind)
    return "".join(out)


def plain_buckets(text):
    """Buckets of words and pairs, then of shapes and their pairs, in whole numbers."""
    out = []
    for half, form in ((0, str.lower), (resampling.BUCKETS // 2, shape)):
        h = [xxhash.xxh3_64_intdigest(form(w).encode("utf-8", "replace")) for w in (text or "").split()]
        pairs = []
        for a, b in zip(h, h[1:], strict=False):
            p = (a * 0x9E3779B97F4A7C15 + b) & M64
            pairs.append(p ^ (p >> 31))
        out += [((x * 0xC2B2AE3D27D4EB4F & M64) >> (64 - 13)) + half for x in h + pairs]
    return out


@pytest.mark.parametrize("table", ["small", "odd"])
def test_importance_of_every_document(spark, request, labels, table):
    df = request.getfixturevalue(table)
    marks = spark.read.parquet("/root/testdata/sf0.001/labels.parquet") if table == "small" else labels
    rows = df.collect()
    good = {r.doc_id for r in marks.collect() if r.quality == 1 and r.doc_id is not None}
    raw = collections.Counter(b for r in rows for b in plain_buckets(r.text))
    target = collections.Counter(b for r in rows if r.doc_id in good for b in plain_buckets(r.text))
    ratio = {}
    half = resampling.BUCKETS // 2
    for lo in (0, half):
        whole = sum(raw[b] + 0.01 for b in range(lo, lo + half))
        mass = sum(target[b] for b in range(lo, lo + half))
        for b in range(lo, lo + half):
            q = (raw[b] + 0.01) / whole
            ratio[b] = math.log((target[b] + 100 * q) / (mass + 100) / q) if mass else 0.0
    want = collections.Counter()
    for r in rows:
        at = plain_buckets(r.text)
        weight = sum(ratio[b] for b in at) / len(at) * 2 * min(len(at) / 2, resampling.MAX_GRAMS) if at else 0.0
        want[r.doc_id, len(at), round(weight, 4)] += 1
    got = collections.Counter((r.doc_id, r.n_grams, round(r.log_weight, 4)) for r in resampling.weigh(df, marks).collect())
    assert sum(((got - want) + (want - got)).values()) <= len(rows) // 50  # roundings to the other side


# -- language -------------------------------------------------------------------------


def softmax(logs):
    top = max(logs)
    odds = [math.exp(x - top) for x in logs]
    return [x / sum(odds) for x in odds]


def plain_fusion(rows, model):
    """Posteriors of (doc_id, text, declared, host), evidence counted by loops."""
    size = len(model.languages)
    zero = [0.0] * size
    known = []
    for doc, text, declared, host in rows:
        n, logs = model.log_likelihood(text)
        suffix = host.rpartition(".")[2] if host and "." in host else None
        parts = (host or "").split(".")
        domain = ".".join(parts[-2:]) if len(parts) > 1 and all(parts[-2:]) else None
        known.append((doc, n, logs, softmax(logs) if n else zero, declared, host, domain, suffix))
    totals = [sum(k[3][i] for k in known) for i in range(size)]
    overall = [language.OTHER_PRIOR if i == size - 1 else (totals[i] + 1) / (sum(totals) + size) for i in range(size)]

    def counts(place):
        out = collections.defaultdict(lambda: list(zero))
        for k in known:
            if k[place] is not None:
                for i in range(size):
                    out[k[place]][i] += k[3][i]
        return out

    by = {place: counts(place) for place in (4, 5, 6, 7)}

    def smooth(k, place, parent):
        seen = by[place][k[place]] if k[place] is not None else zero
        own = k[3] if k[place] is not None else zero
        left = [max(0.0, a - b) for a, b in zip(seen, own, strict=True)]
        return [(a + language.STRENGTH * p) / (sum(left) + language.STRENGTH) for a, p in zip(left, parent, strict=True)]

    def evidence(k, place):
        if k[place] is None:
            return zero
        return [math.log((max(0.0, by[place][k[place]][i] - k[3][i]) + 0.5) / (totals[i] + 25)) for i in range(size)]

    out = []
    for k in known:
        at = smooth(k, 5, smooth(k, 6, overall))
        suffix, declared = evidence(k, 7), evidence(k, 4)
        fused = softmax([k[2][i] + math.log(at[i]) + suffix[i] + declared[i] for i in range(size)])
        best = max(fused)
        name = model.languages[fused.index(best)]
        alone = name == language.OTHER and k[4] not in (None, "") and k[4] not in model.languages and k[1] > 0
        lang = k[4] if alone else name
        out.append((k[0], lang, best, k[1], bool(alone or (lang != language.OTHER and best > 0.5 and k[1] > 0))))
    return out


@pytest.mark.parametrize("table", ["small", "odd"])
def test_language_of_every_document(request, table):
    df = request.getfixturevalue(table)
    rows = [(r.doc_id, r.text, r.lang and r.lang.lower(), None if r.source is None else r.source.lower()) for r in df.collect()]
    want = collections.Counter((d, x, round(p, 4), n, k) for d, x, p, n, k in plain_fusion(rows, language.learn(df, "text", "lang")))
    got = collections.Counter((r.doc_id, r.lang_id, round(r.posterior, 4), r.n_grams, r.kept) for r in language.identify_documents(df).collect())
    assert sum(((got - want) + (want - got)).values()) <= len(rows) // 50


def test_language_of_hosts_and_suffixes(spark):
    """Hosts with domains and suffixes, declared languages that disagree, many languages."""
    import random

    rng = random.Random(3)
    words = {f"l{n}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(12)] for n in range(30)}
    rows = []
    for n, (lang, own) in enumerate(sorted(words.items()) * 6):
        host = rng.choice([None, f"www.{lang}.org", f"a.{lang}.de", "shared.com", "x", "."])
        declared = rng.choice([lang, lang, None, "l1", "zz"])
        rows.append((n, " ".join(rng.choice(own) for _ in range(rng.choice([0, 1, 25]))), declared, host))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    model = language.learn(df, "text", "lang")
    assert len(model.languages) > 25
    want = collections.Counter((d, x, round(p, 4), n, k) for d, x, p, n, k in plain_fusion(rows, model))
    got = collections.Counter((r.doc_id, r.lang_id, round(r.posterior, 4), r.n_grams, r.kept) for r in language.identify_documents(df).collect())
    assert sum(((got - want) + (want - got)).values()) <= len(rows) // 50

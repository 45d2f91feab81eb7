"""Operators that learn or estimate: pairs, languages, toxicity, selection."""

import collections
import glob
import hashlib
import math
import random
import time

import numpy as np
import pytest

from lectern.llm import common, language, order_minhash, resampling, toxicity
from lectern.llm.common import words_of

SF = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


# -- near-duplicates --------------------------------------------------------------


def test_banded_alignment():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        d = distance(a, b)
        for most in (0, 2, 5, 12):
            assert order_minhash.edit_distance_within(a, b, most) == (d if d <= most else None)


def test_similar_is_edit_similarity():
    rng = random.Random(7)
    for _ in range(300):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 30))]
        b = [x for x in a if rng.random() > 0.1] + [rng.choice("ab")] * rng.randint(0, 3)
        want = 1 - distance(a, b) / max(len(a), len(b)) >= 0.8 - 1e-12
        assert order_minhash.similar(" ".join(a), " ".join(b)) == want


def test_order_counts():
    ids = lambda words: np.array([hash(w) & 0xFFFFFFFF for w in words], dtype=np.uint64)
    parts = [[f"{p}{i}" for i in range(30)] for p in "abcdefgh"]
    one = sum(parts, [])
    turned = sum(reversed(parts), [])
    near = one[:100] + ["new"] + one[101:]
    agree = lambda x, y: sum(p == q for p, q in zip(order_minhash.sketches(ids(x)), order_minhash.sketches(ids(y)), strict=True))
    assert agree(one, one) == order_minhash.SKETCHES
    assert agree(one, near) > agree(one, turned)
    # Repeats count: the same set of shingles, another number of them.
    assert order_minhash.sketches(ids(["x"] * 20)) != order_minhash.sketches(ids(["x"] * 40))


def classes_of(df):
    return {r.doc_id: r.class_id for r in order_minhash.near_duplicates(df).collect()}


def brute_components(texts):
    """Connected components of edit similarity over all pairs."""
    ids = list(texts)
    label = {i: i for i in ids}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = words_of(texts[a]), words_of(texts[b])
            same = texts[a] == texts[b] if not x or not y else order_minhash.similar(texts[a], texts[b])
            if same and top(a) != top(b):
                label[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def planted(rng, groups, copies, words=150):
    texts, n = {}, 0
    for _ in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], ["new"], [w[i], "more"]])
            texts[n] = " ".join(w)
            n += 1
    passage = " ".join(f"p{i}" for i in range(30))
    for _ in range(40):
        texts[n] = " ".join([f"w{rng.randrange(5000)}" for _ in range(100)]) + " " + passage
        n += 1
    return texts


def test_planted_groups(spark):
    texts = planted(random.Random(3), 8, 12)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    assert classes_of(df) == brute_components(texts)


def test_recall_on_given_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = classes_of(df)
    texts = {r.doc_id: r.text for r in df.collect()}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, words_of(t)) for i, t in texts.items())}
    where = collections.defaultdict(list)
    for i, s in shingles.items():
        for x in s:
            where[x].append(i)
    shared = collections.Counter((b, a) for v in where.values() for n, a in enumerate(v) for b in v[:n])
    close = [(a, b) for (a, b), c in shared.items() if c >= 0.8 * (len(shingles[a]) + len(shingles[b]) - c)]
    assert close
    assert sum(got[a] == got[b] for a, b in close) >= 0.99 * len(close)
    members = collections.defaultdict(list)
    for i, c in got.items():
        members[c].append(i)
    for group in members.values():
        for a in group[1:]:
            assert any(order_minhash.similar(texts[a], texts[b]) or texts[a] == texts[b] for b in group if b != a)


def test_pairs_under_a_passage_of_a_third_of_the_rows(spark):
    """Near copies that share only buckets of a passage with many others, and never lead them."""
    rng = random.Random(9)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = [f"p{i}" for i in range(200)]
    texts = {}
    for n in range(100):  # too long for the pair, and at most 0.65 similar to each other
        texts[n] = " ".join(passage + own(110 + n))
    for n in (100, 101):  # 0.91 similar
        texts[n] = " ".join(passage + own(20))
    for n in range(102, 300):
        texts[n] = " ".join(own(60))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = classes_of(df)
    assert got[100] == got[101] == 100
    assert got == brute_components(texts)


def test_every_pair_of_a_bucket_is_compared(spark, monkeypatch):
    """One sketch for all: the leaders of the only bucket are similar to none of the pairs in it."""
    rng = random.Random(10)

    def one_sketch():
        def run(text):
            words = words_of(text)
            return hashlib.md5(b" ".join(words)).digest(), len(words), [1]

        return run

    monkeypatch.setattr(order_minhash, "_sketcher", one_sketch)
    for size in (4, 15, 40):
        texts = {}
        for n in range(0, 2 * size, 2):
            body = [f"w{rng.randrange(10**6)}" for _ in range(60)]
            texts[n], texts[n + 1] = " ".join(body), " ".join([*body[:-1], "end"])
        df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
        assert classes_of(df) == brute_components(texts)


@pytest.mark.parametrize("label_bytes", [64, 1 << 40])
def test_later_links_tie_earlier_components(spark, monkeypatch, label_bytes):
    """Only the new links come in; a label is the smallest member whether labels are broadcast or shuffled."""
    monkeypatch.setattr(order_minhash, "LABEL_BYTES", label_bytes)
    rng = random.Random(9)
    sets = [{(x, y) for x, y in (rng.sample(range(120), 2) for _ in range(n))} for n in (50, 25)]
    frames = [spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in x], "a binary, b binary") for x in sets]
    found = order_minhash._relabelled(order_minhash.components(frames[0]), frames[1])
    want = {x: x for pair in sets[0] | sets[1] for x in pair}
    for _ in range(120):
        for a, b in sets[0] | sets[1]:
            want[a] = want[b] = min(want[a], want[b])
    assert sorted((r.cid[0], r.label[0]) for r in found.collect()) == sorted(want.items())


def test_shuffle_files_of_written_tables_go(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [d.getPath() for d in manager.localDirs()]
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, key = files(), spark.conf.get(common.SHUFFLES_GO, None)
    table = common.written(spark.range(1000).repartition(3, "id"), "go")
    assert spark.conf.get(common.SHUFFLES_GO, None) == key
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before
    assert table.count() == 1000


def test_batches_to_python_are_bounded_by_bytes(spark):
    before = spark.conf.get(common.BATCHES)
    try:
        for now, then in (("64m", str(common.BATCH_BYTES)), ("1m", "1m")):
            spark.conf.set(common.BATCHES, now)
            common.per_text(lambda: lambda text: (1,), "struct<n: int>")
            assert common.size_of(spark.conf.get(common.BATCHES)) == common.size_of(then)
        wide = spark.range(0, 4000, 1, 1).select(common.F.repeat(common.F.lit("x"), 2000).alias("text"))
        rows = wide.mapInArrow(lambda batches: (b.slice(0, 1) for b in batches), "text string")
        assert rows.count() >= 7
    finally:
        spark.conf.set(common.BATCHES, before)


def test_tasks_drop_what_other_operators_held(monkeypatch):
    monkeypatch.setattr(common, "_HELD", {})
    tables = lambda: common.held("tables", lambda: [1])
    first = common._started(tables)
    assert common._started(tables) is first
    common._started(lambda: len)
    assert common._HELD == {}


def test_odd_rows_of_dedup(spark, odd, nothing, clashing):
    rows = order_minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.class_id)
    assert by[1] == by[2] == {1} and by[3] == by[4] == {3}  # copies; null and empty
    assert by[6] == {6} and by[7] == {7}
    assert order_minhash.near_duplicates(nothing).collect() == []
    stay = order_minhash.one_of_each(clashing)
    assert stay.columns == clashing.columns
    texts = [(r.doc_id, r.text) for r in stay.collect()]
    assert len(texts) == len({r.class_key for r in rows}) and texts.count((1, odd.first().text)) == 1
    assert order_minhash.one_of_each(nothing).collect() == []


# -- language ---------------------------------------------------------------------

PROSE = {
    "en": "the house by the river was old and the water ran under it with a sound of stones".split(),
    "de": "das haus am fluss war alt und das wasser lief unter ihm mit einem klang von steinen".split(),
}


def sentences(rng, lang, n):
    return " ".join(rng.choice(PROSE[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(4)
    rows = [(i, sentences(rng, ("en", "de")[i % 2], 30), ("en", "de")[i % 2], f"s{i % 3}.example.org") for i in range(80)]
    rows += [(200, "Привет как дела сегодня очень хорошо спасибо", None, "s1.example.org"), (201, "12 34 !!", "en", "s1.example.org")]
    rows += [(202, sentences(rng, "de", 30), "en", "s0.example.org"), (203, sentences(rng, "de", 20), None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")


def test_languages(spoken):
    got = {r.doc_id: r for r in language.identify_documents(spoken).collect()}
    assert all(got[i].lang_id == ("en", "de")[i % 2] and got[i].kept for i in range(80))
    assert not got[200].kept and not got[201].kept  # another script, no letters
    assert got[202].lang_id == "de" and got[203].lang_id == "de"  # the text outweighs a wrong declaration
    assert {r.doc_id for r in language.keep_identified(spoken).collect()} == {*range(80), 202, 203}


def test_evidence_decides_where_the_text_is_mute(spark):
    rng = random.Random(5)
    rows = [(f"<html lang='{x}'><p>{sentences(rng, x, 30)}</p>", f"http://{x}{i % 4}.site.{x}/a", x) for i in range(60) for x in ("en", "de")]
    rows += [("<html lang='de'><p>xyz</p><script>the the</script>", "http://de1.site.de/b", None), ("<p>xyz</p>", "http://en1.site.en/b", None)]
    docs = spark.createDataFrame([(sentences(rng, x, 30), x) for _ in range(60) for x in ("en", "de")], "text string, lang string")
    pages = spark.createDataFrame([(i, h, u) for i, (h, u, _) in enumerate(rows)], "page_id bigint, html string, url string")
    got = {r.page_id: r.lang_id for r in language.identify_pages(pages, docs).collect()}
    assert all(got[i] == x for i, (_, _, x) in enumerate(rows) if x)
    assert got[120] == "de" and got[121] == "en"


def test_small_languages_beside_a_large_one_and_a_hot_text(spark):
    rng = random.Random(6)
    small = "nyumba karibu na mto ilikuwa ya zamani na maji yalipita chini yake kwa sauti ya mawe".split()
    rows = [(sentences(rng, "en", 12), "en") for _ in range(12_000)] + [(sentences(rng, "de", 12), "de")] * 4000
    rows += [(" ".join(rng.choice(small) for _ in range(12)), "sw") for _ in range(55)]
    rows += [("ⴰⵣⵓⵍ ⴼⵍⵍⴰⵡⵏ ⵎⴰⵏⵉ ⵜⵍⵍⴰⵎ", "zgh"), ("ⴰⵣⵓⵍ ⴼⵍⵍⴰⵡⵏ ⵎⴰⵏⵉ ⵜⵍⵍⴰⵎ", None)]
    rows = [(i, *r, "s1") for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    assert language.learn(df, "text", "lang").languages == ["en", "sw", "und"]  # one distinct text is no model
    got = {r.doc_id: r for r in language.identify_documents(df).collect()}
    assert all(got[i].lang_id == "sw" and got[i].kept for i in range(16_000, 16_055))
    assert got[16_055].lang_id == "zgh" and got[16_055].kept and not got[16_056].kept


def test_odd_rows_of_language(odd, nothing, clashing):
    rows = language.identify_documents(odd).collect()
    assert len(rows) == odd.count()
    assert not any(r.kept for r in rows if r.doc_id in (3, 4, 6, 7))
    assert language.identify_documents(nothing).collect() == []
    assert language.keep_identified(nothing).collect() == []
    assert language.keep_identified(clashing).columns == clashing.columns


# -- toxicity ---------------------------------------------------------------------


def test_automaton_finds_the_nearest_term():
    terms = "scum moron loser trash worthless disgusting".split()
    lexicon = toxicity.Lexicon(terms)
    rng = random.Random(3)
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "0", "e", "s"])
        word = "".join(w)
        near = [d for t in terms if (d := distance(t, word)) <= toxicity.edits_allowed(len(t))]
        assert lexicon.nearest(word) == min(near, default=None)


def test_context_tells_quotation_from_abuse():
    share = lambda text: toxicity.quoted_share(w := toxicity.words_at_blanks(text), next(i for i, x in enumerate(w) if "moron" in x))
    assert share("what a moron he is") == 0
    assert share('the word "moron" is an insult') == 1
    assert 0 < share('he wrote about "some moron there" yesterday') <= 1
    assert share("you moron go away") == 0


def held_out_scores(spark):
    df, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.score(df, labels).collect() if r.held_out and r.doc_id in want]
    return [r.score for r in rows], [want[r.doc_id] for r in rows]


def test_held_out_accuracy(spark):
    scores, labels = held_out_scores(spark)
    assert sum((s >= 0.5) == (y > 0) for s, y in zip(scores, labels, strict=True)) >= 0.93 * len(labels)


def test_odd_rows_of_toxicity(spark, odd, nothing, clashing, labels):
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r in rows if r.doc_id in (3, 4, 6)}
    assert len(blank) == 1
    assert toxicity.score(nothing, labels).collect() == []
    assert len(toxicity.score(clashing, labels.limit(0)).collect()) == odd.count()


def test_labels_of_the_held_out_fold_are_not_read(spark):
    rows = [(i, f"word{i % 7} and {'moron' if i % 3 == 0 else 'friend'} w{i}", "en") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    marks = [(i, 1, int(i % 3 == 0)) for i in range(200)]
    import zlib

    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in marks]
    schema = "doc_id bigint, quality int, toxic int"
    one, two = (sorted(map(tuple, toxicity.score(df, spark.createDataFrame(m, schema)).collect())) for m in (marks, turned))
    assert one == two
    assert {r[0] for r in one if r[3]} == {i for i in range(200) if i % 3 == 0}


def test_copies_of_toxic_texts_leave_the_lexicon_as_it_is(spark):
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    rows = [(f"{say(6)} trash {say(6)}", 1) for _ in range(60)] + [(say(13), 0) for _ in range(120)]
    rows += [(f"{say(6)} trash {say(6)}", 1)] * 80  # copies of one text with the term
    rows += [(" ".join(f"odd{i}word" for i in range(600)), 1)] * 80  # a long text of rare words
    rows = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    terms, _ = toxicity.learn_lexicon(toxicity.training_rows(df.select("doc_id", "text"), df.select("doc_id", "toxic")))
    assert terms == ["trash"]


def test_lexicon_has_as_many_terms_as_stand_the_tests(spark):
    rng = random.Random(12)
    kinds = [f"slur{i:03d}" for i in range(600)]
    rows = [(" ".join(x for t in rng.sample(kinds, 300) for x in (f"a{rng.randrange(999)}", t)), 1) for _ in range(40)]
    rows += [(" ".join(f"a{rng.randrange(999)}" for _ in range(40)), 0) for _ in range(40)]
    train = spark.createDataFrame(rows, "text string, toxic int")
    assert set(toxicity.learn_lexicon(train)[0]) >= set(kinds)


# -- selection --------------------------------------------------------------------


def test_selection_is_the_exact_top(spark):
    df, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = resampling.resample(df, labels).collect()
    kept = sorted(r.gumbel for r in rows if r.kept)
    dropped = [r.gumbel for r in rows if not r.kept]
    assert len(kept) == math.ceil(resampling.SHARE * len(rows)) and kept[0] >= max(dropped) - 2e-6
    good = {r.doc_id: r.quality for r in labels.collect()}
    weight = {q: np.median([r.log_weight for r in rows if good.get(r.doc_id) == q]) for q in (0, 1)}
    assert weight[1] > 0 > weight[0]
    assert np.mean([r.kept for r in rows if good.get(r.doc_id) == 1]) > 0.95


def test_ratio_of_models_in_plain_python(spark, small):
    known, raw = resampling.Grams(), np.zeros(resampling.BUCKETS)
    for r in small.collect():
        raw += np.bincount(resampling.gram_buckets(known, r.text), minlength=resampling.BUCKETS)
    assert (resampling.gram_counts(small.select("text")) == raw).all()


def test_chances_follow_importance():
    rng = np.random.default_rng(1)
    weight = np.log(np.array([1.0, 2.0, 4.0]))
    first = np.bincount([np.argmax(weight + rng.gumbel(size=3)) for _ in range(20000)]) / 20000
    assert np.allclose(first, [1 / 7, 2 / 7, 4 / 7], atol=0.02)


def test_cut_with_ties(spark):
    values = [5, 5, 5, 9, 1, 1 << 47, 0, 5]
    rows = spark.createDataFrame([(v,) for v in values], "key bigint")
    for k in range(1, len(values) + 1):
        cut, ties = resampling.top_cut(rows, "key", k)
        assert cut == sorted(values, reverse=True)[k - 1]
        assert sum(v > cut for v in values) + ties == k


def test_odd_rows_of_selection(odd, nothing, clashing, labels):
    rows = resampling.resample(odd, labels).collect()
    assert len(rows) == odd.count() and sum(r.kept for r in rows) == math.ceil(resampling.SHARE * len(rows))
    assert resampling.resample(nothing, labels).collect() == []
    assert len(resampling.resample(clashing, labels.limit(0)).collect()) == len(rows)

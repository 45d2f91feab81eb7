"""Source audit, WARC archives, collocations: brute force, odd rows, cut streams."""

import base64
import collections
import gzip
import hashlib
import io
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from lectern.llm import audit, collocations, warc
from lectern.session import scratch_path
from tests.llm.conftest import DOCS, bag

# -- audit --------------------------------------------------------------------------


def expected_audit(rows, least, top):
    groups, docs, counts = set(), collections.Counter(), collections.Counter()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts.update((lang, source, w) for w in words)
        docs.update((lang, w) for w in set(words))
    out = []
    for lang in {x for x, _ in groups}:
        terms = [w for (x, w), n in docs.items() if x == lang and n >= least]
        sources = sorted(s for x, s in groups if x == lang)
        total = {s: sum(counts[lang, s, w] for w in terms) for s in sources}
        share = lambda n, of: 1 + 10**9 * (n + 5) // (of + 5 * len(terms))
        p = {s: {w: share(counts[lang, s, w], total[s]) for w in terms} for s in sources}
        q = {w: share(sum(counts[lang, s, w] for s in sources), sum(total.values())) for w in terms}
        for s in sources:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in terms), o.encode(), o) for o in sources if o != s]
            sticking = [(q[w] - p[s][w], w.encode(), w) for w in terms if counts[lang, s, w] and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(sticking)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def audited(df, **how):
    return sorted(tuple(r) for r in audit.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect())


def plain(df):
    return [(r.lang, r.source, r.text) for r in df.select("lang", "source", "text").collect()]


@pytest.mark.parametrize("segment", [3, 4096])
def test_audit_equals_brute_force(spark, small, segment):
    """Segments of a few terms and blocks of two sources give the same distances."""
    assert audited(small, least=5, top=50, segment=segment, block=2 if segment == 3 else 32) == expected_audit(plain(small), 5, 50)


def test_audit_of_odd_rows(spark, odd, nothing, clashing, same_with_extra_columns):
    for least in (1, 2, 99):
        assert audited(odd, least=least, top=2) == expected_audit(plain(odd), least, 2)
    assert audited(nothing) == []
    assert same_with_extra_columns(lambda df: audit.audit(df, least=1), odd, clashing)


def test_equal_subtrees_are_one_node_and_priced_once():
    forest = audit.Forest(1000)
    counts = [(i, 3) for i in range(0, 1000, 2)]
    a, b = forest.tree(counts), forest.tree(list(counts))
    assert a == b and len(forest.parts) < 40  # 1000 leaves
    empty = forest.tree([])
    known = {}
    value = forest.price(a, empty, 7000, 5000, known)
    assert len(known) < 40
    p = lambda n, below: 10**9 * (n + 5) // below
    assert value == 500 * abs(p(3, 7000) - p(0, 5000)) + 500 * abs(p(0, 7000) - p(0, 5000))


# -- WARC ---------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string"


def expected_pages(rows):
    largest = {}
    for i, _, html in rows:
        key = html or ""
        largest[key] = i if key not in largest or largest[key] is None else max(x for x in (i, largest[key]) if x is not None) if (i is not None or largest[key] is not None) else None
    out = []
    for i, _, html in rows:
        data, first = (html or "").encode(), largest[html or ""]
        repeats = i != first
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if repeats else "response", first if repeats else None))
    return sorted(out, key=str)


ODD_PAGES = [
    (1, "http://a/", "<p>same</p>"), (7, "http://b/ c\r\nX: y", "<p>same</p>"), (3, None, "<p>same</p>"), (None, "http://d/", "<p>same</p>"),
    (4, "http://é/", None), (5, "", ""), (6, "x", "é" * 70_000 + "\r\n\r\nWARC/1.1\r\n"), (6, "x", "é" * 70_000 + "\r\n\r\nWARC/1.1\r\n"),
    (8, "y", "\r\n\r\n"), (None, "z", "alone"), (None, "z", "alone"),
]


def test_pages_come_back_from_archives(spark):
    df = spark.createDataFrame(ODD_PAGES, PAGES)
    for file_bytes in (1, 1 << 20):
        assert bag(warc.round_trip(df, file_bytes=file_bytes)) == expected_pages(ODD_PAGES)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []
    more = spark.createDataFrame([(*r, "x", 1, "y") for r in ODD_PAGES], f"{PAGES}, payload string, first_id int, record_type string")
    assert bag(warc.round_trip(more)) == expected_pages(ODD_PAGES)


def test_a_page_of_many_rows_is_met_under_salts(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", "hot" if i % 3 else f"cold {i}") for i in range(600)]
    df = spark.createDataFrame(rows, PAGES)
    for limit in (8 << 20, 0):  # with and without a broadcast
        monkeypatch.setattr(warc, "bounded", lambda table, size, most=limit: collocations.F.broadcast(table) if most else table)
        assert bag(warc.round_trip(df)) == expected_pages(rows)


def test_payload_and_headers_survive(spark):
    root = warc.write(spark.createDataFrame(ODD_PAGES, PAGES), scratch_path(spark, "warc"), date="2024-05-01T00:00:00Z")
    rows = warc.read(spark, root, payload=True).collect()
    html = {str(i): (h or "").encode() for i, _, h in ODD_PAGES}
    responses = {r.page_id: r for r in rows if r.record_type == "response"}
    assert all(bytes(r.payload) == html[i] for i, r in responses.items() if i is not None)
    targets = {r.page_id: r.target_uri for r in rows}
    assert targets["7"] == "http://b/%20c%0D%0AX:%20y" and targets["4"] == "http://é/" and targets["3"] is None
    assert all(r.payload == b"" for r in rows if r.record_type == "revisit")
    manifest = spark.read.parquet(f"{root}/manifest").collect()
    assert sum(m.records for m in manifest) == len(ODD_PAGES)


def _archive(*records):
    return b"".join(records)


def _page(i, text, **more):
    row = {"page_id": str(i), "url": "http://a", "payload": text.encode(), "key": text, "repeats": False, "first_id": None, "first_url": None}
    return warc.record(row | more, "2024-05-01T00:00:00Z")


class _Trickle:
    """A file that hands out a few bytes at a time, and remembers how many were asked for."""

    def __init__(self, data, step):
        self.data, self.step, self.at, self.largest = data, step, 0, 0

    def read(self, n):
        self.largest = max(self.largest, n)
        out = self.data[self.at : self.at + min(n, self.step)]
        self.at += len(out)
        return out


@pytest.mark.parametrize("step", [1, 7, 100_000])
def test_members_are_read_in_any_pieces(step):
    texts = ["a" * 3000, "", "é" * 500, "\r\n\r\n"]
    data = _archive(*[_page(i, t) for i, t in enumerate(texts)])
    file = _Trickle(data, step)
    got = list(warc.read_records(file.read, keep=True))
    assert [r["payload"].decode() for r in got] == texts and [r["payload_bytes"] for r in got] == [len(t.encode()) for t in texts]
    assert file.largest <= warc.PIECE
    # One member a record: a common gzip reader sees the same bytes.
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(texts)


def test_a_large_payload_is_never_whole_in_memory():
    big = _page(1, "0123456789" * 2_000_000)
    held = []
    inflated = warc.Inflated(io.BytesIO(big).read)
    assert inflated.next_member()
    while piece := inflated.more():
        held.append(len(piece))
    assert max(held) <= warc.PIECE and sum(held) > 20_000_000
    assert next(warc.read_records(io.BytesIO(big).read))["payload"] is None


def _spoilt(change):
    raw = zlib.decompress(_page(1, "hello world"), 31)
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(change(raw)) + pack.flush()


@pytest.mark.parametrize(
    "data",
    [
        _spoilt(lambda r: r.replace(b"hello", b"jello")),
        _spoilt(lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1", 1)),
        _spoilt(lambda r: r[:-1]),
        _spoilt(lambda r: r + b"x"),
        _spoilt(lambda r: b"XARC" + r[4:]),
        _page(1, "hello world")[:-9],
    ],
    ids=["digest", "length", "end", "more", "version", "cut"],
)
def test_spoilt_records_are_errors(data):
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data).read))


def test_flipped_bits_are_errors():
    data = bytearray(_page(1, "hello world " * 50))
    data[len(data) // 2] ^= 0x10
    with pytest.raises((ValueError, zlib.error)):
        list(warc.read_records(io.BytesIO(bytes(data)).read))


# -- collocations ---------------------------------------------------------------------


def expected_phrases(rows, least, covered, top):
    counts, words_of = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            words_of[lang] += len(w)
            for k in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        longer = collections.Counter()
        for p, a in f.items():
            if len(p) == 3 and a >= least:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        found = []
        for p, a in f.items():
            if len(p) > 1 and a >= least and 100 * longer[p] < covered * a:
                score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]):  # noqa: E741
            out.append((lang, i + 1, p.decode(), -a, l, r, words_of[lang], -s))
    return sorted(out)


def phrased(df, **how):
    got = collocations.collocations(df, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r) for r in got.collect())


def pairs(df):
    return [(r.lang, r.text) for r in df.select("lang", "text").collect()]


@pytest.fixture
def many_partitions(spark):
    """Range partitions that cut through families of every level."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_phrases_equal_brute_force(spark, small):
    assert phrased(small, least=4, top=300) == expected_phrases(pairs(small), 4, 50, 300)


def test_phrases_across_partitions(spark, many_partitions):
    rng = random.Random(7)
    words = ["the", "a", "of", "x\x01", "é", "50%", "B", "-", "\x00"]
    rows = [(rng.choice(["en", "d e", "", None, "%20"]), "".join(rng.choice(words) + rng.choice([" ", " ", "\t", ". ", "\n"]) for _ in range(60))) for _ in range(80)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, n int").repartition(5)
    for least in (1, 3):
        assert phrased(df, least=least, top=10**6) == expected_phrases(rows, least, 50, 10**6)


def test_runs_travel_in_blocks_and_parts(spark, monkeypatch):
    """Few rows cross the engine, and parts that cut families of every level give the same counts."""
    rng = random.Random(11)
    words = ["the", "a", "of", "x\x01", "é", "50%", "B", "\x00", *(f"w{i}" for i in range(40))]
    rows = [(rng.choice(["en", "", None]), " ".join(rng.choice(words) for _ in range(400)) + rng.choice([".", "\n", ""])) for _ in range(40)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    made, real = [], collocations.written

    def written(table, name):
        out = real(table, name)
        made.append((name, out.count()))
        return out

    cut, cuts = [], collocations._cuts
    monkeypatch.setattr(collocations, "written", written)
    monkeypatch.setattr(collocations, "_cuts", lambda *how: cut.append(cuts(*how)) or cut[-1])
    for size, least in ((500_000, 2), (600, 2), (60, 1)):
        monkeypatch.setattr(collocations, "PART_KEYS", size)
        assert phrased(df, least=least, top=10**6) == expected_phrases(rows, least, 50, 10**6)
    assert max(n for name, n in made if name == "phrase-runs") <= 4 * 3  # a block a task and language
    assert len(cut[0]) == 0 and 5 < len(cut[1]) < len(cut[2])


def test_order_of_numbered_fields(monkeypatch):
    ids = np.random.default_rng(3).integers(0, 9, (500, 4))
    want = sorted(map(tuple, ids.tolist()))
    assert list(map(tuple, ids[collocations._in_order(ids, 9)].tolist())) == want
    monkeypatch.setattr(collocations, "WIDEST_VOCABULARY", 2)
    assert list(map(tuple, ids[collocations._in_order(ids, 9)].tolist())) == want


def test_phrases_of_odd_rows(spark, odd, nothing, clashing, same_with_extra_columns):
    for least in (1, 2):
        assert phrased(odd, least=least) == expected_phrases(pairs(odd), least, 50, 2000)
    assert phrased(nothing) == []
    assert same_with_extra_columns(lambda df: collocations.collocations(df, least=1), odd, clashing)


def test_runs_of_any_size_hold_the_same_counts(monkeypatch):
    rng = random.Random(9)
    text = " ".join(rng.choice("abcdefgh") + rng.choice(["", "", "."]) for _ in range(3000)).encode().translate(collocations._TABLE)

    def totals(held, block, widest):
        monkeypatch.setattr(collocations, "WIDEST_VOCABULARY", widest)
        runs, out = collocations._Runs(held), collections.Counter()
        for part in collocations._blocks(text, block):
            runs.add("en", part)
            if runs.full():
                for b in runs.flush():
                    out.update(dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
        for b in runs.flush():
            keys = b.column(0).to_pylist()
            assert keys == sorted(keys)
            for k, n in zip(keys, b.column(1).to_pylist(), strict=True):
                out[k] += n
        return out

    whole = totals(10**9, 10**9, 2_000_000)
    assert whole == totals(50, 100, 2_000_000) == totals(10**9, 10**9, 2)
    assert sum(whole.values()) == len(text.replace(b",", b" ").split())


def _words_of_a_task(n, many):
    rng = random.Random(13)
    return b" ".join(b"word%d" % min(int(rng.expovariate(1 / many)), 10 * many) for _ in range(n))


def test_runs_take_few_bytes_a_word():
    """A task's memory is a bound on every executor: counting takes few copies of the words held."""
    words = 400_000
    runs = collocations._Runs(10**9)
    runs.add("en", _words_of_a_task(words, 3000))
    tracemalloc.start()
    try:
        total = sum(sum(b.column(1).to_pylist()) for b in runs.flush())
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert total == words
    assert most < 45 * words + collocations._SLICE * 80


def test_long_words_fill_a_run():
    runs = collocations._Runs()
    while not runs.full():
        runs.add("en", b"x%d" % runs.held * 500_000)
        assert runs.held < 200
    assert runs.held >= 10


def test_blocks_travel_compressed(spark, monkeypatch):
    text = _words_of_a_task(60_000, 500).decode()
    df = spark.createDataFrame([("en", text)], "lang string, text string").repartition(1)
    found, real = [], collocations.written

    def written(table, name):
        out = real(table, name)
        if name == "phrase-runs":
            found.append(out.selectExpr("sum(length(keys))", "sum(length(n))", "max(length(keys))").first())
        return out

    monkeypatch.setattr(collocations, "written", written)
    got = {(r.w1, r.w2, r.w3): r.f for r in collocations.counts(df, 2).collect()}
    words = text.encode().split()
    want = collections.Counter(tuple(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    assert got.pop((b"", b"", b"")) == len(words)
    assert got == {(*p, *[b""] * (3 - len(p))): f for p, f in want.items() if f >= 2}
    keys = {tuple(words[i : i + 3]) for i in range(len(words))}
    raw = sum(len(b" ".join(k)) + 4 for k in keys)
    assert found[0][0] < raw / 2 and found[0][1] < 8 * len(keys) / 4 and found[0][2] < collocations._BLOCK_BYTES / 2


def test_scores_need_one_worker_a_task(spark, small):
    """A second step in Python within a stage would hold a second worker for each task."""
    found = collocations.counts(small, 4)
    plan = collocations.scored(found)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("MapInArrow", plan)) == 1


def test_merging_tasks_follow_the_parts():
    assert collocations._tasks(1, 12) == 1 and collocations._tasks(40, 12) == 12
    assert [-(-parts // collocations._tasks(parts, 12)) for parts in (400, 4_700, 23_500)] == [collocations.PARTS_A_TASK] * 3


def test_a_task_gives_its_memory_back():
    script = """
import re, pyarrow as pa
from lectern.llm import collocations, common
lean = getattr(common, "lean", lambda run: run)
held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
for many in (1, 150):
    before = held()
    for _ in lean(collocations._sorted_runs(500))(
        pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([" ".join(f"word{(i * 7919 + j * j) % 200003}" for j in range(20000)).encode()])], ["lang", "text"])
        for i in range(many)
    ):
        pass
print(held() - before)
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True, timeout=300)
    assert float(out.stdout) < 24


def test_sql_agrees(spark, small):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    con.sql("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for sql, df in ((audit.SQL, audit.audit(small)), (warc.SQL, warc.round_trip(pages)), (collocations.SQL, collocations.collocations(small))):
        found = con.sql(sql)
        want = sorted((tuple(r[found.columns.index(c)] for c in df.columns) for r in found.fetchall()), key=str)
        assert bag(df) == want


def test_schema_of_documents(odd):
    assert odd.schema.simpleString() == f"struct<{DOCS.replace(' ', ':').replace(',:', ',')}>"

"""Contains by index equals the scan, for any pattern."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions.filters import contains
from lectern.operators.textindex import ASKED, TextIndex, literal_pieces
from lectern.session import scratch_path

LETTERS = "abAB ñÑß%_\\çİΣσ."


@pytest.fixture(scope="module")
def columns(spark):
    return {"name": F.col("name"), "code": F.col("code")}


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice(LETTERS) for _ in range(n))
    rows = [(i, rng.choice([None, "", word(2), word(9), word(30)]), rng.choice([None, word(5), f"{i:05d}cc"])) for i in range(400)]
    return rows, spark.createDataFrame(rows, "id bigint, name string, code string")


@pytest.fixture(scope="module")
def index(spark, people, columns):
    return TextIndex.build(people[1], "id", columns, scratch_path(spark, "index"))


def _values(people):
    """Random patterns: parts of texts, with letters changed and wildcards put in, of any length."""
    rng = random.Random(5)
    texts = [t for r in people[0] for t in r[1:] if t]
    out = ["", "a", "ab", "%", "___", "zzz", "Σ", "ñÑß", "00012", "12C", "nothing of this"]
    for _ in range(14):
        t = rng.choice(texts)
        at = rng.randrange(len(t))
        v = t[at : at + rng.randint(1, 12)]
        out.append("".join(rng.choice("%_" + c * 12).swapcase() for c in v))
    return out


@pytest.mark.parametrize("raw", [False, True])
def test_index_equals_scan(people, index, columns, raw):
    df = people[1]
    for value in _values(people):
        want = df.filter(contains(F.col("name"), value, raw) | contains(F.col("code"), value, raw))
        got = index.contains(df, "id", columns, value, raw)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect()), value


def test_only_rare_triples_are_read(spark, people, index):
    assert index.rarest("code", "00012cc") and len(index.rarest("name", "abcdefghijklmnopqrs")) == ASKED
    sizes = {r.gram: r.n for r in index._read("counts").filter("field = 'code'").collect()}
    asked = index.rarest("code", "00012cc")
    assert [sizes.get(g, 0) for g in asked] == sorted(sizes.get(g, 0) for g in asked)
    assert index.rarest("code", "12") is None and index.candidates("code", "_12_", raw=True) is None
    code = next(r[2] for r in people[0] if r[2] and r[2].endswith("cc") and r[0] > 99)
    found = index.candidates("code", code.upper())
    assert 1 <= found.count() < 20
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "In(gram" in text and "EqualTo(field,code)" in text


def test_pieces_between_wildcards():
    assert literal_pieces("ab%cde_fghi", True) == ["cde", "fghi"]
    assert literal_pieces("ab%cde_fghi", False) == ["ab%cde_fghi"]
    assert literal_pieces(r"a\%bc", True) == ["a%bc"]
    assert literal_pieces("%%", True) == []


def test_tables_without_rows(spark, columns):
    df = spark.createDataFrame([], "id bigint, name string, code string")
    index = TextIndex.build(df, "id", columns, scratch_path(spark, "index"))
    assert index.contains(df, "id", columns, "abcd").collect() == []


def test_texts_are_read_once_and_give_each_triple_once(spark, columns):
    rows = [(i, f"Name#{i:09d} of a person", f"{i:08d}cc") for i in range(3000)] + [(3000, "ananan", None)]
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for one in frames:
            reads.add(len(one))
            yield one

    df = spark.createDataFrame(rows, "id bigint, name string, code string").coalesce(1)
    root = scratch_path(spark, "index")
    TextIndex.build(df.mapInPandas(counted, df.schema), "id", columns, root)
    assert reads.value == len(rows)
    found = sorted((r.field, r.gram) for r in spark.read.parquet(f"{root}/ids").filter("id = 3000").collect())
    assert found == [("name", "ana"), ("name", "nan")]
    sizes = {r.gram: r.n for r in spark.read.parquet(f"{root}/counts").filter("field = 'name'").collect()}
    assert sizes["ame"] == 3000 and sizes["nan"] == 1

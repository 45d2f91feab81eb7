"""The pipeline against the operators' plain versions, and the registry."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from lectern.llm import order_minhash
from lectern.llm.queries import QUERIES, SQL


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def corpus(spark, folder):
    """A tiny corpus whose result can be worked out by hand."""
    prose = "the house by the river was old and the water ran under it with a sound of stones"
    texts = [f"{prose} number {w} {prose[::-1]} {w}" for w in ("alpha", "beta", "gamma", "delta")]
    texts = [t + " " + " ".join(f"{w}{i}" for i in range(40)) for t, w in zip(texts, ("qa", "wb", "ec", "rd"), strict=True)]
    item = "one two three four five six seven eight nine ten eleven"
    token = "0123456789abcdef0123456789abcdef"
    rows = [
        (1, texts[0], "en", "s1", len(texts[0])),
        (2, texts[0] + " extra", "en", "s2", len(texts[0]) + 6),  # near copy of 1
        (2, texts[0] + " extra", "en", "s2", len(texts[0]) + 6),
        (3, texts[1] + " " + item, "en", "s1", 0),  # contaminated
        (4, f'{texts[2]} token = "{token}"', "en", "s1", 0),  # secret
        (5, "Привет как дела сегодня очень хорошо спасибо", None, "s1", 0),  # another language
        (6, None, None, None, None),
        (7, texts[3], "en", "s3", len(texts[3])),
    ]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(9, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {1: texts[0], 4: f'{texts[2]} [REDACTED]"', 7: texts[3]}


def test_run(spark, tmp_path):
    want = corpus(spark, str(tmp_path))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for doc_id, text in want.items():
        ids = library.encode(text, add_special_tokens=False).ids
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.append((doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == expected


def test_stages_keep_columns_of_any_table(spark, tmp_path, odd, nothing, clashing):
    corpus(spark, str(tmp_path))
    for df in (odd, nothing, clashing):
        for name, run in corpus_pipeline.STAGES[:-1]:
            out = run(spark, df, str(tmp_path))
            assert out.columns == df.columns, name
            assert out.count() <= df.count()
        assert stage("encoding")(spark, df, str(tmp_path)).count() == df.count()


def test_one_document_of_each_class_stays(spark, small):
    rows = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(small).collect()}
    stay = [r.doc_id for r in stage("near_dedup")(spark, small, "").select("doc_id").collect()]
    assert sorted(stay) == sorted(set(rows.values()))


def test_clean_documents_stay_and_contaminated_ones_go(spark):
    folder = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{folder}/documents.parquet")
    hit = {r.doc_id for r in QUERIES["op8_wu_manber"](spark, folder).collect() if r.contaminated}
    kept = {r.doc_id for r in stage("decontamination")(spark, df, folder).select("doc_id").collect()}
    assert kept == {r.doc_id for r in df.select("doc_id").collect()} - hit


def test_registry():
    found = __spark_entry__.queries()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in found) == 1
    assert found["pipeline"] is corpus_pipeline.run
    assert set(SQL) <= set(found) and [n for n, _ in corpus_pipeline.STAGES][1] == "near_dedup"

"""A training corpus in five stages, each on all that the one before kept.

1. language ID: rows without an identified language go;
2. MinHash near-dedup: one document of each class of near-duplicates stays;
3. benchmark decontamination: documents that hold a benchmark window go;
4. secret scans: secrets are replaced in the text, ``n_chars`` follows;
5. byte-pair encoding: token counts and digests of ids and of their decoding.

``run`` writes every stage as Parquet into the folder that the cluster names in
``spark.checkpoint.dir`` and reads it again for the next, so a lost executor costs no finished stage.
All but the last stage return the columns of their input. Nulls, empty texts, repeated rows, empty
tables and extra columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, credentials, decontam, language, order_minhash
from lectern.llm.common import read_table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read_table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return credentials.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokenize(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]

# Order MinHash, alignment, automata and merges are beyond SQL; the tests hold the stages against
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    audit,
    bpe,
    collocations,
    credentials,
    decontam,
    divergence,
    language,
    order_minhash,
    resampling,
    runindex,
    sharding,
    toxicity,
    warc,
)
from .common import read_table

WORD_BPE = "word_bpe_49k.json"


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return order_minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.interleave(read_table(spark, sf_dir, "documents"))


def op3_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its long repeats."""
    return runindex.remove_repeats(read_table(spark, sf_dir, "documents"))


def op4_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every document and the selection."""
    return resampling.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and their decoding, as digests."""
    return bpe.tokenize(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return credentials.scan(read_table(spark, sf_dir, "documents"))


def op8_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a benchmark window."""
    return decontam.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op9_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language.identify_documents(read_table(spark, sf_dir, "documents"))


def page_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page, with its markup and address as evidence."""
    return language.identify_pages(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents"))


def op10_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and divergence verdict of every document."""
    return divergence.judge(read_table(spark, sf_dir, "documents"))


def op11_segment_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that stick out in each."""
    return audit.audit(read_table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, written into archives and read back."""
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op13_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of each language."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_minhash": op1_order_minhash,
    "op2_interleave": op2_interleave,
    "op3_run_index": op3_run_index,
    "op4_lexicon": op4_lexicon,
    "op5_resampling": op5_resampling,
    "op6_bpe": op6_bpe,
    "op7_formats": op7_formats,
    "op8_wu_manber": op8_wu_manber,
    "op9_evidence": op9_evidence,
    "page_language": page_language,
    "op10_divergence": op10_divergence,
    "op11_segment_trees": op11_segment_trees,
    "op12_warc": op12_warc,
    "op13_streams": op13_streams,
}

SQL: dict[str, str] = {
    "op8_wu_manber": decontam.SQL,
    "op10_divergence": divergence.SQL,
    "op11_segment_trees": audit.SQL,
    "op12_warc": warc.SQL,
    "op13_streams": collocations.SQL,
}

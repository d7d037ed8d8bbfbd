"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quirespark.llm import chat, lattice, leaks, licenses, mainhtml, packing, quality, simhash, suffixes, transport
from quirespark.llm.common import table


def op1_max_subsequence_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract(table(spark, sf_dir, "pages"))


def op2_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport.round_trip(table(spark, sf_dir, "documents"))


def op3_snapshot_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op4_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_max_subsequence_html": op1_max_subsequence_html,
    "op2_transport_stream": op2_transport_stream,
    "op3_snapshot_chat": op3_snapshot_chat,
    "op4_simhash_gray": op4_simhash_gray,
    "op5_license_scan": op5_license_scan,
    "op6_bm25_decontamination": op6_bm25_decontamination,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_lattice_lm": op9_lattice_lm,
    "op10_quality_ftrl": op10_quality_ftrl,
}
ORACLES: dict[str, str] = {"op1_max_subsequence_html": mainhtml.ORACLE, "op3_snapshot_chat": chat.ORACLE}

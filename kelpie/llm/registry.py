"""The queries of the training-data operators and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kelpie.llm import bpe, decontamination, html_density, interpolation, sharding, simhash, sstable, syncmers, toxicity, wordpiece
from kelpie.llm.common import table


def op1_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 40)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_composite_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(spark, sf_dir, "pages"))


def op6_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op3_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(table(spark, sf_dir, "documents"))


def op8_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sstable_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_closed_syncmers": op1_closed_syncmers,
    "op2_karmarkar_karp": op2_karmarkar_karp,
    "op3_deleted_interpolation": op3_deleted_interpolation,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_composite_text_density": op5_composite_text_density,
    "op6_toxicity_grammar": op6_toxicity_grammar,
    "op7_token_counts": op7_token_counts,
    "op8_spaced_seed_decontamination": op8_spaced_seed_decontamination,
    "op9_sstable_round_trip": op9_sstable_round_trip,
    "op10_simhash_near_duplicates": op10_simhash_near_duplicates,
}
ORACLES: dict[str, str] = {
    "op8_spaced_seed_decontamination": decontamination.oracle(),
}

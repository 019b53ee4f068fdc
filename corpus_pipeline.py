"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, BPE.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a frame, which run() writes as Parquet in the shared folder and reads
again as the next one's docs. Every stage but the last returns the columns of
documents. ORACLE_SQL is None, as the first two stages (a learned grammar,
components of near copies) have no SQL; tests hold the stages against
brute-force versions instead. Rows are known by doc_id and text, so no stage
takes a clean row for one that shares its doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kelpie.llm import bpe, decontamination, near_copies, toxicity
from kelpie.llm.common import materialize, table

ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity grammar, learned from the labels of these documents, does not reject."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (sets of 5-word shingles, 0.8 alike) the document of the smallest doc_id."""
    return near_copies.one_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that overlap no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded documents."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("bpe", token_digests),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

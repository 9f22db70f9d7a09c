"""The corpus pipeline: five stages from raw documents to token ids.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on everything its
predecessor kept.  All but the last return the columns of ``documents``; the
last returns one row per remaining document: its id, the number of its tokens,
and digests of the token ids and of what they decode to.
``run`` writes every stage's rows to the shared folder of the session and reads
them back, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import additive_classifier, decontaminate, jaccard_join, perplexity_rules, trie_codec
from tilewright.llm.common import saved, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's perplexity band go."""
    return perplexity_rules.keep(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go."""
    return additive_classifier.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are 80 % alike, one of each group stays."""
    return jaccard_join.keep_one(docs, width=5, pct=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, or an edited copy of one, go."""
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many tokens every remaining document has, and digests of their ids and of what they decode to."""
    return trie_codec.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]
#: SQL expresses neither the models nor the tokenizer; tests/llm compares with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

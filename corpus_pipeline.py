"""A corpus pipeline of four stages; each is written as Parquet and read again before the next one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tremorlake.llm import knn_quality, ngram_join, packing, quality_rules
from tremorlake.llm.common import materialised, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rule_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes frequent lines out of texts; documents that fail the base rules or are depleted go.

    Null, blank and short texts fail the base rules. Rows with a null doc_id or source are judged like others, rows
    that repeat each other stay repeated, columns keep their names and values (n_chars follows the text), very long
    texts are judged whole, and an empty table gives an empty one.
    """
    return quality_rules.clean(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their labelled neighbours vote down go.

    Texts without words have the mean label as score. Null doc_ids are scored by their texts, equal texts alike, ties
    among neighbours all vote; all columns stay, and an empty table gives an empty one.
    """
    return knn_quality.good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest doc_id, nulls last, one of equal rows.

    Texts without words are not duplicates of each other and stay; different texts with one doc_id are told apart;
    all columns stay, and an empty table gives an empty one.
    """
    return ngram_join.deduplicate(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in training sequences.

    Null and empty texts give one piece of the end id; repeated rows and null doc_ids are packed each; other columns
    are left out; a very long text gives as many pieces as it needs; an empty table gives an empty one.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rule_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_duplicates", near_duplicate_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier and the tokenizer have no SQL; tests/llm/test_llm_pipeline.py holds each stage's rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialised(docs, name)
    return docs

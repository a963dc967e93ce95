"""The queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from tremorlake.llm import embedding_dedup, embedding_whitening, html_extraction, knn_quality, license_scan, ngram_join, packing, quality_rules, sentencepiece_codec, sharding, spelling_variants, url_filter, warc
from tremorlake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a unigram model over the pieces of the public BPE file, which holds no unigram scores; tests run both kinds."""
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents"), sentencepiece_codec.as_unigram(public_tokenizers.path("piece_bpe_32k.model")))


def op7_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_quality_rules": op2_quality_rules,
        "op3_url_filter": op3_url_filter,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_lpt_sharding": op5_lpt_sharding,
        "op6_sentencepiece_codec": op6_sentencepiece_codec,
        "op7_knn_quality": op7_knn_quality,
        "op8_warc": op8_warc,
        "op9_embedding_near_dedup": op9_embedding_near_dedup,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_html_extraction": op12_html_extraction,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.scan_sql(),
        "op2_quality_rules": quality_rules.OP2_SQL,
        "op8_warc": warc.OP8_SQL,
    }

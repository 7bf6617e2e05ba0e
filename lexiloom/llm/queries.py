"""The queries op1..op13 and their SQL, where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate,
    exact_dedup,
    html_extract,
    language_id,
    packing,
    quality_fm,
    quality_rules,
    resampling,
    secrets,
    simhash,
    suffix_dedup,
    wavelet,
    whitening,
)
from .common import read_table


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return suffix_dedup.digest(suffix_dedup.remove_repeats(docs))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return decontaminate.find_leaks(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return wavelet.token_file_digest(docs, vocabulary("word_bpe_49k.json"), end_id=1)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_fm.score(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return resampling.resample(docs, read_table(spark, sf_dir, "benchmark", "text"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return judged.drop("lang", "source", "n_lines")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_html_extract,
        op3_token_shards,
        op4_secret_scan,
        op5_exact_dedup,
        op6_best_fit_packing,
        op7_decontaminate,
        op8_language_id,
        op9_quality,
        op10_simhash,
        op11_importance_resampling,
        op12_whitening,
        op13_quality_rules,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_secret_scan": secrets.oracle_sql(),
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_importance_resampling": resampling.ORACLE_SQL,
    "op13_quality_rules": quality_rules.ORACLE_SQL,
}

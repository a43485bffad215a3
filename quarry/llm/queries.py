"""The ten operators bound to the project's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.exact_dedup import exact_groups
from quarry.llm.html_text import extract_main_text
from quarry.llm.mixing import mix
from quarry.llm.near_dedup import near_groups
from quarry.llm.packing import pack
from quarry.llm.sharding import shard_by_bytes
from quarry.llm.spotsigs import fingerprints
from quarry.llm.sstable import tokens_through_files
from quarry.llm.tokens import read_tokenizer
from quarry.llm.toxicity import score_toxicity
from quarry.llm.url_filter import judge_urls


#: Rules of the URL filter, as given with the task.
URL_RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = read_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(table(spark, sf_dir, "documents"), tokenizer, special_tokens=True)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return tokens_through_files(table(spark, sf_dir, "documents"), tokenizer, special_tokens=True)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sharding": op4_sharding,
    "op5_url_filter": op5_url_filter,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_source_mixing": op7_source_mixing,
    "op8_token_output": op8_token_output,
    "op9_toxicity": op9_toxicity,
    "op10_fingerprints": op10_fingerprints,
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH base AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents),
        ranked AS (
            SELECT doc_id, norm,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM base)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM ranked
    """,
}

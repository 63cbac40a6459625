"""The ``opN_<name>`` queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_text, langid, line_dedup, minhash, oracles, packing, pii, quality, tokens
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_shared_lines(read_table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.length(text).cast("long").alias("n_chars"), F.md5(text).alias("text_md5"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(tokens.MODEL))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read_table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(read_table(spark, sf_dir, "conversations"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=4)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.find(docs, pii.learn(docs))


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(packing.TOKENIZER))


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_decontaminate": op3_decontaminate,
        "op4_html_text": op4_html_text,
        "op5_language_id": op5_language_id,
        "op6_chat_format": op6_chat_format,
        "op7_quality_rules": op7_quality_rules,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_personal_data": op9_personal_data,
        "op10_harmonic_packing": op10_harmonic_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": oracles.OP1, "op3_decontaminate": oracles.OP3, "op6_chat_format": oracles.OP6, "op7_quality_rules": oracles.OP7, "op8_near_duplicates": oracles.OP8}

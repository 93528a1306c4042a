"""Queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import alignment, chat, decontamination, html, licenses, lines, mixing, negatives, passages, quality, sharding, simhash, urls
from lodestone.sources.tables import table

SHARDS = 24


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drops(lines.line_groups(table(spark, sf_dir, "documents")))


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_duplicate_passages(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), SHARDS)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("text_key", "lang", "source")


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


#: A conversation whose turns hold the template's own control strings.
TRAP = r"\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    return chat.digest(chat.format_conversations(turns.unionByName(trap)))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.entries(spark, urls.ENTRIES)).select("row.page_id", "host", "path", "rule", "verdict")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(negatives.whole_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id"), label, F.col("embedding")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_passages": op2_passages,
    "op3_decontamination": op3_decontamination,
    "op4_mixing": op4_mixing,
    "op5_feistel_shards": op5_feistel_shards,
    "op6_quality_rules": op6_quality_rules,
    "op7_simhash_groups": op7_simhash_groups,
    "op8_page_text": op8_page_text,
    "op9_chat_format": op9_chat_format,
    "op10_licenses": op10_licenses,
    "op11_token_alignment": op11_token_alignment,
    "op12_url_filter": op12_url_filter,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": mixing.oracle(),
    "op10_licenses": licenses.oracle(),
    "op12_url_filter": urls.oracle(),
    "op13_hard_negatives": negatives.ORACLE,
}

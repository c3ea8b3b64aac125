"""The registered queries of the training-text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexgraph.llm import chunks, decontam, extract, langid, lm, mixing, quality, ring, simhash, sql, urltree
from plexgraph.llm.common import table


def _fold(id_col: str, folds: int, fold: int = 2) -> Column:
    """Whether a row is held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), ~_fold("doc_id", 4))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("target", F.round("target", 6))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), ~_fold("doc_id", 7))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeats(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    joined = F.concat_ws(",", F.array_sort("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ring.shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_html_extraction": op2_html_extraction,
    "op3_mixing": op3_mixing,
    "op4_url_filters": op4_url_filters,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_simhash": op9_simhash,
    "op10_sharding": op10_sharding,
}

ORACLES: dict[str, str] = dict(sql.ORACLES)

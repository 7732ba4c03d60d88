"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from adjudica.llm import decontaminate, html_text, infill, language, lines, oracles, packing, prefix_trie, quality, secrets, similar, substrings, token_files, tokens, warc
from adjudica.llm.common import scratch_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.contract(_documents(spark, sf_dir), language.default_vocabulary())


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.contract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(_documents(spark, sf_dir), path, tokens.default_path())
    read = token_files.read_token_files(spark, path)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.contract(_documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.contract(_documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.contract(_documents(spark, sf_dir))


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contract(_documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(_documents(spark, sf_dir), tokens.default_path()))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.near_duplicates(_documents(spark, sf_dir))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contract(spark, sf_dir)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.contract(_documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.contract(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.contract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_html_text, op3_token_files, op4_secrets, op5_line_dedup, op6_substring_dedup, op7_quality_cascade, op8_packing, op9_jaccard_join, op10_decontaminate, op11_fill_in_middle, op12_prefix_trie, op13_warc)}


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: they are held against brute force, round trips or held-out accuracy in tests/llm."""
    return {"op4_secrets": oracles.SECRETS, "op5_line_dedup": oracles.LINES, "op7_quality_cascade": oracles.QUALITY, "op10_decontaminate": oracles.DECONTAMINATION, "op11_fill_in_middle": oracles.INFILL, "op12_prefix_trie": oracles.TRIE, "op13_warc": oracles.WARC}

"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on what the one before kept; all but the last return the
columns of ``documents``. Between stages the rows are a Parquet table, so that a lost executor costs a part
of one stage.

Odd rows, in all stages: a null or empty text has no words and no lines but one empty one, so that the first stage rejects it and the
others would keep it; a null doc_id is a document; rows that share a doc_id are documents of their own. Texts of any length
are whole. Columns of other names, and of names that operators add, come out as they were. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from adjudica.llm import decontaminate, lines, packing, quality, similar, tokens
from adjudica.llm.common import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of ``documents``, with n_chars of the text as it is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long")))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go. Each row is judged alone, so that ties and repeated rows share their fate."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts, but for those of the largest doc_id that holds them; a text may become empty. Rows that tie
    for the largest doc_id keep the line."""
    names = [f"c{k}" for k in range(len(docs.columns))]  # so that no column has the name of one that the operator adds
    text = names[docs.columns.index("text")]
    done = lines.drop_repeated_lines(docs.toDF(*names), id_col=names[docs.columns.index("doc_id")], text_col=text)
    return _sized(done.withColumn(text, F.col("_kept")).select(*names).toDF(*docs.columns), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest doc_id (null last), of repeated rows one. Of texts that share that
    doc_id the one of the smallest SHA-256 stays."""
    return similar.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go from the texts, and documents that are mostly such. Each row is judged alone; items without words
    match nothing."""
    return _sized(decontaminate.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, with their ids. An empty text, such as the stages before leave, is its end id; of
    documents of equal length the order of the rows decides, and repeated rows are packed one by one."""
    pieces = packing.pack_documents(docs, tokens.default_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: MinHash and tokenization have no SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

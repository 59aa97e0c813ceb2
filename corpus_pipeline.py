"""The corpus pipeline: five stages from raw documents to token counts.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read
again as the next one's ``docs``.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality_rules
from parlance.llm.common import Scratch, discard, shared_path, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; n_chars follows the text; every document stays."""
    return line_dedup.clean_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8 or more)."""
    return near_dedup.first_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return byte_bpe.round_trip(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("MinHash near-dedup", near_copies), ("benchmark decontamination", benchmark), ("byte-level BPE", tokens)]

#: SQL has neither MinHash components nor BPE; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  What a stage leaves behind goes once the next one has been written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, "pipeline-" + name.replace(" ", "-"))
        with Scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

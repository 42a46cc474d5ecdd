"""A corpus pipeline: quality rules, line dedup, near dedup, decontamination and packing, in this order.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.  All but the last return the columns of documents, whatever these
are besides doc_id, text and source; names that the operators use are free for them.  No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import decontaminate, line_dedup, near_dup, packing, quality
from quillframe.llm.common import table
from quillframe.sources.scratch import discard, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; counts are of the stage's own input.

    Null, empty and short texts fail.  Rows are judged one by one, so repeated ones go or stay together; a score that
    ties with the threshold stays; very long texts are read whole.
    """
    kept = quality.score_quality(docs, docs, quality.trusted_labels(spark, sf_dir)).filter("kept")
    return kept.select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents share; every document stays.

    Null texts become empty.  Rows without an id lose nothing; rows that share an id lose the same lines.
    """
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near duplicates.

    Null and empty texts and rows without an id stay; of repeated rows one stays.
    """
    return near_dup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark.

    Null and empty texts stay, and all documents if the benchmark is empty; repeated rows go or stay together.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bins' pieces: doc_id, piece, start, n_tokens, shard, bin, offset.

    Null and empty texts are one token, very long ones are cut into pieces; repeated rows are packed apart.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

#: Signatures, the quality model and best-fit packing aren't expressible in SQL; the tests hold brute force against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; a stage's table goes when the next one has been written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = written(stage(spark, docs, sf_dir), name)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next one's docs. All but the last return the columns of documents; rows that a stage rejects go, and
text that it cuts is gone for those after it. Further columns pass through all but the last, whatever
their names; an empty table stays empty; no stage fails on a null in any column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import lines, packing, queries, rules, simhash, substrings
from tessera.llm.common import Written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of the policy go: null and empty texts have too few words. Rows are
    judged one by one, so repeated ones stay or go together."""
    return rules.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents are cut from them, and n_chars counted anew
    there. Rows without a source or a text stay as they are; a repeated row counts as one more document."""
    return lines.without_boilerplate(docs, length="n_chars")


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id (null comes
    last); of repeated rows one. Null and empty texts are one group."""
    return simhash.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut, and n_chars counted anew there; a document of
    nothing else goes. Null and empty texts stay as they are; rows of one doc_id are one document."""
    return substrings.without_passages(docs, length="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed into sequences: one row a piece, with the columns of op8. A
    null or empty text is its end id alone; repeated rows are packed as often as they occur."""
    return packing.pack(docs, queries.word_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: SimHash groups and chained passages have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = Written(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs

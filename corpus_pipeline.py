"""From raw documents to token files: quality rules, near duplicates, benchmark leaks, the mix of sources, token ids.

Every stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame that
is written as Parquet and read again as the next one's docs. The first four return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillcast.llm.common import keep, table
from quillcast.llm.decontaminate import remove_leaks
from quillcast.llm.mixing import mixed_documents
from quillcast.llm.near_dedup import drop_near_duplicates
from quillcast.llm.quality import accept
from quillcast.llm.token_files import store_and_read


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 of the quality rules keeps."""
    return accept(docs, "v1")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words (or a whole shorter item) of the benchmark."""
    return remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them, at most three times."""
    return mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, from the token files written in order of doc_id."""
    return store_and_read(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_files", token_files),
]

#: SQL can't express the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

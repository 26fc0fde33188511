"""A corpus from documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of documents,
whatever other columns there are beside them. An empty table gives an empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenloom.llm.exact_dedup import drop_exact
from lumenloom.llm.mixing import repeat_rows
from lumenloom.llm.near_dedup import drop_near
from lumenloom.llm.packing import pack_with_public_tokenizer
from lumenloom.llm.quality import keep_good
from lumenloom.scratch import cut, drop, drop_since, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source.

    Null and empty texts fail the base rules. Null languages and sources are groups of their own,
    null ids and repeated rows are judged like all others.
    """
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest id, null ids last.

    Null texts are empty, and empty texts are one group; of rows alike in all columns one stays.
    """
    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: shingles of five words, similarity 0.8 or more.

    Rows are told apart by their place, not their id: unlike texts under one id, or under none, all
    stay. Of a group the smallest id stays, null ids last. Rows without words are like nothing.
    """
    return drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, and one of each source cut to what is left.

    Rows without words take none. Null sources are one source, the last; rows with one id and size
    are interchangeable, so repeated rows and null ids are taken like all others.
    """
    return repeat_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens.

    Null and empty texts are the end id alone; null ids stay null, repeated rows are packed as often.
    """
    return pack_with_public_tokenizer(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: The near-duplicate stage and the tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before = written()
        read, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, name)
            drop_since(before, docs)  # a stage's own tables go when its result is written
            drop(read)  # and so does the table that it read
    return docs

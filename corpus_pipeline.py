"""The training-data pipeline: toxic documents go, one of each near-duplicate group stays, benchmark leaks go, sources are mixed to target weights, and the rows are dealt to shards.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Empty tables pass as empty tables. Rows that share a doc_id or have none are told apart by their text in the second
stage. Each stage's own treatment of nulls, ties and empty texts is told in its module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeline.llm import decontam, mixing, ngram_join, sharding, toxicity
from tapeline.session import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels, does not reject."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of each component of near duplicates."""
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture of sources takes them."""
    return mixing.mix(docs).select(docs.columns)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    return sharding.shard_rows(docs, n_shards=8)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Levenshtein automata, joins by pivots and bin packing cannot be told in SQL; tests/llm compares with plain Python.
ORACLE_SQL = None

"""Training-data pipeline over ``documents``: language, lines, near copies, test items, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of ``documents``; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.llm import decontamination, language_id, line_dedup, near_dedup, packing
from tradesift.llm.common import read_table, saved


def _sized(docs: DataFrame) -> DataFrame:
    """The documents with ``n_chars`` of their present text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.char_length("text").cast(kind))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters and undecided ones go."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur earlier, exactly or nearly; a document goes that has only such lines."""
    return _sized(line_dedup.without_repeated_lines(docs))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return near_dedup.one_of_each_group(docs)


def remove_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of test items; a document goes that mostly consists of them."""
    return _sized(decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bin."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("minhash_near_dedup", remove_near_duplicates),
    ("benchmark_decontamination", remove_test_items),
    ("best_fit_packing", pack_sequences),
]

#: A trained network, sketches and packing can't be written in SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

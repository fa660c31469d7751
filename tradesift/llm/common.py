"""Helpers of the corpus operators: tables, shared folder, blocks and connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps A-Z to a-z and leaves every other byte, so UTF-8 text keeps its length.
ASCII_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))

STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_MAX_WORDS = 1_000_000


class WordHashes(dict):
    """64-bit hashes of words; computed once for each word that a worker meets, in bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


WORD_HASHES = WordHashes()


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    values = (values ^ (values >> np.uint64(29))) * _MIX
    return values ^ (values >> np.uint64(32))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder; a local one only for an unset local session."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="llm-checkpoint-"))
        root = context.getCheckpointDir()
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def saved(rows: DataFrame) -> DataFrame:
    """Rows written as Parquet to the shared folder and read back: lineage ends here and survives lost executors."""
    spark = rows.sparkSession
    folder = shared_folder(spark)
    rows.write.parquet(folder)
    return spark.read.schema(rows.schema).parquet(folder)


def crc_of_id(id_column: str) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary"))


def text_bytes(table, column: str) -> list[bytes | None]:
    """The texts of an Arrow batch as UTF-8 bytes, without decoding them."""
    import pyarrow as pa

    return table.column(column).cast(pa.binary()).to_pylist()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component): the smallest vertex reachable from each vertex that has an edge.

    Alternates large-star and small-star steps, so the number of rounds is logarithmic and a vertex
    with very many neighbours is only ever aggregated (with partial sums) or joined to one row.
    Loops and null ends are ignored; no edges give no rows.
    """
    shared_folder(edges.sparkSession)
    oriented = lambda rows: rows.where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    signature = lambda rows: rows.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    current = oriented(edges.where("u is not null and v is not null")).distinct().checkpoint()
    before = signature(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # both sides of the joins are plain exchanges, so Spark can split the rows of a vertex with many neighbours
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct().checkpoint()
        lowest = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = large.join(lowest, "u").select(
            F.explode(
                F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
            ).alias("e")
        )
        current = oriented(small.select("e.u", "e.v")).distinct().checkpoint()
        after = signature(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
    )

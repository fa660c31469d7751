"""Near-duplicate vectors by randomised-rotation binary codes with stored correction factors.

A unit vector is rotated at random and reduced to the signs of its coordinates; the stored factor is the inner product
of the vector with its code. For another, uncoded vector, (code . vector) / factor estimates the cosine without
bias, with an error of known size. A pair whose upper confidence bound is below the threshold is
passed over; every other pair is recomputed in double precision, and only that decides.

Pairs are looked for in buckets: each of ``n_tables`` tables takes a run of the sign bits of several rotations as
its key. The bits of a key grow with the logarithm of the number of vectors and the number of tables with what the
wanted recall at the threshold needs, so buckets stay small at every size. A link is counted in the first table
in which its two vectors meet. Large buckets are cut into blocks, each pair of blocks is one task; no pairs are written,
only each vector's number of links and a forest of them. Equal vectors are one class with a weight.

Defined results: null, empty and zero vectors and those with null or non-finite components link with nothing; vectors
of different lengths don't link; rows with equal ids and equal vectors count as copies; a null id
links with nothing and has no component; other columns are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.llm.common import components, read_table, saved

THRESHOLD = 0.95
#: Share of links of exactly the threshold that may be missed; closer links are missed less.
MISS = 1e-4
#: Standard deviations of the estimate within which a pair is recomputed.
DEVIATIONS = 6.0
BUCKET = 32
BLOCK = 1024
SEED = 11


def table_shape(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a key and number of tables for n vectors."""
    bits = max(1, math.ceil(math.log2(max(2, n) / BUCKET)))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(miss) / math.log1p(-(agree**bits)))


def rotations(dim: int, n_bits: int, seed: int = SEED) -> np.ndarray:
    """Random rotations one after the other, (n_bits or more, dim)."""
    draw = np.random.default_rng([seed, dim])
    parts = []
    for _ in range(max(1, -(-n_bits // dim))):
        q, r = np.linalg.qr(draw.normal(size=(dim, dim)))
        parts.append((q * np.sign(np.diag(r))).T)
    return np.concatenate(parts)


def encode(unit: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits under all rotations, and the correction factor of the code under the first."""
    dim = unit.shape[1]
    coordinates = unit @ turned.T
    return coordinates >= 0, np.abs(coordinates[:, :dim]).sum(axis=1) / math.sqrt(dim)


def estimate(bits: np.ndarray, factors: np.ndarray, rotated: np.ndarray) -> np.ndarray:
    """Unbiased cosines of coded vectors (rows) with uncoded rotated unit vectors (columns)."""
    codes = np.where(bits, 1.0, -1.0) / math.sqrt(bits.shape[1])
    return (codes @ rotated.T) / factors[:, None]


def margin(factors: np.ndarray, dim: int, threshold: float) -> np.ndarray:
    """How far below the threshold the estimate of a pair of at least that cosine can be, by the confidence bound."""
    spread = min(1.0, DEVIATIONS / math.sqrt(max(1, dim - 1)))
    return np.sqrt(np.maximum(0, 1 - factors**2)) / factors * math.sqrt(max(0.0, 1 - threshold**2)) * spread + 1e-9


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, hi, lo, vector): the bytes of each usable vector and their digest; dim 0 where it isn't usable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, his, los, data = [], [], [], []
            for value in batch.column("vector"):
                part = value.values if value.is_valid else None
                x = np.zeros(0) if part is None or part.null_count else part.to_numpy(zero_copy_only=False).astype(np.float64)
                scale = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                raw = (x + 0.0).tobytes() if scale > 0 else b""
                digest = xxhash.xxh3_128_digest(raw)
                dims.append(len(raw) // 8)
                his.append(int.from_bytes(digest[:8], "big", signed=True))
                los.append(int.from_bytes(digest[8:], "big", signed=True))
                data.append(raw)
            arrays = [batch.column("vec_id"), pa.array(dims, pa.int32()), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "dim", "hi", "lo", "vector"])

    narrow = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    return narrow.mapInArrow(run, "vec_id long, dim int, hi long, lo long, vector binary")


def _unit_rows(vectors: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(v) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _coded(firsts: DataFrame, bits: int, tables: int) -> DataFrame:
    """Adds the packed sign bits, the factor and the key of each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            data = batch.column("vector").to_pylist()
            signs: list = [None] * len(data)
            factors = np.zeros(len(data))
            keys: list = [None] * len(data)
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                if dim not in turned:
                    turned[dim] = rotations(dim, bits * tables)
                all_bits, factors[rows] = encode(_unit_rows([data[r] for r in rows]), turned[dim])
                own = all_bits[:, : bits * tables].reshape(len(rows), tables, bits) @ weights
                packed = np.packbits(all_bits[:, :dim], axis=1)
                for k, r in enumerate(rows.tolist()):
                    signs[r], keys[r] = packed[k].tobytes(), own[k].tolist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", "weight", "dim", "vector")), pa.array(signs, pa.binary()), pa.array(factors), pa.array(keys, pa.list_(pa.int64()))],
                names=["vec_id", "weight", "dim", "vector", "signs", "factor", "keys"],
            )

    narrow = firsts.select("vec_id", "weight", "dim", "vector")
    return narrow.mapInArrow(run, "vec_id long, weight long, dim int, vector binary, signs binary, factor double, keys array<long>")


def linked_pairs(unit: np.ndarray, bits: np.ndarray, factors: np.ndarray, turned: np.ndarray, threshold: float,
                 first: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of at least the threshold; ``first`` marks the rows of one block when two blocks are compared across."""
    dim = unit.shape[1]
    guess = estimate(bits, factors, unit @ turned[:dim].T)
    possible = guess >= threshold - margin(factors, dim, threshold)[:, None]
    possible &= np.triu(np.ones(possible.shape, bool), 1) if first is None else first[:, None] & ~first[None, :]
    i, j = np.nonzero(possible)
    exact = np.concatenate([np.einsum("nd,nd->n", unit[i[a : a + 65536]], unit[j[a : a + 65536]]) for a in range(0, len(i), 65536)] or [np.zeros(0)])
    keep = exact >= threshold
    return i[keep], j[keep]


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, i, label[j])
        np.minimum.at(label, j, label[i])
        label = label[label]
        if (label == before).all():
            return label


def _links(coded: DataFrame, bits: int, tables: int, threshold: float) -> DataFrame:
    """(u, n, v): numbers of links of u that one task has found (v null), and links (n 0)."""
    placed = coded.select("*", F.posexplode("keys").alias("table", "key"))
    large = (
        coded.select("dim", F.posexplode("keys").alias("table", "key"))
        .groupBy("dim", "table", "key")
        .agg(F.count(F.lit(1)).alias("size"))
        .where(F.col("size") > BLOCK)
        .select("dim", "table", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("n_blocks"))
    )
    rows = (
        placed.join(large, ["dim", "table", "key"], "left")
        .withColumn("n_blocks", F.coalesce("n_blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")).cast("int"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
        .select(
            "vec_id", "weight", "dim", "vector", "signs", "factor", "keys", "table", "key", "block",
            F.when(F.col("n_blocks") > 1, -1 - F.col("key")).otherwise(F.floor(F.col("key") / BUCKET)).alias("bundle"),
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
        )
    )

    def link(batch: pa.Table) -> pa.Table:
        table, dim = batch["table"][0].as_py(), batch["dim"][0].as_py()
        turned = rotations(dim, 1)
        numbers, ids = batch["key"].to_numpy(), batch["vec_id"].to_numpy()
        order = np.lexsort((ids, numbers))
        edges = np.flatnonzero(np.diff(numbers[order], prepend=numbers[order[0]] - 1))
        across = batch["i"][0].as_py() != batch["j"][0].as_py()
        blocks, weights, factors = batch["block"].to_numpy(), batch["weight"].to_numpy(), batch["factor"].to_numpy()
        unit_all = _unit_rows(batch["vector"].to_pylist())
        signs = np.stack([np.frombuffer(s, np.uint8) for s in batch["signs"].to_pylist()])
        bits_all = np.unpackbits(signs, axis=1, count=dim).astype(bool)
        keys = batch["keys"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        out: tuple[list, list, list] = ([], [], [])
        for start, stop in zip(edges, [*edges[1:], len(order)], strict=True):
            own = order[start:stop]
            if len(own) < 2:
                continue
            first = blocks[own] == blocks[own].min() if across else None
            i, j = linked_pairs(unit_all[own], bits_all[own], factors[own], turned, threshold, first)
            # a link belongs to the first table in which its vectors meet
            here = np.concatenate([(keys[own[i[a : a + 65536]], :table] != keys[own[j[a : a + 65536]], :table]).all(axis=1) for a in range(0, len(i), 65536)] or [np.zeros(0, bool)])
            i, j = i[here], j[here]
            if not len(i):
                continue
            count = np.bincount(i, weights[own][j], len(own)) + np.bincount(j, weights[own][i], len(own))
            root = local_roots(len(own), i, j)
            some = np.flatnonzero(count)
            out[0].extend(ids[own][some].tolist())
            out[1].extend(count[some].astype(np.int64).tolist())
            out[2].extend([None] * len(some))
            other = np.flatnonzero(root != np.arange(len(own)))
            out[0].extend(ids[own][other].tolist())
            out[1].extend([0] * len(other))
            out[2].extend(ids[own][root[other]].tolist())
        return pa.table({name: pa.array(values, pa.int64()) for name, values in zip("unv", out, strict=True)})

    return rows.groupBy("dim", "table", "bundle", "i", "j").applyInArrow(link, "u long, n long, v long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id) of every row."""
    made = saved(usable_vectors(vectors, id_col, vector_col))
    by_value = ["hi", "lo", "dim"]
    usable = made.where("dim > 0 and vec_id is not null")
    classes = usable.groupBy(*by_value).agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight"))
    firsts = usable.join(
        classes.select(*by_value, F.col("first_id").alias("vec_id"), "weight"), [*by_value, "vec_id"]
    ).dropDuplicates(["vec_id", *by_value])
    bits, tables = table_shape(classes.count(), threshold, miss)
    found = saved(_links(_coded(firsts, bits, tables), bits, tables, threshold))
    counts = found.where("v is null").groupBy(F.col("u").alias("first_id")).agg(F.sum("n").alias("n"))
    groups = components(found.where("v is not null").select("u", "v")).withColumnRenamed("vertex", "first_id")
    joined = (
        classes.join(counts, "first_id", "left")
        .join(groups, "first_id", "left")
        .select(*by_value, (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "first_id").alias("component"))
    )
    return made.withColumn("dim", F.when(F.col("vec_id").isNotNull() & (F.col("dim") > 0), F.col("dim"))).join(joined, by_value, "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")
    )


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = near_duplicates(read_table(spark, folder, "embeddings"))
    return rows.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, cast(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND list_dot_product(cast(embedding AS DOUBLE[]), cast(embedding AS DOUBLE[])) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY 1),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, cast(coalesce(n_links, 0) AS bigint) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN comp ON comp.a = vec_id
"""

"""Near-duplicate documents by SetSketch registers.

A register holds, on an exponential scale, the smallest of the exponential values that a document's shingles
draw: ``1 - floor(log_b(minimum))``, cut to the range of the register. Sketches of parts merge by the larger register.
Registers are equal about as often as the sets are similar, so bands of registers give candidates; the similarity of a
candidate is judged by the likelihood of how many of its registers are larger, smaller and equal; what the
likelihood doesn't rule out is verified on the full shingle sets.

Steps: equal sets become one class. Classes that share a band are joined to the smallest id of the bucket, and
those stars give clusters that hold every candidate pair. Clusters are gathered in blocks of bounded size: each pair of
blocks is compared by one task, which keeps a forest of verified links. The forests' components are the result. A
group of many near copies gives no pairs, and no task holds more than two blocks.

Defined results: documents without words link with nothing; fewer words than a shingle are one shingle; rows with
equal ids are one document; rows with a null id form no links; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.llm.common import STEP, WORD_HASHES, components, mixed, read_table, saved, text_bytes

SHINGLE = 5
BANDS = 20
BAND_REGISTERS = 6
REGISTERS = BANDS * BAND_REGISTERS
BASE = 1.02
TOP = 4000
#: Documents of one block of a cluster, and of a bundle of small clusters.
BLOCK = 1024
#: A candidate is ruled out when the threshold is this many standard deviations below its best similarity.
DEVIATIONS = 5.0

_draw = np.random.default_rng(20)
_FACTORS = _draw.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _draw.integers(0, 1 << 63, REGISTERS, np.uint64)


def shingles(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    total = hashes[: len(words) - width + 1].copy()
    for k in range(1, width):
        total = mixed(total) * STEP + hashes[k : len(words) - width + 1 + k]
    return np.unique(mixed(total + np.uint64(width)))


def sketch(elements: np.ndarray) -> np.ndarray:
    """Registers of a set of well-mixed 64-bit elements."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(elements), 512):
        drawn = elements[None, at : at + 512] * _FACTORS[:, None]
        drawn += _OFFSETS[:, None]
        np.minimum(least, drawn.min(axis=1), out=least)
    exponential = -np.log1p(-np.minimum((least.astype(np.float64) + 1.0) / 2.0**64, 1 - 1e-16))
    return np.clip(1 - np.floor(np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sketch of the union of two sketched sets."""
    return np.maximum(first, second)


def band_keys(registers: np.ndarray) -> list[int]:
    """One key for each band; the number of the band is part of the key."""
    return [
        xxhash.xxh3_64_intdigest(registers[k * BAND_REGISTERS : (k + 1) * BAND_REGISTERS].tobytes(), seed=k) - (1 << 63)
        for k in range(BANDS)
    ]


def _part(x: np.ndarray) -> np.ndarray:
    """Probability that a register of one sketch is larger, from its share of the union outside the other set."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def _log_likelihood(j: np.ndarray, larger: np.ndarray, smaller: np.ndarray, u: np.ndarray) -> np.ndarray:
    v = 1 - u
    p, q = np.maximum(_part(u - v * j), 1e-12), np.maximum(_part(v - u * j), 1e-12)
    return larger * np.log(p) + smaller * np.log(q) + (REGISTERS - larger - smaller) * np.log(np.maximum(1 - p - q, 1e-12))


def joint_similarity(larger: np.ndarray, smaller: np.ndarray, n_first: np.ndarray, n_second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Most likely similarities from the counts of larger and smaller registers and the known set sizes, and whether
    the threshold is within ``DEVIATIONS`` standard deviations by the likelihood ratio."""
    u = n_first / (n_first + n_second)
    low, high = np.zeros(len(u)), np.minimum(u / (1 - u), (1 - u) / u)
    limit = high.copy()
    for _ in range(40):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        rises = _log_likelihood(a, larger, smaller, u) < _log_likelihood(b, larger, smaller, u)
        low, high = np.where(rises, a, low), np.where(rises, high, b)
    best = (low + high) / 2
    gap = _log_likelihood(best, larger, smaller, u) - _log_likelihood(np.minimum(threshold, limit), larger, smaller, u)
    return best, (best >= threshold) | (2 * gap <= DEVIATIONS**2)


def verified_forest(ids: np.ndarray, blocks: np.ndarray, registers: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what verified links connect. Rows of two blocks are compared across, rows of one block among themselves."""
    sizes = np.array([len(s) for s in sets], np.float64)
    across = len(np.unique(blocks)) > 1
    found = []
    for i in range(len(ids) - 1):
        rest = np.arange(i + 1, len(ids))
        fits = (np.minimum(sizes[i], sizes[rest]) * 100 >= percent * np.maximum(sizes[i], sizes[rest])) & (ids[rest] != ids[i])
        if across:
            fits &= blocks[rest] != blocks[i]
        rest = rest[fits]
        if not len(rest):
            continue
        larger, smaller = (registers[i] > registers[rest]).sum(axis=1), (registers[i] < registers[rest]).sum(axis=1)
        # a pair at the threshold has far more equal registers than this
        likely = larger + smaller <= REGISTERS * min(1.0, 2.5 * (1 - percent / 100) + 0.2)
        rest, larger, smaller = rest[likely], larger[likely], smaller[likely]
        if len(rest):
            best, possible = joint_similarity(larger, smaller, np.full(len(rest), sizes[i]), sizes[rest], percent / 100)
            found += [(s, i, j) for s, j in zip(best[possible].tolist(), rest[possible].tolist(), strict=True)]
    root = list(range(len(ids)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    links = []
    for _, i, j in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
        a, b = top(i), top(j)
        if a != b:
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * common >= percent * (sizes[i] + sizes[j] - common):
                root[max(a, b)] = min(a, b)
                links.append((int(ids[i]), int(ids[j])))
    return links


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n_shingles, set_hi, set_lo, registers, bands) of every document; empty sets have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n": [], "hi": [], "lo": [], "registers": [], "bands": []}
            for text in text_bytes(batch, "text"):
                elements = shingles(text, size)
                digest = xxhash.xxh3_128_digest(elements.tobytes())
                registers = sketch(elements) if len(elements) else None
                out["n"].append(len(elements))
                out["hi"].append(int.from_bytes(digest[:8], "big", signed=True))
                out["lo"].append(int.from_bytes(digest[8:], "big", signed=True))
                out["registers"].append(None if registers is None else registers.tobytes())
                out["bands"].append([] if registers is None else band_keys(registers))
            arrays = [
                batch.column("doc_id"),
                *(pa.array(out[k], pa.int64()) for k in ("n", "hi", "lo")),
                pa.array(out["registers"], pa.binary()),
                pa.array(out["bands"], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_hi", "set_lo", "registers", "bands"])

    schema = "doc_id long, n_shingles long, set_hi long, set_lo long, registers binary, bands array<long>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _cluster_links(members: DataFrame, docs: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Verified links (u, v) within the clusters. members: (doc_id, cluster, registers)."""

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, size).tobytes() for t in text_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "elements"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # texts move by their id at every size: a broadcast of the members would end at the size where it matters
    wanted = texts.join(members.select("doc_id").hint("merge"), "doc_id", "left_semi").mapInArrow(with_sets, "doc_id long, elements binary")
    counts = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    n_members = members.count()
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("doc_id"), F.col("n_blocks")).cast("int")
    rows = (
        members.join(counts.select("cluster", blocks.alias("n_blocks")), "cluster")
        .withColumn("block", block)
        .join(wanted, "doc_id")
        .select("*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
        .select(
            "doc_id", "cluster", "block", "registers", "elements",
            (F.col("n_blocks") > 1).alias("large"),
            F.when(F.col("n_blocks") > 1, F.col("cluster"))
            .otherwise(F.pmod(F.xxhash64("cluster"), F.lit(max(1, n_members // (BLOCK // 2)))))
            .alias("bundle"),
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
        )
    )

    def link(table: pa.Table) -> pa.Table:
        ids = table["doc_id"].to_numpy()
        clusters, numbers = np.unique(table["cluster"].to_numpy(), return_inverse=True)
        blocks_, registers, elements = table["block"].to_numpy(), table["registers"], table["elements"]
        order = np.lexsort((ids, numbers))
        ends = np.searchsorted(numbers[order], np.arange(len(clusters) + 1))
        links = []
        for start, stop in zip(ends[:-1], ends[1:], strict=True):
            own = order[start:stop]
            own_registers = np.stack([np.frombuffer(registers[int(k)].as_py(), np.uint16) for k in own])
            sets = [np.frombuffer(elements[int(k)].as_py(), np.uint64) for k in own]
            links += verified_forest(ids[own], blocks_[own], own_registers, sets, percent)
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    return rows.groupBy("large", "bundle", "i", "j").applyInArrow(link, "u long, v long")


def near_duplicates(docs: DataFrame, percent: int, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents of a component are connected by links of
    ``percent`` or more of their shingles in common."""
    made = saved(sketches(docs, size, id_col, text_col))
    full = made.where("n_shingles > 0 and doc_id is not null")
    by_set = ["set_hi", "set_lo", "n_shingles"]
    classes = full.groupBy(*by_set).agg(F.min("doc_id").alias("first_id"))
    firsts = full.join(classes.select(F.col("first_id").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    banded = firsts.select("doc_id", F.explode("bands").alias("band"))
    leads = banded.groupBy("band").agg(F.min("doc_id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = banded.join(leads.select("band", "lead"), "band").where("doc_id <> lead")
    clusters = components(stars.select(F.col("doc_id").alias("u"), F.col("lead").alias("v")))
    members = saved(
        clusters.select(F.col("vertex").alias("doc_id"), F.col("component").alias("cluster")).join(
            firsts.select("doc_id", "registers"), "doc_id"
        )
    )
    links = components(_cluster_links(members, docs, size, percent, id_col, text_col))
    joined = classes.join(links.withColumnRenamed("vertex", "first_id"), "first_id", "left").select(
        *by_set, F.coalesce("component", "first_id").alias("component")
    )
    return made.join(joined, by_set, "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def one_of_each_group(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that have the smallest id of their component; of rows with one id all stay."""
    groups = near_duplicates(docs, percent, id_col=id_col, text_col=text_col)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = near_duplicates(read_table(spark, folder, "documents"), percent=85)
    return rows.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s
  FROM words, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, cast(coalesce(n.n, 0) AS bigint) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp ON comp.a = d.doc_id
"""

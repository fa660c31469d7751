"""Best-fit packing into sequences of several permitted lengths.

Lengths come in descending order. A piece goes to the open bin with the least room that still holds it; where none
does, a bin is opened in the size whose cost for each token it can still be filled with is least. The
cost of a bin is its capacity plus a fixed cost. Opening the least-cost size and opening each single size are all
tried, and the cheapest packing is kept after every bin is downsized to the smallest permitted length that holds
its contents.

Documents are dealt to shards of about ``SHARD_TOKENS`` tokens by a hash of id and piece, each shard is packed by
itself, so no task grows with the input. Texts longer than the longest permitted length are cut into pieces of
that length and a rest; a document can end in several bins.

Defined results: documents without words (null and empty texts) give one row without a bin and 0 tokens; repeated
rows are packed one by one; ties go by id, then piece; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.llm.common import read_table, saved

CAPACITIES = (512, 1024, 2048, 4096)
#: What a bin costs besides its capacity, in tokens.
BIN_COST = 32
SHARD_TOKENS = 500_000


def best_fit(lengths: list[int], capacities: tuple[int, ...], bin_cost: int, opening: int | None) -> tuple[list[int], list[int], int]:
    """Bin and place of each length (given in descending order), and the cost; ``opening``: the size to open, or None for the least-cost one."""
    sizes = sorted(capacities)
    left = sum(lengths)
    room_bins: dict[int, list[int]] = {}
    rooms = 0  # bit r is set when an open bin has r tokens of room
    bins, places, used = [], [], []
    for length in lengths:
        fitting = rooms >> length
        if fitting:
            room = (fitting & -fitting).bit_length() - 1 + length
            stack = room_bins[room]
            number = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
        else:
            possible = [s for s in sizes if s >= length]
            if opening is None:
                room = min(possible, key=lambda s: ((s + bin_cost) / min(s, left), s))  # noqa: B023
            else:
                room = opening if opening >= length else possible[0]
            number = len(used)
            used.append(0)
        bins.append(number)
        places.append(used[number])
        used[number] += length
        left -= length
        room -= length
        if room:
            room_bins.setdefault(room, []).append(number)
            rooms |= 1 << room
    cost = sum(next(s for s in sizes if s >= n) + bin_cost for n in used)
    return bins, places, cost


def pack_lengths(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST) -> tuple[list[int], list[int], list[int], list[int]]:
    """Bin, place, downsized capacity and contents of the bin for each length (descending), under the cheapest opening rule."""
    tried = (best_fit(lengths, capacities, bin_cost, opening) for opening in (None, *sorted(capacities, reverse=True)))
    bins, places, _ = min(tried, key=lambda t: t[2])
    held = np.bincount(bins, weights=lengths).astype(np.int64) if lengths else np.zeros(0, np.int64)
    sizes = np.sort(np.array(capacities, np.int64))
    downsized = sizes[np.searchsorted(sizes, held)]
    return bins, places, downsized[bins].tolist() if lengths else [], held[bins].tolist() if lengths else []


def word_tokens(text_col: str) -> Column:
    """Words of the text and one end token; 0 for a text without words."""
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")
    return F.when(words > 0, words + 1).otherwise(F.lit(0).cast("long"))


_PACKED = "doc_id {kind}, piece int, start long, n_tokens long, bin_id long, bin_capacity long, bin_tokens long, bin_start long"


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST, id_col: str = "doc_id",
         text_col: str = "text", tokens: Column | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row for each piece: document, place in it, tokens, and the bin with its capacity, contents and the piece's place."""
    longest = max(capacities)
    lengths = saved(
        docs.select(F.col(id_col).alias("doc_id"), (word_tokens(text_col) if tokens is None else tokens).cast("long").alias("n"))
    )
    kind = dict(lengths.dtypes)["doc_id"]
    total = lengths.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    piece = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / longest) - 1, F.lit(0)).cast("int")))
    pieces = (
        lengths.where("n > 0")
        .select("doc_id", "n", piece.alias("piece"))
        .select(
            "doc_id",
            "piece",
            (F.col("piece") * F.lit(longest).cast("long")).alias("start"),
            F.least(F.lit(longest).cast("long"), F.col("n") - F.col("piece") * F.lit(longest).cast("long")).alias("n_tokens"),
            F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).alias("shard"),
        )
    )
    names = [part.strip().split(" ")[0] for part in _PACKED.split(",")]

    def pack_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, places, sizes, held = pack_lengths(table["n_tokens"].to_pylist(), capacities, bin_cost)
        first = table["shard"][0].as_py() << 32
        added = {"bin_id": [first + b for b in bins], "bin_capacity": sizes, "bin_tokens": held, "bin_start": places}
        table = table.drop_columns(["shard"])
        for name, values in added.items():
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table.select(names)

    packed = pieces.groupBy("shard").applyInArrow(pack_shard, _PACKED.format(kind=kind))
    empty = F.lit(None).cast("long")
    without = lengths.where("n = 0 or n is null").select(
        "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"),
        empty.alias("bin_id"), empty.alias("bin_capacity"), empty.alias("bin_tokens"), empty.alias("bin_start"),
    )
    return packed.unionByName(without)


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read_table(spark, folder, "documents"))

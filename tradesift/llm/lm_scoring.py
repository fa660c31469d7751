"""Scores of texts under a smoothed n-gram model, as a weighted backoff automaton.

States are the histories that occur in the training texts. A state has an arc for each word that follows it, with the
smoothed probability ``w * count(history, word) / count(history) + (1 - w) * shorter``, and a failure arc of weight
``1 - w`` to the state of the shorter history; the root has an arc for every word, ``(c + 1) / (N + V + 1)``, and one for all
unknown words. One pass from left to right carries the state: the longest history that exists.

The model grows with the corpus and is nowhere in one piece. Documents are dealt to blocks of a bounded number of bytes.
Each block sends its distinct n-grams, by hash range, to tasks that add up their counts; each range sends back how often
other blocks have the same n-grams. So each block gets the part of the automaton that its texts can
reach and walks it. A frequent n-gram is one entry for each block, never one for each occurrence.

Tokens: A-Z as a-z, words between white space, then one end, which is also the history of the first word. N-grams are
told apart by 64-bit hashes (at least 48 bits within a range).

Defined results: null texts are empty and have the end alone; rows with a null id are scored, not learned from; repeated
rows count and are scored each; without training texts every probability of the base is 1; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.llm.common import STEP, WORD_HASHES, crc_of_id, mixed, read_table, text_bytes

ORDER = 2
#: Weight of the longer history where it is known.
WEIGHT = 0.15
BLOCK_BYTES = 8 << 20
#: Bytes of text whose n-grams one range holds, about.
RANGE_BYTES = 4 << 20
_END = np.uint64(0x5BD1E995A3C7F1D9)


def token_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the words and of the end."""
    words = text.lower().split() if text else []
    hashes = np.empty(len(words) + 1, np.uint64)
    hashes[:-1] = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    hashes[-1] = _END
    return hashes


def ngram_hashes(padded: np.ndarray, order: int) -> list[np.ndarray]:
    """For each length up to ``order``, the hash of the n-gram that ends at each token after the first ``order - 1``."""
    size = len(padded) - order + 1
    rows, total = [], np.zeros(size, np.uint64)
    for n in range(1, order + 1):
        # from the last token back, so each longer n-gram extends the shorter one
        total = mixed(total * STEP + padded[order - n : order - n + size])
        rows.append(mixed(total + np.uint64(n)))
    return rows


class Ranges:
    """Hash ranges: the leading bits name the range, the next 48 or fewer the n-gram within it."""

    def __init__(self, bits: int):
        self.bits = bits
        self.drop = max(0, 16 - bits)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(self.drop)

    def part(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.drop - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)

    def packed(self, keys: np.ndarray) -> bytes:
        rest = keys & np.uint64((1 << (64 - self.drop - self.bits)) - 1)
        return rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()

    @staticmethod
    def unpacked(data: bytes) -> np.ndarray:
        wide = np.zeros((len(data) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
        return wide.view("<u8").ravel()


def to_bytes(counts: np.ndarray) -> bytes:
    """A byte for each count, and those of 255 and more behind in full."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def from_bytes(data: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(data, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", offset=n)
    return counts


class Block:
    """The n-grams of a block of texts: sorted distinct keys, their counts in training texts, and the key of each token."""

    def __init__(self, texts: list[bytes | None], learn: list[bool], order: int, ranges: Ranges):
        tokens = [token_hashes(t) for t in texts]
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.order = order
        # ends stand before each text, so no n-gram reaches into the text before
        pad = np.full(order - 1, _END)
        flat = np.concatenate([part for t in tokens for part in (pad, t)] or [np.zeros(0, np.uint64)])
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])).astype(np.int64) if len(tokens) else self.sizes
        owner = np.repeat(np.arange(len(tokens)), self.sizes)
        at = np.arange(len(owner)) + owner * (order - 1)
        every = np.concatenate([ranges.keys(row[at]) for row in ngram_hashes(flat, order)]) if len(tokens) else np.zeros(0, np.uint64)
        by = np.argsort(every)
        ordered = every[by]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(ordered)]
        self.keys = ordered[new]
        self.number = np.empty(len(every), np.int32)
        self.number[by] = np.cumsum(new) - 1
        weight = np.tile(np.array(learn, bool)[owner], order) if len(tokens) else np.zeros(0, bool)
        self.counts = np.bincount(self.number[weight], minlength=len(self.keys)).astype(np.int64)
        # the history before a text: of one token it is the end, longer ones are ends alone
        self.before = [ranges.keys(ngram_hashes(np.full(2 * n - 1, _END), n)[-1])[0] for n in range(1, order)]

    def spans(self, ranges: Ranges) -> list[tuple[int, int, int]]:
        """(range, first, end) of the keys."""
        part = ranges.part(self.keys)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        return list(zip(part[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True))

    def walk(self, counts: np.ndarray, n_tokens: int, n_types: int, weight: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known tokens, log10 of the base, log10 of the model) of each text. counts: of the keys, in the whole corpus."""
        grams = counts[self.number].reshape(self.order, -1)
        base = (grams[0] + 1) / (n_tokens + n_types + 1)
        probability = base
        for n in range(2, self.order + 1):
            history = np.empty_like(grams[n - 2])
            history[1:] = grams[n - 2][:-1]
            at = np.searchsorted(self.keys, self.before[n - 2])
            history[self.starts] = counts[at] if at < len(self.keys) and self.keys[at] == self.before[n - 2] else 0
            # where the state of the longer history is missing, the failure arc has been taken at no cost
            arc = weight * grams[n - 1] / np.maximum(history, 1) + (1 - weight) * probability
            probability = np.where(history > 0, arc, probability)
        add = lambda values: np.add.reduceat(values, self.starts)
        return add((grams[0] > 0).astype(np.int64)), add(np.log10(base)), add(np.log10(probability))


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens of the training texts. docs: text, learn."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(8)
        for batch in batches:
            texts = [t for t, learn in zip(text_bytes(batch, "text"), batch.column("learn").to_pylist(), strict=True) if learn]
            if not texts:
                continue
            hashes = np.concatenate([token_hashes(t) for t in texts])
            found = np.unique(ranges.keys(hashes))
            own = ranges.part(found)
            cuts = np.searchsorted(own, np.arange(257))
            rows = [(part, ranges.packed(found[a:b])) for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": [0, *(p for p, _ in rows)],
                    "rest": pa.array([b"", *(r for _, r in rows)], pa.binary()),
                    "n": [len(hashes), *(0 for _ in rows)],
                },
                schema=pa.schema([("part", pa.int64()), ("rest", pa.binary()), ("n", pa.int64())]),
            )

    def distinct(table: pa.Table) -> pa.Table:
        seen = np.unique(np.concatenate([Ranges.unpacked(r) for r in table["rest"].to_pylist()]))
        return pa.table({"n_tokens": [sum(table["n"].to_pylist())], "n_types": [len(seen)]})

    found = docs.mapInArrow(parts, "part long, rest binary, n long").groupBy("part").applyInArrow(distinct, "n_tokens long, n_types long")
    row = found.agg(F.sum("n_tokens"), F.sum("n_types")).first()
    return row[0] or 0, row[1] or 0


def score(docs: DataFrame, learn: Column, order: int = ORDER, weight: float = WEIGHT, block_bytes: int = BLOCK_BYTES,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every document; learns from the rows where ``learn`` holds."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn")
    )
    kind = dict(rows.dtypes)["doc_id"]
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_tokens, n_types = corpus_size(rows.select("text", "learn"))
    n_blocks = max(1, -(-size // block_bytes))
    ranges = Ranges(min(40, max(0, (size // RANGE_BYTES).bit_length())))
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)))

    def block_of(table: pa.Table) -> Block:
        return Block(table["text"].cast(pa.binary()).to_pylist(), table["learn"].to_pylist(), order, ranges)

    def count(table: pa.Table) -> pa.Table:
        own = block_of(table)
        spans = own.spans(ranges)
        return pa.table(
            {
                "block": pa.array([table["block"][0].as_py()] * len(spans), pa.int64()),
                "part": pa.array([part for part, _, _ in spans], pa.int64()),
                "rest": pa.array([ranges.packed(own.keys[a:b]) for _, a, b in spans], pa.binary()),
                "counts": pa.array([to_bytes(own.counts[a:b]) for _, a, b in spans], pa.binary()),
            }
        )

    def add_up(table: pa.Table) -> pa.Table:
        """How often each n-gram of a block occurs in the other blocks; a block knows its n-grams, so only counts go back."""
        rests = [Ranges.unpacked(r) for r in table["rest"].to_pylist()]
        own = np.concatenate([from_bytes(c, len(r)) for c, r in zip(table["counts"].to_pylist(), rests, strict=True)])
        every = np.concatenate(rests)
        by = np.argsort(every)
        new = np.concatenate(([True], every[by][1:] != every[by][:-1]))
        number = np.empty(len(every), np.int64)
        number[by] = np.cumsum(new) - 1
        others = np.bincount(number, own).astype(np.int64)[number] - own
        ends = np.cumsum([len(r) for r in rests]).tolist()
        counts = [to_bytes(others[b - len(r) : b]) for r, b in zip(rests, ends, strict=True)]
        return pa.table({"block": table["block"], "part": table["part"], "counts": pa.array(counts, pa.binary())})

    def score_block(texts: pa.Table, answers: pa.Table) -> pa.Table:
        own = block_of(texts)
        counts = own.counts.copy()
        others = dict(zip(answers["part"].to_pylist(), answers["counts"].to_pylist(), strict=True))
        for part, a, b in own.spans(ranges):
            counts[a:b] += from_bytes(others[part], b - a)
        known, base, model = own.walk(counts, n_tokens, n_types, weight)
        return pa.table(
            {
                "doc_id": texts["doc_id"],
                "n_tokens": pa.array(own.sizes, pa.int64()),
                "n_known": pa.array(known, pa.int64()),
                "train_tokens": pa.array(np.full(len(known), n_tokens), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(model, pa.float64()),
            }
        )

    counted = blocked.groupBy("block").applyInArrow(count, "block long, part long, rest binary, counts binary")
    answers = counted.groupBy("part").applyInArrow(add_up, "block long, part long, counts binary")
    schema = f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score_block, schema)


def op5_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    rest = F.pmod(crc_of_id("doc_id"), F.lit(7))
    scored = score(docs, learn=rest != 2)
    held_out = F.coalesce(rest == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

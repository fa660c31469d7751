"""Exact substring dedup by suffix sorting: every byte of a ``WINDOW``-byte string that also starts earlier goes.

Candidates. Every window has an anchor: the least hash among the ``GRAM``-byte strings inside it. Equal windows have equal
anchors at the same place, so windows can only be equal where anchors are. The bytes around an anchor that its windows can
reach are its context. Of equal contexts all but the first are removed as a whole. First contexts
whose anchor string occurs in other contexts are compared byte by byte, by suffix sorting.

Suffix sorting is the linear grouping construction: suffixes are grouped by their first symbol; groups are processed in
descending order, and the previous smaller suffixes of a group's members are moved up within their own groups, by how
often the group follows them, until every group holds the suffixes of one longest Lyndon prefix. Then, from the
least suffix on, each suffix puts the chain of previous smaller suffixes in front of it at the next free place
of their groups. No names are given anew and nothing recurses. The bytes that all windows of a stretch share are one symbol, so
a context takes some 25 symbols where it differs instead of 150 bytes.

The work moves by hash ranges of anchors and by blocks of documents, as packed arrays; the documents are
shuffled once. Equal contexts are combined before they are sent. Defined results: null texts are empty; rows
with equal ids and texts are copies of one document; different texts of one id are documents of their own, in the order of
their SHA-256; rows without an id are before all others and count as having one id; other columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.llm.common import mixed, read_table, shared_folder, text_bytes
from tradesift.operators.ordered import with_number

WINDOW = 100
GRAM = 50
#: Places that a window can have before its anchor.
REACH = WINDOW - GRAM
#: Windows of a stretch: their shared bytes are one symbol.
STRETCH = 7
BLOCK_BYTES = 8 << 20
RANGE_BYTES = 8 << 20
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20
#: Symbols that are sorted at once; larger groups are divided by their symbols.
SORT_SYMBOLS = 100_000
_NO_ID = -(1 << 63)

_BASE = 0x9E3779B97F4A7C15
_LENGTH_FACTOR, _LEFT_FACTOR = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(base: int) -> np.ndarray:
    powers = np.full(PIECE + WINDOW + 2 * REACH + 2, base, np.uint64)
    powers[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(powers, dtype=np.uint64)


_WEIGHTS = np.random.default_rng(8).integers(0, 1 << 63, REACH + WINDOW, np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS, _INVERSES = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _sliding(values: np.ndarray, width: int, take) -> np.ndarray:
    """``take`` (minimum or maximum) of every run of ``width`` values."""
    done = 1
    while 2 * done <= width:
        values = take(values[:-done], values[done:])
        done *= 2
    return take(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of a text, hashes of their strings and hashes of their contexts."""
    places, grams, contexts = [], [], []
    size = len(text)
    for start in range(0, size if size >= WINDOW else 0, PIECE):
        # what decides about an anchor lies at most REACH before and WINDOW + REACH after it
        low, high = max(0, start - REACH), min(size, start + PIECE + WINDOW)
        if high - low < WINDOW:
            low = max(0, high - WINDOW)
        data = np.frombuffer(text, np.uint8, high - low, low).astype(np.uint64) + np.uint64(1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data * _POWERS[: len(data)], dtype=np.uint64)))
        hashes = mixed((sums[GRAM:] - sums[:-GRAM]) * _INVERSES[: len(data) - GRAM + 1])
        least = _sliding(hashes, REACH + 1, np.minimum)
        edge = np.zeros(REACH, np.uint64)
        chosen = _sliding(np.concatenate((edge, least, edge)), REACH + 1, np.maximum) == hashes
        at = np.flatnonzero(chosen)
        at = at[(at + low >= start) & (at + low < start + PIECE)]
        left, right = np.minimum(at + low, REACH), np.minimum(size - at - low, WINDOW)
        first, stop = at - left, at + right
        around = (sums[stop] - sums[first]) * _INVERSES[first]
        places.append(at + low)
        grams.append(hashes[at])
        contexts.append(mixed(around + (stop - first).astype(np.uint64) * _LENGTH_FACTOR + left.astype(np.uint64) * _LEFT_FACTOR))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(grams), np.concatenate(contexts)


def suffix_array(symbols: list[int]) -> list[int]:
    """Suffix array by the linear grouping construction; symbols are positive."""
    text = [*symbols, 0]
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n
    group = [0] * n  # a group is named by its first place
    size = [0] * n
    start = 0
    for k, s in enumerate(order):
        if k and text[s] != text[order[k - 1]]:
            start = k
        place[s] = k
        group[s] = start
        size[start] += 1
    previous = [-1] * n
    # descending over the groups; a processed group is final
    stop = n
    while stop > 0:
        first = group[order[stop - 1]]
        members = order[first:stop]
        if len(members) > 1:
            members.sort()
        times: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= first:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            by_times: dict[int, list[int]] = {}
            for p, k in times.items():
                by_times.setdefault(k, []).append(p)
            # the more often the group follows, the greater: those move to the upper end of their groups first
            for k in sorted(by_times, reverse=True):
                moved: dict[int, int] = {}
                for p in by_times[k]:
                    g = group[p]
                    moved[g] = moved.get(g, 0) + 1
                    end = g + size[g] - moved[g]
                    other, at = order[end], place[p]
                    order[end], order[at] = p, other
                    place[p], place[other] = end, at
                for g, m in moved.items():
                    new = g + size[g] - m
                    if m < size[g]:
                        size[g] -= m
                        size[new] = m
                for p in by_times[k]:
                    g = group[p]
                    if moved[g] and place[p] >= g + size[g]:
                        group[p] = g + size[g]
        stop = first
    # from the least suffix on, what stands in front of a suffix takes the next place of its group
    free = list(range(n))
    order = [0] * n
    order[0] = n - 1
    done = [False] * n
    done[n - 1] = True
    for k in range(n):
        s = order[k] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            order[free[g]] = s
            free[g] += 1
            done[s] = True
            s = previous[s]
    return order[1:]


def equal_windows(strings: list[np.ndarray], length: int) -> list[np.ndarray]:
    """For each place of each string, a number that equal ``length``-symbol windows share; -1 where none fits."""
    # one separator stands behind each string; it is smaller than all symbols
    joined = np.concatenate([part for s in strings for part in (s + 1, [1])])
    order = np.array(suffix_array(joined.tolist()), np.int64)
    padded = np.concatenate((joined, np.zeros(length, joined.dtype)))
    views = np.lib.stride_tricks.sliding_window_view(padded, length)
    same = (views[order[1:]] == views[order[:-1]]).all(axis=1)
    number = np.empty(len(joined), np.int64)
    number[order] = np.concatenate(([0], np.cumsum(~same)))
    numbers: list[np.ndarray] = []
    start = 0
    for s in strings:
        mine = number[start : start + len(s)].copy()
        mine[max(0, len(s) - length + 1) :] = -1
        numbers.append(mine)
        start += len(s) + 1
    return numbers


def _spans_of(keys: np.ndarray) -> list[tuple[int, int]]:
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return list(zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True))


def repeated_windows(contexts: np.ndarray, lefts: np.ndarray, sizes: np.ndarray, fingers: np.ndarray, docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each context a mask of the windows (bit k: the window k places after the farthest one before the anchor) that
    also start in an earlier context. contexts: rows of bytes, the anchor at place REACH, 0 beyond the text."""
    masks = np.zeros(len(docs), np.uint64)
    order = np.lexsort((places, docs))
    rank = np.empty(len(docs), np.int64)
    rank[order] = np.arange(len(docs))
    short = (lefts < REACH) | (sizes - lefts < WINDOW)
    # where a text ends within reach of a context, all contexts of its anchor string are compared as a whole
    with_cut = np.isin(fingers, fingers[short]) if short.any() else short
    whole = np.flatnonzero(with_cut)
    if len(whole):
        core = np.unique(fingers[whole], return_inverse=True)[1].ravel() + 1000
        strings = []
        for r, symbol in zip(whole.tolist(), core.tolist(), strict=True):
            bytes_ = contexts[r].astype(np.int64)
            low, high = REACH - int(lefts[r]), REACH + int(sizes[r] - lefts[r])
            strings.append(np.concatenate((bytes_[low:REACH] + 1, [symbol], bytes_[REACH + GRAM : high] + 1)))
        _mark(masks, strings, REACH + 1, REACH - lefts[whole], whole, rank)
    rows = np.flatnonzero(~with_cut)
    if not len(rows):
        return masks
    # all contexts lie alike around their anchors, so one running sum of weighted bytes names any part of them
    sums = np.zeros((len(rows), REACH + WINDOW + 1), np.uint64)
    np.cumsum(contexts[rows].astype(np.uint64) * _WEIGHTS, axis=1, dtype=np.uint64, out=sums[:, 1:])
    named = lambda first, stop: mixed(mixed(sums[:, stop] - sums[:, first]) + fingers[rows])
    for first in range(0, REACH + 1, STRETCH):
        count = min(STRETCH, REACH + 1 - first)
        _, core, many = np.unique(named(first + count - 1, first + WINDOW), return_inverse=True, return_counts=True)
        core = core.ravel()
        shared = np.flatnonzero(many[core] > 1)
        if not len(shared):
            continue
        stretch = named(first, first + WINDOW + count - 1)[shared]
        by = np.lexsort((rank[rows[shared]], stretch))
        again = np.concatenate(([False], stretch[by][1:] == stretch[by][:-1]))
        # of equal stretches all but the first are repeats
        masks[rows[shared[by[again]]]] |= np.uint64(((1 << count) - 1) << first)
        units = shared[by[~again]]
        # a stretch that stands alone around its shared bytes needs no comparison
        units = units[np.bincount(core[units], minlength=len(many))[core[units]] > 1]
        if len(units):
            bytes_ = contexts[rows[units]].astype(np.int64) + 1
            left, right = bytes_[:, first : first + count - 1], bytes_[:, first + WINDOW : first + WINDOW + count - 1]
            symbols = np.concatenate((left, core[units, None] + 1000, right), axis=1)
            _mark(masks, list(symbols), count, np.full(len(units), first), rows[units], rank)
    return masks


def _mark(masks: np.ndarray, strings: list[np.ndarray], length: int, first_bits: np.ndarray, rows: np.ndarray, rank: np.ndarray) -> None:
    """Sets the bits of the windows of ``length`` symbols that an earlier row has as well."""
    numbers = _numbered(strings, length)
    owner = np.repeat(np.arange(len(strings)), [len(x) for x in numbers])
    bit = np.concatenate([np.arange(len(x)) for x in numbers]) + first_bits[owner]
    number = np.concatenate(numbers)
    fits = number >= 0
    owner, bit, number = owner[fits], bit[fits], number[fits]
    # equal windows lie alike around their anchors; the place decides between two of one document
    by = np.lexsort((rank[rows[owner]], number))
    again = by[np.concatenate(([False], number[by][1:] == number[by][:-1]))]
    np.bitwise_or.at(masks, rows[owner[again]], np.uint64(1) << bit[again].astype(np.uint64))


def _numbered(strings: list[np.ndarray], length: int) -> list[np.ndarray]:
    """``equal_windows`` over batches of about ``SORT_SYMBOLS`` symbols; every window holds the core symbol of its string.

    Equal windows lie alike around their core. A group of one core that is too large for a batch is divided by the symbol
    before the ones its strings share: no window that holds this symbol has an equal one in another part. The windows that
    begin behind it are told apart by their symbols beforehand, over the whole group."""
    cores = np.array([int(s.max()) for s in strings])
    middle = [int(s.argmax()) for s in strings]
    order = np.argsort(cores, kind="stable")
    out = [np.full(len(s), -1, np.int64) for s in strings]
    batch: list[tuple[int, int]] = []
    held = offset = 0

    def sort_batch() -> None:
        nonlocal offset
        for (k, shared), numbers in zip(batch, equal_windows([strings[k] for k, _ in batch], length), strict=True):
            mine = numbers[: middle[k] - shared + 1]
            out[k][: len(mine)] = np.where(mine >= 0, mine + offset, -1)
        offset += held

    # groups of strings with one core and so many equal symbols before it
    todo = [(order[a:b].tolist(), 0) for a, b in reversed(_spans_of(cores[order]))]
    while todo:
        group, shared = todo.pop()
        size = sum(len(strings[k]) + 1 for k in group)
        if len(group) > 1 and size > SORT_SYMBOLS:
            seen: dict[bytes, int] = {}
            for k in group:
                start = middle[k] - shared
                if start + length <= len(strings[k]):
                    rest = strings[k][middle[k] + 1 : start + length].astype(np.uint16).tobytes()
                    out[k][start] = offset + seen.setdefault(rest, len(seen))
            offset += len(seen)
            parts: dict[int, list[int]] = {}
            for k in group:
                if middle[k] > shared:
                    parts.setdefault(int(strings[k][middle[k] - shared - 1]), []).append(k)
            todo += [(part, shared + 1) for part in parts.values()]
            continue
        if batch and held + size > SORT_SYMBOLS:
            sort_batch()
            batch, held = [], 0
        batch += [(k, shared) for k in group]
        held += size
    if batch:
        sort_batch()
    return out


def _block_of(ids: np.ndarray, n_blocks: int) -> np.ndarray:
    """The block of each document id, as ``crc32`` of its digits has it in Spark."""
    unique, inverse = np.unique(ids, return_inverse=True)
    return np.array([zlib.crc32(str(i).encode()) % n_blocks for i in unique.tolist()], np.int64)[inverse]


_PACKED = "{key} long, kind int, ids binary, places binary, fingers binary"


def _packed(key: str, rows: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> dict:
    return {
        key: pa.array([r[0] for r in rows], pa.int64()),
        "kind": pa.array([r[1] for r in rows], pa.int32()),
        "ids": pa.array([r[2].astype("<i8").tobytes() for r in rows], pa.binary()),
        "places": pa.array([r[3].astype("<i8" if r[3].max(initial=0) >= 1 << 31 else "<i4").tobytes() for r in rows], pa.binary()),
        "fingers": pa.array([r[4].astype("<u8").tobytes() for r in rows], pa.binary()),
    }


def _unpacked(table: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, places, fingers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for k, i, p, f in zip(*(table[c].to_pylist() for c in ("kind", "ids", "places", "fingers")), strict=True):
        if k == kind:
            ids.append(np.frombuffer(i, "<i8"))
            places.append(np.frombuffer(p, "<i8" if len(p) == len(i) else "<i4").astype(np.int64))
            fingers.append(np.frombuffer(f, "<u8"))
    return np.concatenate(ids), np.concatenate(places), np.concatenate(fingers)


def _split(key_of: np.ndarray, kind: int, ids: np.ndarray, places: np.ndarray, more: np.ndarray) -> list:
    """Rows of packed arrays, one for each key."""
    by = np.argsort(key_of, kind="stable")
    return [(int(key_of[by[a]]), kind, ids[by[a:b]], places[by[a:b]], more[by[a:b]] if len(more) else more) for a, b in (_spans_of(key_of[by]) if len(by) else [])]


REPEAT, COMPARE = 0, 1
_NOTHING = np.zeros(0, np.uint64)


def removed_spans(text: bytes, places: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Flags of the bytes that windows cover. masks: the windows of each anchor place that are repeats."""
    size = len(text)
    starts = np.zeros(size + 1, bool)
    for bit in range(REACH + 1):
        at = places[(masks >> np.uint64(bit)) & np.uint64(1) == 1] - REACH + bit
        starts[at[(at >= 0) & (at <= size - WINDOW)]] = True
    change = np.zeros(size + 1, np.int64)
    at = np.flatnonzero(starts)
    change[at] += 1
    np.add.at(change, np.minimum(at + WINDOW, size), -1)
    return np.cumsum(change[:size]) > 0


def _with_order(docs: DataFrame) -> DataFrame:
    """Adds ``id``, by which texts are ordered: the document's id, a null one first.

    Where one id has different texts (rows without an id count as having one), that is no order; then the distinct pairs of
    id and hash of the text are numbered, over ranges of about the same number of them.
    """
    named = docs.withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID)))
    hashed = named.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    per_id = hashed.groupBy("id").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most"))
    if per_id.where("least <> most").isEmpty():
        return named
    pairs = hashed.distinct().withColumn("all", F.lit(True))
    shared_folder(docs.sparkSession)
    numbers = with_number(pairs, ["all"], ["id", "text_hash"], "number").select("id", "text_hash", "number")
    hashed_docs = named.withColumn("text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    return hashed_docs.join(numbers, ["id", "text_hash"]).select("doc_id", "text", F.col("number").cast("long").alias("id"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every document; kept: the bytes that stay."""
    narrow = _with_order(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    n_ranges = max(1, -(-size // RANGE_BYTES))
    blocked = narrow.withColumn("block", F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(n_blocks)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *anchors(t)) for i, t in zip(batch.column("id").to_pylist(), text_bytes(batch, "text"), strict=True) if t]
            found = [f for f in found if len(f[1])]
            if not found:
                continue
            ids = np.repeat(np.array([f[0] for f in found], np.int64), [len(f[1]) for f in found])
            places, grams, contexts = (np.concatenate([f[k] for f in found]) for k in (1, 2, 3))
            # of equal contexts only the first is sent to its range; the others are repeats already
            order = np.lexsort((places, ids, contexts, grams))
            again = np.zeros(len(order), bool)
            again[order[1:]] = (grams[order[1:]] == grams[order[:-1]]) & (contexts[order[1:]] == contexts[order[:-1]])
            same_place = np.zeros(len(order), bool)
            same_place[order[1:]] = again[order[1:]] & (ids[order[1:]] == ids[order[:-1]]) & (places[order[1:]] == places[order[:-1]])
            parts = (grams % np.uint64(n_ranges)).astype(np.int64)
            first = ~again
            rows = []
            by = np.argsort(parts[first], kind="stable")
            f_ids, f_places, f_grams, f_contexts = ids[first][by], places[first][by], grams[first][by], contexts[first][by]
            for a, b in _spans_of(parts[first][by]) if len(by) else []:
                pairs = np.stack((f_grams[a:b], f_contexts[a:b]), axis=1).ravel()
                rows.append((int(f_grams[a] % np.uint64(n_ranges)), COMPARE, f_ids[a:b], f_places[a:b], pairs))
            later = again & ~same_place
            rows += _split(ids[later] % n_ranges, REPEAT, ids[later], places[later], _NOTHING)
            yield pa.RecordBatch.from_pydict(_packed("part", rows))

    def match(table: pa.Table) -> pa.Table:
        """Repeats of whole contexts, and the first contexts that share an anchor string with others."""
        ids, places, pairs = _unpacked(table, COMPARE)
        grams, contexts = pairs[0::2], pairs[1::2]
        order = np.lexsort((places, ids, contexts, grams))
        ids, places, grams, contexts = ids[order], places[order], grams[order], contexts[order]
        again = np.zeros(len(ids), bool)
        again[1:] = (grams[1:] == grams[:-1]) & (contexts[1:] == contexts[:-1])
        later = again.copy()
        later[1:] &= (ids[1:] != ids[:-1]) | (places[1:] != places[:-1])
        passed = _unpacked(table, REPEAT)
        r_ids, r_places = np.concatenate((ids[later], passed[0])), np.concatenate((places[later], passed[1]))
        ids, places, grams = ids[~again], places[~again], grams[~again]
        with_next = np.concatenate((grams[1:] == grams[:-1], [False])) if len(grams) else np.zeros(0, bool)
        shared = with_next | np.concatenate(([False], with_next[:-1])) if len(grams) else with_next
        rows = _split(_block_of(r_ids, n_blocks), REPEAT, r_ids, r_places, _NOTHING)
        rows += _split(_block_of(ids[shared], n_blocks), COMPARE, ids[shared], places[shared], grams[shared])
        return pa.table(_packed("block", rows))

    def cut_contexts(texts: pa.Table, found: pa.Table) -> pa.Table:
        """The bytes of the contexts to compare, by range of the anchor; repeats go along."""
        ids, places, fingers = _unpacked(found, COMPARE)
        data = dict(zip(texts["id"].to_pylist(), texts["text"].cast(pa.binary()).to_pylist(), strict=True))
        rows = np.zeros((len(ids), REACH + WINDOW), np.uint8)
        lefts, sizes = np.minimum(places, REACH), np.zeros(len(ids), np.int64)
        for k, (i, place) in enumerate(zip(ids.tolist(), places.tolist(), strict=True)):
            around = data[i][max(0, place - REACH) : place + WINDOW]
            sizes[k] = len(around)
            low = REACH - min(place, REACH)
            rows[k, low : low + len(around)] = np.frombuffer(around, np.uint8)
        out = []
        for part, _, _, _, at in _split((fingers % np.uint64(n_ranges)).astype(np.int64), COMPARE, ids, places, np.arange(len(ids), dtype=np.uint64)):
            at = at.astype(np.int64)
            out.append((part, COMPARE, ids[at], places[at], fingers[at], np.stack((lefts[at], sizes[at]), axis=1).astype(np.uint8).tobytes(), rows[at].tobytes()))
        r_ids, r_places, _ = _unpacked(found, REPEAT)
        if len(r_ids):
            out.append((found["block"][0].as_py() % n_ranges, REPEAT, r_ids, r_places, _NOTHING, b"", b""))
        table = _packed("part", out)
        return pa.table(table | {"cuts": pa.array([r[5] for r in out], pa.binary()), "contexts": pa.array([r[6] for r in out], pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        ids, places, fingers = _unpacked(table, COMPARE)
        r_ids, r_places, _ = _unpacked(table, REPEAT)
        rows = _split(_block_of(r_ids, n_blocks), REPEAT, r_ids, r_places, _NOTHING)
        if len(ids):
            contexts = np.frombuffer(b"".join(table["contexts"].to_pylist()), np.uint8).reshape(-1, REACH + WINDOW)
            cuts = np.frombuffer(b"".join(table["cuts"].to_pylist()), np.uint8).reshape(-1, 2).astype(np.int64)
            masks = repeated_windows(contexts, cuts[:, 0], cuts[:, 1], fingers, ids, places)
            some = masks > 0
            rows += _split(_block_of(ids[some], n_blocks), COMPARE, ids[some], places[some], masks[some])
        return pa.table(_packed("block", rows))

    def remove(texts: pa.Table, found: pa.Table) -> pa.Table:
        r_ids, r_places, _ = _unpacked(found, REPEAT)
        ids, places, masks = _unpacked(found, COMPARE)
        ids, places = np.concatenate((r_ids, ids)), np.concatenate((r_places, places))
        masks = np.concatenate((np.full(len(r_ids), (1 << (REACH + 1)) - 1, np.uint64), masks))
        by = np.argsort(ids, kind="stable")
        spans = {int(ids[by[a]]): by[a:b] for a, b in (_spans_of(ids[by]) if len(by) else [])}
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for i, text in zip(texts["id"].to_pylist(), texts["text"].cast(pa.binary()).to_pylist(), strict=True):
            text = text or b""
            at = spans.get(i)
            gone = removed_spans(text, places[at], masks[at]) if at is not None and len(text) >= WINDOW else np.zeros(len(text), bool)
            out["n_bytes"].append(len(text))
            out["n_removed"].append(int(gone.sum()))
            out["n_spans"].append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            out["kept"].append(np.frombuffer(text, np.uint8)[~gone].tobytes() if gone.any() else text)
        return pa.table(
            {"doc_id": texts["doc_id"], **{c: pa.array(out[c], pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")}, "kept": pa.array(out["kept"], pa.binary())}
        )

    packed = lambda key: _PACKED.format(key=key)
    sent = narrow.select("id", "text").mapInArrow(find, packed("part"))
    matched = sent.groupBy("part").applyInArrow(match, packed("block"))
    by_block = blocked.groupBy("block")
    cut = by_block.cogroup(matched.groupBy("block")).applyInArrow(cut_contexts, packed("part") + ", cuts binary, contexts binary")
    compared = cut.groupBy("part").applyInArrow(compare, packed("block"))
    return by_block.cogroup(compared.groupBy("block")).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeats(read_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows by position: a window is a repeat when its bytes start earlier somewhere; runs are joined where they touch.
OP8_SQL = f"""WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, {2 * WINDOW})) AS k FROM (
  SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - {WINDOW - 1}))) AS i FROM d)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
s AS (SELECT doc_id, min(i) AS a, max(i) + {WINDOW} AS b FROM (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {WINDOW} THEN 0 ELSE 1 END AS fresh FROM r))
  GROUP BY doc_id, run),
g AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last,
  string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM g JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN k.kept IS NULL THEN h ELSE k.kept || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

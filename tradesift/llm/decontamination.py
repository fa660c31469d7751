"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items are lower-cased (A-Z) word sequences. One automaton holds all their substrings; a document is
streamed through it word by word, carrying the state and the longest matching length. A match of
``window`` words or more ends an occurrence of a window; an item with fewer words is one window of its own.

Defined results: null and empty texts have no words and no hits; items without words or without id are
ignored; repeated item ids count once; columns other than the named ones are never read, so their
names cannot clash. Rows that repeat are handled one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.llm.common import ASCII_LOWER, read_table, text_bytes

WINDOW = 10
#: Words of items that one automaton may hold; more items go to more automata, and each text meets all of them.
AUTOMATON_WORDS = 200_000
#: A document with a larger share of hit words is dropped by ``decontaminate``.
MAX_COVERAGE = 0.5

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Separators become spaces and A-Z small letters: the words are then what lies between spaces.
_TO_WORDS = bytes(
    32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_TO_WORDS).split() if text else []


class ItemAutomaton:
    """Generalised suffix automaton over word numbers, with the items of each window at its state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.arcs: list[dict[int, int]] = [{}]
        self.link = [0]
        self.length = [0]
        ends: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, words in items:
            last = 0
            for word in words:
                last = self._append(last, self.words.setdefault(word, len(self.words) + 1))
                ends.setdefault(last, set()).add(item)
            if words and len(words) < window:
                self.short.setdefault(last, []).append((len(words), item))
        # an item that passes a state passes all its suffixes: carry the items down the links, longest first
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[state]
            if up and state in ends:
                ends.setdefault(up, set()).update(ends[state])
        # short items are found at every state they are a suffix of
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            inherited = self.short.get(self.link[state], [])
            if inherited:
                self.short[state] = self.short.get(state, []) + inherited
        self.items = {s: tuple(v) for s, v in ends.items() if self.length[s] >= window}
        self.least = min([window, *(len(words) for _, words in items if words)])

    def _new(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.arcs.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.arcs[target]))
        self.link[target] = copy
        while self.arcs[state].get(word) == target:
            self.arcs[state][word] = copy
            if not state:
                break
            state = self.link[state]
        return copy

    def _append(self, last: int, word: int) -> int:
        target = self.arcs[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = self._new(self.length[last] + 1, 0, {})
        state = last
        while word not in self.arcs[state]:
            self.arcs[state][word] = new
            if not state:
                return new
            state = self.link[state]
        target = self.arcs[state][word]
        if self.length[target] != self.length[state] + 1:
            target = self._split(state, word, target)
        self.link[new] = target
        return new

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges (start, end), merged and in order, and the ids of the items that occur."""
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        if len(words) < self.least:
            return spans, found
        number = self.words.get
        ids = np.fromiter((number(w, 0) for w in words), np.int32, len(words))
        # words of no item send the automaton back to its root: only the runs between them are walked
        cuts = np.flatnonzero(ids == 0)
        starts = np.concatenate(([0], cuts + 1))
        stops = np.concatenate((cuts, [len(words)]))
        arcs, link, length, window, short = self.arcs, self.link, self.length, self.window, self.short
        for k in np.flatnonzero(stops - starts >= self.least):
            start = int(starts[k])
            state = size = 0
            for at, word in enumerate(ids[start : stops[k]].tolist(), start):
                target = arcs[state].get(word)
                if target is None:
                    while target is None and state:
                        state = link[state]
                        target = arcs[state].get(word)
                    size = length[state]
                    if target is None:
                        continue
                state = target
                size += 1
                if size >= window:
                    at_window = state
                    while length[link[at_window]] >= window:
                        at_window = link[at_window]
                    found.update(self.items.get(at_window, ()))
                    self._cover(spans, at - window + 1, at + 1)
                if short and state in short:
                    for n, item in short[state]:
                        if n <= size:
                            found.add(item)
                            self._cover(spans, at - n + 1, at + 1)
        return spans, found

    @staticmethod
    def _cover(spans: list[tuple[int, int]], start: int, end: int) -> None:
        while spans and spans[-1][1] >= start:
            start = min(start, spans.pop()[0])
        spans.append((start, end))


def automata(items: DataFrame, id_col: str, text_col: str, window: int) -> list[ItemAutomaton]:
    """Automata of all items. The items come to the driver part by part, each of a checked number of words."""
    rows = items.where(f"`{id_col}` is not null and `{text_col}` is not null").select(
        F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")
    )
    built, part, held = [], [], 0
    for row in rows.toLocalIterator():
        words = words_of(row.text.encode())
        if words:
            if part and held + len(words) > AUTOMATON_WORDS:
                built.append(ItemAutomaton(part, window))
                part, held = [], 0
            part.append((row.item, words))
            held += len(words)
    return [*built, ItemAutomaton(part, window)] if part else built


_HITS = "doc_id long, n_words long, spans array<struct<start:int,stop:int>>, items array<string>"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of several automata, in order, with those that touch as one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and out[-1][1] >= start:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
              item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, spans, items) of every row: merged hit word ranges and the items that occur."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(automata(items, item_id, item_text, window))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = shared.value
        for batch in batches:
            counts, spans, found = [], [], []
            for text in text_bytes(batch, "text"):
                words = words_of(text)
                # a row meets all automata here, so rows need no key that tells them apart
                hits = [a.find(words) for a in built]
                ranges = hits[0][0] if len(hits) == 1 else merged([s for own, _ in hits for s in own])
                counts.append(len(words))
                spans.append([{"start": a, "stop": b} for a, b in ranges])
                found.append(sorted(set().union(*(ids for _, ids in hits))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                    pa.array(found, pa.list_(pa.string())),
                ],
                names=["doc_id", "n_words", "spans", "items"],
            )

    return narrow.mapInArrow(scan, _HITS)


def digest(hits: DataFrame) -> DataFrame:
    """One row per document: counts, the digest of the item ids and whether anything was hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + (s.stop - s.start).cast("long"))
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def clean_text(text: bytes, automata_: list[ItemAutomaton], max_coverage: float) -> bytes | None:
    """The text without hit spans, repeated until nothing is hit; None when too much of it is hit."""
    words = words_of(text)
    while True:
        spans = sorted(s for a in automata_ for s in a.find(words)[0])
        if not spans:
            return text
        hit = set()
        for start, stop in spans:
            hit.update(range(start, stop))
        if len(hit) > max_coverage * len(words):
            return None
        places = [m.span() for m in _WORD.finditer(text.translate(ASCII_LOWER))]
        kept, at = [], 0
        for start, stop in spans:
            kept.append(text[at : max(at, places[start][0])])
            at = max(at, places[stop - 1][1])
        text = b"".join([*kept, text[at:]])
        words = words_of(text)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE,
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents with all their columns: hit spans are cut out of the text, and a document of which more than
    ``max_coverage`` of the words is hit goes. Untouched texts keep every byte."""
    built = automata(items, item_id, item_text, window)
    if not built:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(built)
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], []
            for text in batch.column(at).cast(pa.binary()).to_pylist():
                cleaned = clean_text(text, shared.value, max_coverage) if text else text
                keep.append(not text or cleaned is not None)
                texts.append(cleaned)
            table = batch.set_column(at, batch.schema.field(at), pa.array(texts, pa.binary()).cast(batch.column(at).type))
            yield table.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return digest(find_hits(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark")))


#: Windows of all lengths that occur are joined to the words of every document.
OP3_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT cast(item_id AS varchar) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
gram AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS r(i)),
hit AS (SELECT doc_id, gram.n, i, item_id FROM gram JOIN win ON gram.n = win.n AND gram.g = win.g),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hit)),
n_pos AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
ids AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY 1)
SELECT doc.doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit,
       cast(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN n_pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

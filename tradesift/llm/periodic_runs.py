"""Runs of repeated word sequences, found with a dictionary of basic factors.

A run is a longest stretch of words with smallest period q that holds at least four periods and six words. The dictionary
names every factor of 1, 2, 4, ... words: equal factors have equal names, and a name of twice the length is the pair of
two names. Where occurrences of one factor of m words follow each other at one distance d (m / 2 < d <= m), they form an
arithmetic progression and propose the period d: every run of period d holds three such occurrences from its first word
on, and no nearer occurrence can exist in it. Stretches of progressions are extended to both sides and kept once.

Names of many documents are made together, by sorting; places whose factor does not come again in its document are left
out of the next length, so ordinary prose is finished after a few lengths.

Defined results: words are separated by ASCII white space; a null or blank text has no words, no runs and an empty
collapsed text; repeated rows are handled one by one; columns other than the named ones are never read. One text is always
handled as a whole, in memory in proportion to its words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.llm.common import crc_of_id, read_table, text_bytes

#: The least number of periods and of words in a run.
MIN_PERIODS = 4
MIN_WORDS = 6
#: Words of the documents that are named together (a longer document is named alone).
WORDS_AT_ONCE = 400_000

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _extended(ids: np.ndarray, bounds: tuple[np.ndarray, np.ndarray], runs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """Stretches (start, end, period) moved outwards while the neighbouring word keeps the period."""
    (low, high), (start, end, period) = bounds, runs
    while True:
        at = np.flatnonzero(start > low)
        at = at[ids[start[at] - 1] == ids[start[at] - 1 + period[at]]]
        if not len(at):
            break
        start[at] -= 1
    while True:
        at = np.flatnonzero(end < high)
        at = at[ids[end[at]] == ids[end[at] - period[at]]]
        if not len(at):
            break
        end[at] += 1
    return start, end, period


def runs_of(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of documents laid end to end; ``starts`` are their borders, the last included."""
    n = len(ids)
    doc_end = np.repeat(starts[1:], np.diff(starts))
    longest = int(np.diff(starts).max(initial=0))
    name = np.full(n, -1, np.int64)
    at, keys = np.arange(n, dtype=np.int64), ids.astype(np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    m = 1
    while len(at) and MIN_PERIODS * (m // 2 + 1) <= longest:
        order = np.argsort(keys, kind="stable")
        place, key = at[order], keys[order]
        fresh = np.r_[True, key[1:] != key[:-1]]
        ranks = np.cumsum(fresh) - 1
        gap = np.diff(place)
        gap[fresh[1:] | (place[1:] >= doc_end[place[:-1]])] = n + 1  # the next occurrence is another name's or document's
        following = np.zeros(n, np.int64)
        near = gap <= 2 * m
        following[place[:-1][near]] = gap[near]
        step = following[at]
        chain = at[(step > m // 2) & (step <= m)]
        chain = chain[following[chain + following[chain]] == following[chain]]
        if len(chain):
            d = following[chain]
            first = np.r_[True, (np.diff(chain) != 1) | (np.diff(d) != 0)]
            last = np.r_[first[1:], True]
            found.append((chain[first], chain[last] + 2 * d[last] + m, d[first]))
        # a longer factor that comes again in its document starts and ends with such a one of this length
        alive = np.zeros(len(place), bool)
        again = gap <= n
        alive[:-1] |= again
        alive[1:] |= again
        name.fill(-1)
        name[place[alive]] = ranks[alive]
        at = np.sort(place[alive])
        at = at[at + 2 * m <= doc_end[at]]
        at = at[name[at + m] >= 0]
        keys = name[at] * (int(ranks[-1]) + 1) + name[at + m]
        m *= 2
    if not found:
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    start, end, period = (np.concatenate(parts) for parts in zip(*found, strict=True))
    low = starts[np.searchsorted(starts, start, "right") - 1]
    start, end, period = _extended(ids, (low, doc_end[start]), (start, end, period))
    whole = end - start >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
    unique = np.unique(np.stack([start[whole], period[whole], end[whole] - start[whole]], 1), axis=0)
    return unique[:, 0], unique[:, 2], unique[:, 1]


def _collapse(texts: list[bytes | None]) -> Iterator[tuple[list[dict], bytes]]:
    """Runs and collapsed text of each of these texts."""
    words = [text.split() if text else [] for text in texts]
    starts = np.cumsum([0, *map(len, words)])
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    flat = np.fromiter((numbers[w] for part in words for w in part), np.int64, int(starts[-1]))
    start, length, period = runs_of(flat, starts)
    covered = np.zeros(len(flat) + 1, np.int64)
    np.add.at(covered, start + period, 1)
    np.add.at(covered, start + length, -1)
    dropped = np.cumsum(covered) > 0
    owner = np.searchsorted(starts, start, "right") - 1
    # documents without words share their border with the next one, which owns the run
    by_doc: defaultdict[int, list[dict]] = defaultdict(list)
    for doc, s, size, q in zip(owner.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        by_doc[doc].append({"start": s - int(starts[doc]), "length": size, "period": q})
    for doc, part in enumerate(words):
        runs = by_doc.get(doc, [])
        if runs:
            part = [w for w, drop in zip(part, dropped[starts[doc] : starts[doc + 1]].tolist(), strict=True) if not drop]
        yield runs, b" ".join(part)


def _portions(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    """Texts cut into portions of about WORDS_AT_ONCE words, judged by their bytes (a word and its blank take two or more)."""
    portion, size = [], 0
    for text in texts:
        if portion and size + len(text or b"") > 6 * WORDS_AT_ONCE:
            yield portion
            portion, size = [], 0
        portion.append(text)
        size += len(text or b"")
    if portion:
        yield portion


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed): runs by start and period, and the text without the repetitions, one row for each row."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for portion in _portions(text_bytes(batch, "text")):
                runs, kept = zip(*_collapse(portion), strict=True)
                columns = [
                    batch.column("doc_id").slice(at, len(portion)),
                    pa.array(runs, pa.list_(_RUN)),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "runs", "collapsed"])
                at += len(portion)

    kind = "array<struct<start:long,length:long,period:long>>"
    return narrow.mapInArrow(search, f"doc_id {dict(narrow.dtypes)['doc_id']}, runs {kind}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by its hash repeats its words from a place and with a period of the hash."""
    h = crc_of_id("doc_id")
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size("words").cast("long")
    placed = (
        docs.select("doc_id", "text", F.floor(h / 10).alias("g"), (h % 10 == 0).alias("planted"))
        .withColumn("words", F.when(F.col("planted"), words))
        .withColumn("a", F.when(n > 0, F.col("g") % n))
        .withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8)))
    )
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.transform("words", lambda _, i: F.get("words", at(i.cast("long")).cast("int")))
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the greatest one, and hashes of all runs and of the collapsed text."""
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    shown: list[Column | str] = [
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        (-F.col("top.less")).alias("length"),
        F.col("top.period").alias("period"),
        F.expr("(-1000 * top.less) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ]
    return found.withColumn("top", first).select(*shown)


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return digest(find_runs(with_planted_runs(read_table(spark, folder, "documents"))))


#: Words of the query, runs from equal five-word sequences (every run holds such a pair a period apart), shorter period first.
OP13_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
  xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h FROM documents),
e AS (SELECT rid, doc_id, words, len(words) AS n, coalesce(h % 10 = 0, false) AND len(words) > 0 AS planted, (h // 10) % len(words) AS a,
  1 + (len(words) - (h // 10) % len(words)) // (3 + (h // 10) % 8) AS p FROM d),
w0 AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM e),
w AS MATERIALIZED (SELECT t.rid, t.i, s.w FROM w0 t JOIN e USING (rid) JOIN w0 s
  ON s.rid = t.rid AND s.i = CASE WHEN planted AND t.i >= a THEN a + (t.i - a) % p ELSE t.i END),
g AS (SELECT rid, i, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS key
  FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
q AS (SELECT x.rid, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.rid = y.rid AND x.key = y.key AND x.i < y.i),
b AS (SELECT rid, q, min(i) AS s, count(*) + 4 + q AS size FROM
  (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM q) GROUP BY rid, q, island
  HAVING count(*) + 4 + q >= greatest({MIN_WORDS}, {MIN_PERIODS} * q)),
r AS MATERIALIZED (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.rid = b.rid AND o.q < b.q AND o.s <= b.s AND o.s + o.size >= b.s + b.size)),
dropped AS (SELECT DISTINCT rid, unnest(range(s + q, s + size)) AS i FROM r),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS t FROM w ANTI JOIN dropped USING (rid, i) GROUP BY rid),
f AS (SELECT rid, count(*) AS n_runs, string_agg(s || ',' || size || ',' || q || chr(10), '' ORDER BY s, q) AS t,
  min(struct_pack(less := -size, s := s, q := q)) AS top FROM r GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, -top.less AS length, top.q AS period, (-1000 * top.less) // top.q AS exponent_milli,
  sha256(coalesce(f.t, '')) AS runs_sha256, sha256(CASE WHEN f.rid IS NULL AND NOT planted THEN array_to_string(words, ' ')
    ELSE coalesce(kept.t, '') END) AS collapsed_sha256
FROM e LEFT JOIN f USING (rid) LEFT JOIN kept USING (rid)"""

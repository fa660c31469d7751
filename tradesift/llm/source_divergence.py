"""How far the sources of a language differ in their words, by Gustavson's row accumulation.

For every language the kept terms (in enough of its documents) and its sources are a sparse matrix of counts. A source
gives each kept term a share, smoothed so that a term it never uses has a share too, and two sources differ by the sum
over all kept terms of (p - q)^2 / (p + q). That sum is built like a row of a sparse product: a source takes its terms one
by one, looks each up in the term-major index (term -> sources and counts) and adds to a dense accumulator with one cell
for each peer. No pair of postings is ever a row. Terms absent on one side or both are baselines: they are added for whole
classes of equal shares at once, and corrected where the index shows that both sides use the term.

The index is cut by a hash of the term into blocks of bounded size, the number of blocks grows with it, and a task reads
one block with the list of the language's sources. Partial sums of the blocks are added by Spark. A source with most of
the rows is counted where it is read (counts of a part of the rows leave a task), so it has no task of its own.

All numbers are exact: shares by long division on 64-bit integers, their sums as integers.

Defined results: null text, lang and source are read as ''; a group is one (lang, source), also without any term; a
language without kept terms gives 0 for each pair; repeated rows count as documents of their own; a language with one
source has no pairs; an empty table gives no rows; columns other than the named ones are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradesift.llm.common import read_table, saved, text_bytes

MIN_DOCS = 10
SCALE_DIGITS = 9
TOP_TERMS = 10
#: Postings of one block of the term-major index.
BLOCK_POSTINGS = 1_000_000
#: Entries that a task counts before it passes them on.
ENTRIES = 250_000
#: Cells that are worked on at once in a block.
CELLS = 500_000

#: A-Z lower-cased, other letters and all bytes of other characters kept, the rest turned into blanks.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _counted(counts: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
    langs, sources, terms, n, docs = [], [], [], [], []
    for (one_lang, one_source), (uses, in_docs) in counts.items():
        langs += [one_lang] * (len(uses) + 1)
        sources += [one_source] * (len(uses) + 1)
        terms += [None, *uses]
        n += [0, *uses.values()]
        docs += [0, *map(in_docs.__getitem__, uses)]
    columns = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(terms, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Uses and documents of each term of each group in a part of the rows; a row without a term names the group."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    entries = 0
    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for lang, source, text in zip(langs, sources, text_bytes(batch, "text"), strict=True):
            uses, in_docs = counts.setdefault((lang, source), (Counter(), Counter()))
            words = text.translate(_TERM_BYTES).split()
            before = len(uses)
            uses.update(words)
            in_docs.update(set(words))
            entries += len(uses) - before
            if entries >= ENTRIES:
                yield _counted(counts)
                counts, entries = {}, 0
    if counts:
        yield _counted(counts)


def term_index(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """The term-major index (lang, term, total, postings of source and n); a null term lists the sources of a language."""
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = named.mapInArrow(_tally, "lang string, source string, term string, n long, docs long")
    by_group = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = by_group.groupBy("lang", "term").agg(
        F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("postings")
    )
    return saved(by_term.where(F.col("term").isNull() | (F.col("docs") >= min_docs)).select("lang", "term", "total", "postings"))


def shares(counts: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / whole), digit by digit: exact while ten times ``whole`` fits in 64 bits."""
    rest = counts.astype(np.int64) + 2
    quotient = rest // whole
    rest = rest % whole
    for _ in range(SCALE_DIGITS):
        rest = rest * 10
        quotient = quotient * 10 + rest // whole
        rest = rest % whole
    return quotient + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


class _Block:
    """One block of the term-major index of one language, in arrays."""

    def __init__(self, index: pa.Table, groups: pa.Table):
        groups = groups.sort_by("source")
        self.sources = groups.column("source").to_pylist()
        self.terms = index.column("term").to_pylist()
        postings = index.column("postings").combine_chunks()
        offsets = np.asarray(postings.offsets, np.int64)
        self.ends = offsets - offsets[0]
        listed = postings.flatten()
        self.source = pc.index_in(listed.field("source"), groups.column("source").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
        whole = groups.column("whole").to_numpy()
        self.share = shares(listed.field("n").to_numpy(), whole[self.source])
        self.absent = shares(np.zeros(len(whole), np.int64), whole)
        lang_whole = groups.column("lang_whole").to_numpy()[0]
        self.lang_share = shares(index.column("total").to_numpy(), lang_whole)
        self.term = np.repeat(np.arange(len(self.terms)), np.diff(self.ends))
        order = np.argsort(self.source, kind="stable")
        borders = np.searchsorted(self.source[order], np.arange(len(self.sources) + 1))
        self.rows = [order[a:b] for a, b in zip(borders[:-1], borders[1:], strict=True)]
        self.used = np.diff(borders)
        #: classes of equal share: (source, share, terms) of the whole block
        classes, sizes = np.unique(np.stack([self.source, self.share], 1), axis=0, return_counts=True)
        self.class_source, self.class_share, self.class_size = classes[:, 0], classes[:, 1], sizes

    def row(self, g: int) -> np.ndarray:
        """Divergence of source ``g`` from each peer, over the terms of this block."""
        entries = self.rows[g]
        mine, absent = self.share[entries], self.absent[g]
        cells = (len(self.terms) - self.used[g] - self.used) * _apart(absent, self.absent)
        levels, sizes = np.unique(mine, return_counts=True)
        step = max(1, CELLS // len(cells))
        for k in range(0, len(levels), step):
            cells += (sizes[k : k + step, None] * _apart(levels[k : k + step, None], self.absent[None, :])).sum(0)
        np.add.at(cells, self.class_source, self.class_size * _apart(absent, self.class_share))
        first, reach = self.ends[self.term[entries]], np.diff(self.ends)[self.term[entries]]
        cuts = np.searchsorted(np.cumsum(reach), np.arange(CELLS, int(reach.sum()) + CELLS, CELLS), "right") if len(reach) else []
        a = 0
        for b in np.unique(np.r_[cuts, len(entries)].astype(np.int64)):
            if b > a:
                self._scatter(cells, mine[a:b], absent, first[a:b], reach[a:b])
                a = b
        return cells

    def _scatter(self, cells: np.ndarray, mine: np.ndarray, absent: np.int64, first: np.ndarray, reach: np.ndarray) -> None:
        """Adds each of these terms to the cells of all sources that its postings name."""
        at = np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach) + np.repeat(first, reach)
        p, q, peer = np.repeat(mine, reach), self.share[at], self.source[at]
        zero = self.absent[peer]
        np.add.at(cells, peer, _apart(p, q) - _apart(p, zero) - _apart(absent, q) + _apart(absent, zero))

    def top_terms(self, g: int, limit: int) -> list[tuple[str, int]]:
        """The terms that ``g`` uses more than its language does, furthest first, ties by their bytes."""
        terms, p = self.term[self.rows[g]], self.share[self.rows[g]]
        q = self.lang_share[terms]
        terms, value = terms[p > q], _apart(p, q)[p > q]
        if len(value) > limit:
            least = np.partition(value, len(value) - limit)[len(value) - limit]
            terms, value = terms[value >= least], value[value >= least]
        ranked = sorted(zip((-value).tolist(), (self.terms[t] for t in terms), strict=True), key=lambda x: (x[0], x[1].encode()))
        return [(term, -less) for less, term in ranked[:limit]]


_OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): each other source of the language, and the terms a source overuses most."""
    index = term_index(docs, min_docs)
    terms = index.where("term is not null")
    uses = terms.select("lang", F.explode("postings").alias("u")).groupBy("lang", "u.source").agg(F.sum("u.n").alias("n"))
    sizes = terms.groupBy("lang").agg(
        F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"), F.sum(F.size("postings")).alias("postings")
    )
    names = index.where("term is null").select("lang", F.explode("postings.source").alias("source"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n_blocks = F.greatest(F.ceil(zero("postings") / BLOCK_POSTINGS), F.lit(1)).cast("int")
    # without kept terms no share is asked for, but the divisor must not be 0
    whole = lambda n: F.greatest(zero(n) + 2 * zero("v"), F.lit(1))
    groups = saved(
        names.join(sizes, "lang", "left").join(uses, ["lang", "source"], "left")
        .select("lang", "source", whole("n").alias("whole"), whole("lang_n").alias("lang_whole"), n_blocks.alias("n_blocks"))
    )
    blocks = groups.select("lang", "n_blocks").distinct()
    left = terms.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("term"), "n_blocks").cast("int"))
    right = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))

    def accumulate(index_part: pa.Table, group_part: pa.Table) -> pa.Table:
        if not group_part.num_rows:
            return _OUT.empty_table()
        block = _Block(index_part, group_part)
        lang = group_part.column("lang")[0].as_py()
        parts = []
        for g, source in enumerate(block.sources):
            cells = block.row(g).tolist()
            rows = [("pair", peer, cells[h]) for h, peer in enumerate(block.sources) if h != g]
            rows += [("term", term, value) for term, value in block.top_terms(g, top_terms)]
            part, item, value = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [pa.array([lang] * len(rows), pa.string()), pa.array([source] * len(rows), pa.string())]
            columns += [pa.array(part, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())]
            parts.append(pa.Table.from_arrays(columns, schema=_OUT))
        return pa.concat_tables(parts)

    keys = ["lang", "block"]
    left = left.select("lang", "block", "term", "total", "postings")
    right = right.select("lang", "block", "source", "whole", "lang_whole")
    partial = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(accumulate, "lang string, source string, part string, item string, value long")
    summed = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = summed.withColumn("rank", F.row_number().over(order))
    return ranked.where(f"part = 'pair' or rank <= {int(top_terms)}")


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence(read_table(spark, folder, "documents"))


OP12_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCS}),
l AS (SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
u AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
un AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM u GROUP BY lang, source),
s AS (SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 2)) // (coalesce(un.n, 0) + 2 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 2)) // (l.n + 2 * l.v) AS lp
  FROM g JOIN k ON g.lang = k.lang JOIN l ON l.lang = g.lang LEFT JOIN un ON un.lang = g.lang AND un.source = g.source
  LEFT JOIN u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS other, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
  ON x.lang = a.lang AND x.source = a.source AND x.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - lp) * (p - lp) // (p + lp) AS value FROM s WHERE n > 0 AND p > lp),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}"""

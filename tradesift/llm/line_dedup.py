"""Line dedup by a segment-partition edit join, in DataFrame functions only.

A line of at least ``min_chars`` characters goes when the same line, or a line within ``edits`` edits of it, occurs
earlier; what counts is a line's first occurrence by document id and line number. Shorter lines always stay.

Equal lines are one by two 64-bit hashes. A distinct line is cut into ``edits + 1`` even segments, of which one must
survive ``edits`` edits; the index holds each segment by its text, its number and the line's length, and a line probes the
lengths down to ``edits`` less at the few places where a segment can have moved. What meets is verified by
edit distance in a band of ``2 * edits + 1`` diagonals, kept as bits of one integer. A key that more than one line has
gives no pairs: each line that meets it is one row, the key's lines are compared in arrays of bounded size, and only
an existence leaves them: the first earlier line that is near, and later lines that only this row can find. One
near line is enough to verify for each line that goes.

Defined results: a null text stays null and has no lines; blank lines are lines; rows with equal ids are one document;
lines of a
row with a null id come first and stay, and take no part in the search for near lines; texts that lose nothing keep every
byte; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradesift.llm.common import read_table, saved

EDITS = 2
MIN_CHARS = 20
#: Lines of one array of a key that more than one line has.
ARRAY = 32


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def plain(line: Column) -> Column:
    """The line with one byte for each character: what lies within some edits does so still, and cuts are cheap."""
    return F.encode(F.regexp_replace(line, r"[^\x00-\x7F]", "?"), "utf-8")


def _segment(length: Column, number: int, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and size of a segment of a line of some length."""
    start = F.floor(length * number / (edits + 1)).cast("int")
    return start, F.floor(length * (number + 1) / (edits + 1)).cast("int") - start


def index_keys(line: Column, length: Column, edits: int) -> Column:
    """Keys of all segments of a plain line."""
    keys = []
    for number in range(edits + 1):
        start, size = _segment(length, number, edits)
        keys.append(F.xxhash64(F.lit(number), length, F.substring(line, start + 1, size)))
    return F.array(*keys)


def probe_places(edits: int) -> list[tuple[int, int, int]]:
    """(how much shorter the indexed line is, segment, move of the segment) that a line has to probe: as many edits as
    there are segments to the left can lie there, and the rest to the right. The line's own segments come first."""
    places = [
        (less, number, move)
        for less in range(edits + 1)
        for number in range(edits + 1)
        for move in range(max(-number, less - (edits - number)), min(number, less + (edits - number)) + 1)
    ]
    return sorted(places, key=lambda p: (p[0] or abs(p[2]), p))


def probe_keys(line: Column, length: Column, edits: int) -> Column:
    keys = []
    for less, number, move in probe_places(edits):
        shorter = length - less
        start, size = _segment(shorter, number, edits)
        inside = (start + move >= 0) & (start + move + size <= length) & (shorter > 0)
        keys.append(F.when(inside, F.xxhash64(F.lit(number), shorter, F.substring(line, start + (move + 1), size))))
    return F.array(*keys)


def edit_distance_within(first: Column, second: Column, edits: int) -> Column:
    """Whether two strings are within ``edits`` edits, by bit-parallel rows of a diagonal band.

    Bit b of a row holds the cell that lies b - edits below the diagonal. The lowest diagonal of the band is followed
    down to the last character of ``first``, then that line along the rest of ``second``.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    top = 1 << (width - 1)
    bits = lambda v: v.cast("long")
    inverse = lambda v: v.bitwiseXOR(F.lit(full))
    m = F.length(first)

    # the arrays travel in the state, so they are made once for each pair and not for each step
    letters_of = lambda text: F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    start = F.struct(
        F.lit(full & ~((1 << edits) - 1)).cast("long").alias("vp"),
        F.lit(0).cast("long").alias("vn"),
        F.lit(edits).cast("long").alias("cost"),
        F.lit(0).cast("int").alias("place"),
        F.lit(0).cast("long").alias("same"),
        F.lit(0).cast("long").alias("d0"),
        letters_of(first).alias("x"),
    )

    def match(s: Column, letter: Column) -> Column:
        same = F.lit(0).cast("long")
        for b in range(width):
            same = same + F.when(F.get(s.x, s.place + (b - edits)) == letter, F.lit(1 << b).cast("long")).otherwise(F.lit(0).cast("long"))
        return F.struct(s.vp.alias("vp"), s.vn.alias("vn"), s.cost.alias("cost"), s.place.alias("place"), same.alias("same"), s.d0.alias("d0"), s.x.alias("x"))

    def diagonal(s: Column) -> Column:
        d0 = ((s.same.bitwiseAND(s.vp) + s.vp).bitwiseAND(F.lit((full << 1) | 1)).bitwiseXOR(s.vp)).bitwiseOR(s.same).bitwiseOR(s.vn).bitwiseAND(F.lit(full))
        return F.struct(s.vp.alias("vp"), s.vn.alias("vn"), s.cost.alias("cost"), s.place.alias("place"), s.same.alias("same"), d0.alias("d0"), s.x.alias("x"))

    def advance(s: Column) -> Column:
        hp = s.vn.bitwiseOR(inverse(s.d0.bitwiseOR(s.vp)))
        hn = s.d0.bitwiseAND(s.vp)
        # past the last row of the first string the followed cell moves one bit down with every character
        past = s.place - (m - edits)
        here = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.lit(width - 2) - past))
        down = F.when(s.d0.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
        along = F.when(hp.bitwiseAND(here) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(here) != 0, 1).otherwise(0)
        shifted = F.shiftright(s.d0, 1)
        return F.struct(
            bits(hn.bitwiseOR(inverse(shifted.bitwiseOR(hp)))).alias("vp"),
            bits(shifted.bitwiseAND(hp)).alias("vn"),
            (s.cost + F.when(past < 0, down).otherwise(along)).cast("long").alias("cost"),
            (s.place + 1).alias("place"),
            s.same.alias("same"),
            s.d0.alias("d0"),
            s.x.alias("x"),
        )

    cost = F.aggregate(letters_of(second), start, lambda s, letter: _advanced(s, letter, match, diagonal, advance), lambda s: s.cost)
    near = F.abs(F.length(first) - F.length(second)) <= edits
    short = F.least(F.length(first), F.length(second)) <= edits
    return near & F.when(short, F.levenshtein(first, second) <= edits).otherwise(cost <= edits)


def _advanced(s: Column, letter: Column, *steps) -> Column:
    """The steps one after the other, each on the finished struct of the one before."""
    match, diagonal, advance = steps
    through = lambda value, step: F.element_at(F.transform(F.array(value), step), 1)
    return through(through(match(s, letter), diagonal), advance)


def candidate_lines(docs: DataFrame, firsts: DataFrame, edits: int) -> DataFrame:
    """Lines that share a segment, with their texts: rows of two different lines a and b, and for each key that several
    lines have rows of one line (b is a), where ``own`` marks the key's indexed lines. firsts: doc_id, line_no."""
    places = firsts.groupBy("doc_id").agg(F.collect_set("line_no").alias("places"))
    # documents move by their id once; every join with them uses that exchange again
    distinct_lines = (
        docs.join(places.hint("merge"), "doc_id")
        # the outer form adds no filter on the texts, which would make this exchange another one
        .select("doc_id", "places", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line"))
        .where(F.array_contains("places", F.col("line_no")))
        .select("doc_id", "line_no", plain(F.col("line")).alias("line"))
        .select("doc_id", "line_no", "line", F.length("line").alias("length"))
    )
    keys = lambda made, *more: distinct_lines.select(
        "doc_id", "line_no", F.posexplode(made(F.col("line"), F.col("length"), edits)).alias("place", "key")
    ).select("key", "doc_id", "line_no", *more)
    of_key = Window.partitionBy("key")
    index = (
        keys(index_keys)
        .select("key", F.col("doc_id").alias("y_id"), F.col("line_no").alias("y_no"), F.count(F.lit(1)).over(of_key).alias("n"))
        .withColumn("hot", F.col("n") > 1)
        # a hot key has one row here: its lines are found among the probes, where each line has its own segments
        .withColumn("first_of_key", F.row_number().over(of_key.orderBy("y_id", "y_no")))
        .where(~F.col("hot") | (F.col("first_of_key") == 1))
        .select("key", "y_id", "y_no", "hot")
    )
    probe = keys(probe_keys, (F.col("place") <= edits).alias("own")).where("key is not null")
    met = probe.join(index.hint("merge"), "key").where("hot or doc_id <> y_id or line_no <> y_no")
    met = met.withColumns({"x": F.struct("doc_id", "line_no"), "y": F.struct(F.col("y_id").alias("doc_id"), F.col("y_no").alias("line_no"))})
    rows = met.select(
        F.when(F.col("hot"), F.col("key")).alias("key"),
        (F.col("hot") & F.col("own")).alias("own"),
        F.when(F.col("hot"), F.col("x")).otherwise(F.least("x", "y")).alias("a"),
        F.when(F.col("hot"), F.col("x")).otherwise(F.greatest("x", "y")).alias("b"),
    ).distinct()
    for end in "ab":
        # the documents keep their column names, or their exchange would be another one
        rows = (
            rows.withColumn("doc_id", F.col(f"{end}.doc_id"))
            .hint("merge")
            .join(docs.select("doc_id", "text"), "doc_id")
            .withColumn(f"{end}_line", F.get(F.split("text", "\n"), F.col(f"{end}.line_no")))
            .drop("doc_id", "text")
        )
    return rows


def near_earlier_lines(docs: DataFrame, firsts: DataFrame, edits: int) -> DataFrame:
    """(doc_id, line_no) of the distinct lines that have an earlier line within ``edits`` edits. firsts: doc_id, line_no."""
    rows = saved(candidate_lines(docs, firsts, edits))
    cold = rows.where(F.col("key").isNull()).where(F.levenshtein("a_line", "b_line", edits) >= 0)
    hot = rows.where(F.col("key").isNotNull())
    sizes = hot.where("own").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / ARRAY).alias("blocks"))
    arrays = (
        hot.where("own")
        .join(sizes, "key")
        .groupBy("key", F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"))
        .agg(F.collect_list(F.struct("a", "a_line")).alias("lines"))
    )
    # the built-in banded distance is quick to refuse; what it lets through is verified by the band of bits
    is_near = lambda line: F.levenshtein(line.a_line, F.col("b_line"), edits) >= 0
    earlier = F.slice(F.filter("lines", lambda line: (line.a < F.col("b")) & is_near(line)), 1, 1)
    # a longer line is not indexed under this key of a shorter one, so a later shorter line can be found from here alone
    shorter = lambda line: F.length(line.a_line) < F.length("b_line")
    later = F.filter("lines", lambda line: (line.a > F.col("b")) & shorter(line) & is_near(line))
    # a line meets each array of its key in another place, so a hot key is spread
    hot_pairs = (
        hot.select("key", "b", "b_line")
        .distinct()
        .join(sizes, "key")
        .select("key", "b", "b_line", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
        .join(arrays, ["key", "block"])
        .select("b", "b_line", F.explode(F.concat(earlier, later)).alias("y"))
        .select(F.col("y.a").alias("a"), "b", F.col("y.a_line").alias("a_line"), "b_line")
    )
    both = cold.select("a", "b", "a_line", "b_line").unionByName(hot_pairs)
    one_each = both.groupBy(F.greatest("a", "b").alias("at")).agg(F.min(F.struct("a_line", "b_line")).alias("pair"))
    verified = one_each.where(edit_distance_within(F.col("pair.a_line"), F.col("pair.b_line"), edits))
    return verified.select("at.doc_id", "at.line_no")


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, places, n_near): numbers of the lines to remove, and how many of them only resemble an earlier one. docs: doc_id, text."""
    lines = _lines(docs).where(F.length("line") >= min_chars)
    hashed = lines.select(
        "doc_id", "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(17), "line").alias("h2")
    )
    firsts = saved(hashed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first")))
    copies = (
        hashed.join(firsts, ["h1", "h2"])
        .where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))))
        .select("doc_id", "line_no", F.lit(0).alias("near"))
    )
    near = near_earlier_lines(docs, firsts.select("first.doc_id", "first.line_no"), edits).withColumn("near", F.lit(1))
    return copies.unionByName(near).groupBy("doc_id").agg(
        F.collect_set("line_no").alias("places"), F.sum("near").cast("long").alias("n_near")
    )


def _without(places: str) -> Column:
    kept = F.filter(F.split("text", "\n"), lambda line, number: ~F.array_contains(places, number))
    return F.when(F.col(places).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def line_report(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, n_near, removed): every document with the numbers (from 0) of the lines that go."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    removed = repeated_lines(narrow, edits, min_chars)
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    return narrow.select("doc_id", F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines")).join(removed, "doc_id", "left").select(
        "doc_id",
        "n_lines",
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.coalesce(F.sort_array("places"), F.array().cast("array<int>")).alias("removed"),
    )


def without_repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns and what is left of their texts; those go that lost lines and have nothing left but blanks."""
    names = docs.columns
    inner = {id_col: "doc_id", text_col: "text"}
    # other columns get names of their own, so none can clash
    renamed = docs.select(*[F.col(f"`{c}`").alias(inner.get(c, f"_own_{k}")) for k, c in enumerate(names)])
    removed = repeated_lines(renamed.select("doc_id", "text"), edits, min_chars)
    rest = renamed.join(removed, "doc_id", "left").withColumn("text", _without("places"))
    rest = rest.where(F.col("places").isNull() | (F.trim(F.translate("text", "\n\r\t", "   ")) != ""))
    return rest.select(*[F.col(inner.get(c, f"_own_{k}")).alias(c) for k, c in enumerate(names)])


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = line_report(read_table(spark, folder, "documents"))
    return rows.withColumn("removed", F.array_join("removed", ","))


OP7_SQL = """
WITH line AS (
  SELECT doc_id, i - 1 AS line_no, l[i] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i)),
long_line AS (SELECT * FROM line WHERE length(line) >= 20),
first AS (SELECT line, min((doc_id, line_no)) AS f FROM long_line GROUP BY 1),
near AS (
  SELECT DISTINCT a.f FROM (SELECT *, length(line) + unnest([-2, -1, 0, 1, 2]) AS n FROM first) a JOIN first b
  ON b.f < a.f AND length(b.line) = a.n
     AND (a.line[1 : length(a.line) // 3 - 2] = b.line[1 : length(a.line) // 3 - 2]
          OR a.line[-(length(a.line) // 3 - 2) :] = b.line[-(length(a.line) // 3 - 2) :]
          OR contains(b.line, a.line[length(a.line) // 3 + 3 : 2 * length(a.line) // 3 - 2]))
     AND levenshtein(a.line, b.line) <= 2),
gone AS (
  SELECT doc_id, line_no, 0 AS near FROM long_line JOIN first USING (line) WHERE (doc_id, line_no) <> f
  UNION ALL SELECT f[1], f[2], 1 FROM near),
counts AS (SELECT doc_id, count(*) AS n_removed, sum(near) AS n_near, string_agg(line_no, ',' ORDER BY line_no) AS removed FROM gone GROUP BY 1)
SELECT d.doc_id, cast(coalesce(len(string_split(d.text, chr(10))), 0) AS bigint) AS n_lines,
       cast(coalesce(n_removed, 0) AS bigint) AS n_removed, cast(coalesce(n_near, 0) AS bigint) AS n_near, coalesce(removed, '') AS removed
FROM documents d LEFT JOIN counts ON counts.doc_id = d.doc_id
"""

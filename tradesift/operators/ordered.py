"""Order-dependent helpers that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tradesift.session import kept

#: A task sorts the rows of a key up to this number; a larger key is cut into ranges.
LARGE_KEY = 1_000_000
_BUCKETS = 1 << 16


def filter_computed(rows: DataFrame, condition: Column) -> DataFrame:
    """Filter on a value that is expensive to compute.

    Spark would push the condition below every projection and compute the value there once more
    for each time it is read; a column that must not be moved keeps the filter where it is.
    """
    marked = rows.withColumn("_kept", F.monotonically_increasing_id())
    return marked.filter(condition & (F.col("_kept") >= 0)).drop("_kept")


def exploded(rows: DataFrame, items: Column, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per item. The outer form adds no filter on the array, which would compute it twice."""
    all_items = rows.select(*keep, F.explode_outer(items).alias(name))
    return all_items.filter(F.col(name).isNotNull())


def has_large_key(rows: DataFrame, keys: list[str]) -> bool:
    """Whether a key may have more than ``LARGE_KEY`` rows. Counted by hashes of keys, so next to nothing is shuffled."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(_BUCKETS)).alias("_bucket")
    most = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return (most or 0) > LARGE_KEY


def in_ranges(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with ``_range``: contiguous ranges of (keys, order) of about the same number of rows.

    A key with many rows has many ranges, so no task sorts or holds all of its rows. Both steps are kept
    in the shared folder: the rows are computed once, and all that reads the ranges reads the same ones.
    """
    return _cut_in_ranges(kept(rows), keys, order)


def _cut_in_ranges(stored: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    ranged = stored.repartitionByRange(*keys, *order)
    return kept(ranged.withColumn("_range", F.spark_partition_id()))


def with_previous(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Adds ``{new: column of the row before}`` within each key.

    The rows are kept once. Where no key is large, one window over them is all; else a window sorts one range of a key
    at a time, and the first row of a range takes its values from a small table with the last row of every range.
    """
    carried = F.struct(*[F.col(source).alias(new) for new, source in values.items()])
    names = [name for name in rows.columns if not name.startswith("_") or name.startswith("_nfkc_")]
    stored = kept(rows.select(*dict.fromkeys([*names, *keys, *order, *values.values()])))
    if not has_large_key(stored, keys):
        whole = Window.partitionBy(*keys).orderBy(*order)
        return stored.select(*names, *[F.lag(source).over(whole).alias(new) for new, source in values.items()])
    ranged = _cut_in_ranges(stored.withColumn("_carried", carried), keys, order)
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    last = ranged.groupBy(*keys, "_range").agg(F.max_by("_carried", F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_range")
    previous = last.select(
        *[F.col(key).alias(f"_p_{key}") for key in keys],
        F.col("_range").alias("_p_range"),
        F.lag("_last").over(across).alias("_range_before"),
    )
    numbered = ranged.withColumns(
        {"_before": F.lag("_carried").over(within), "_number": F.row_number().over(within)}
    )
    matches = [numbered[key].eqNullSafe(previous[f"_p_{key}"]) for key in keys]
    joined = numbered.join(previous, [*matches, numbered["_range"] == previous["_p_range"]], "left")
    before = F.when(F.col("_number") == 1, F.col("_range_before")).otherwise(F.col("_before"))
    return joined.withColumn("_before", before).select(
        *names, *[F.col(f"_before.{new}").alias(new) for new in values]
    )


def with_last_marked(
    rows: DataFrame, keys: list[str], order: list[str], previous: dict[str, str], marked: Column, carried: dict[str, str], stored: bool = False
) -> DataFrame:
    """Adds ``previous`` ({new: column of the row before}) and ``carried`` ({new: column of the last marked row before}).

    ``marked`` may read the new columns of ``previous``. The rows are kept once, unless ``stored`` says that they are read
    from kept ones. Where no key is large, both are windows over one sort of them. Else both steps read the same ranges:
    windows sort one range of a key, and two small tables carry values over the borders of ranges.
    """
    pack = lambda values: F.struct(*[F.col(source).alias(new) for new, source in values.items()])
    rows = rows if stored else kept(rows)
    last = lambda column: F.last(column, ignorenulls=True)
    if not has_large_key(rows, keys):
        whole = Window.partitionBy(*keys).orderBy(*order)
        seen = rows.select(*rows.columns, *[F.lag(source).over(whole).alias(new) for new, source in previous.items()])
        seen = seen.withColumn("_mark", F.when(marked, pack(carried)))
        before = last(F.col("_mark")).over(whole.rowsBetween(Window.unboundedPreceding, -1))
        seen = seen.withColumn("_mark", before)
        return seen.select(*rows.columns, *previous, *[F.col(f"_mark.{new}").alias(new) for new in carried])
    place = [*keys, "_range"]
    within, across = Window.partitionBy(*place).orderBy(*order), Window.partitionBy(*keys).orderBy("_range")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)

    def over_borders(ranged: DataFrame, per_range: Column, before: Callable[[Column], Column]) -> DataFrame:
        """Rows with ``_border``: what the ranges of the key before this one leave to it."""
        ends = ranged.groupBy(*place).agg(per_range.alias("_end"))
        ends = ends.select(*[F.col(name).alias(f"_p{name}") for name in place], before(F.col("_end")).alias("_border"))
        same = [ranged[name].eqNullSafe(ends[f"_p{name}"]) for name in place]
        return ranged.join(ends, same, "left").drop(*[f"_p{name}" for name in place])

    ranged = _cut_in_ranges(rows.withColumn("_row", pack(previous)), keys, order)
    ranged = over_borders(ranged, F.max_by("_row", F.struct(*order)), lambda end: F.lag(end).over(across))
    first = F.row_number().over(within) == 1
    seen = ranged.withColumn("_row", F.when(first, F.col("_border")).otherwise(F.lag("_row").over(within)))
    seen = seen.select(*[c for c in seen.columns if c not in ("_row", "_border")], *[F.col(f"_row.{new}").alias(new) for new in previous])
    seen = seen.withColumn("_mark", F.when(marked, pack(carried)))
    seen = over_borders(seen, F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.struct(*order))), lambda end: last(end).over(earlier))
    before = F.coalesce(last(F.col("_mark")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.col("_border"))
    seen = seen.withColumn("_mark", before)
    return seen.select(*rows.columns, *previous, *[F.col(f"_mark.{new}").alias(new) for new in carried])


def with_number(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds a number from 1 per key.

    The rows are kept once. Where no key is large, one window over them is all; else each range of a key counts on its own, from
    the total of the ones before.
    """
    stored = kept(rows)
    if not has_large_key(stored, keys):
        whole = Window.partitionBy(*keys).orderBy(*order)
        return stored.select(*rows.columns, F.row_number().over(whole).cast("long").alias(name))
    ranged = _cut_in_ranges(stored, keys, order)
    within = Window.partitionBy(*keys, "_range").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    starts = counts.select(
        *[F.col(key).alias(f"_p_{key}") for key in keys],
        F.col("_range").alias("_p_range"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    numbered = ranged.withColumn("_n", F.row_number().over(within))
    matches = [numbered[key].eqNullSafe(starts[f"_p_{key}"]) for key in keys]
    joined = numbered.join(starts, [*matches, numbered["_range"] == starts["_p_range"]])
    return joined.select(*rows.columns, (F.col("_start") + F.col("_n")).alias(name))


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key, reduced before the shuffle."""
    row = F.struct(*[F.col(name) for name in rows.columns])
    newest = rows.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return newest.select("_row.*")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    row = F.struct(*[F.col(name) for name in rows.columns])
    oldest = rows.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return oldest.select("_row.*")


def newest_of_key(rows: DataFrame, keys: list[str], newest: list[Column], limit: int) -> DataFrame:
    """The newest ``limit`` rows per key; Spark cuts every partition to the limit before it shuffles."""
    ranked = Window.partitionBy(*keys).orderBy(*newest)
    return rows.withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= limit).drop("_rank")


def ordered_fold(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    make_state: Callable[[], Callable[[dict], list[dict]]],
    schema: str,
) -> DataFrame:
    """Replays the rows of each key in order; ``make_state()`` gives the step function of a key.

    Rows stream through in Arrow batches, so only the state of the current key is in memory,
    however many rows it has.
    """
    output = _parse_datatype_string(schema)
    assert isinstance(output, StructType)
    arrow_schema = to_arrow_schema(output)
    names = output.fieldNames()

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = None, None
        for batch in batches:
            produced: list[dict] = []
            for row in batch.to_pylist():
                key = tuple(row[name] for name in keys)
                if step is None or key != current:
                    current, step = key, make_state()
                produced.extend(step(row))
            columns = [
                pa.array([row.get(name) for row in produced], type=arrow_schema.field(name).type)
                for name in names
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow_schema)

    # the sort keeps a key's rows together and in order; nothing is collected per group
    sorted_rows = rows.repartition(*[F.col(key) for key in keys]).sortWithinPartitions(*keys, *order)
    return sorted_rows.mapInArrow(replay, output)

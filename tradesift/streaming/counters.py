"""Running counters of all statistics, kept as changes.

What the current evaluation of a lead adds to each counter is a list of amounts. The state of a lead is its newest evaluation's
list and place in order; a newer evaluation takes the old list back and adds its own, an older one changes nothing. Leads are
kept in buckets by hash, one state each, because a call for every lead costs far more than its work. Each batch
appends the sums of its changes, a repeated batch replaces its own file, and no earlier row is ever read or written again;
the counters are the sums of all changes.
"""

from __future__ import annotations

import json
import pickle
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tradesift.streaming.jobs import run_available, write_batch

CHANGES = "counter string, name string, amount double"
#: States that all leads share. A batch writes the states anew that its leads are in, so their number should grow with the leads;
#: it can't be changed for a stream that has a checkpoint.
BUCKETS = 4096
_FIRST = -(1 << 63)  # an evaluation without a time is older than all others


def _each(counter: str, names: Column) -> Column:
    one = lambda name: F.struct(F.lit(counter).alias("counter"), name.alias("name"), F.lit(1.0).alias("amount"))
    return F.coalesce(F.transform(names, one), F.array().cast("array<struct<counter:string,name:string,amount:double>>"))


def _mean(counter: str, value: str) -> Column:
    """Sum and number of a value that may be missing."""
    amount = lambda name, of: F.struct(F.lit(counter).alias("counter"), F.lit(name).alias("name"), of.cast("double").alias("amount"))
    known = F.array(amount("sum", F.col(value)), amount("n", F.lit(1)))
    return F.when(F.col(value).isNotNull(), known).otherwise(F.array().cast("array<struct<counter:string,name:string,amount:double>>"))


def contributions(evaluations: DataFrame) -> Column:
    """What an evaluation adds to the counters, from those of the columns that the table has."""
    has = set(evaluations.columns)
    passed = F.col("passed")
    parts = []
    if "passed" in has:
        parts.append(_each("verdict", F.array(F.when(passed, "matched").otherwise("rejected"))))
    if "reasons" in has:
        passes = F.transform(F.filter("reasons", lambda reason: reason.outcome == "pass"), lambda reason: reason.type)
        parts.append(_each("pass_reason", F.when(passed, passes)))
    if "failed_groups" in has:
        parts.append(_each("failed_group", F.when(~passed, F.col("failed_groups"))))
    if "priority" in has:
        parts.append(_each("priority", F.array_compact(F.array("priority"))))
    for column, counter in (("failed_fields", "failed_field"), ("normalization_warnings", "warning")):
        if column in has:
            parts.append(_each(counter, F.col(column)))
    parts += [_mean(column, column) for column in ("score", "confidence", "completeness") if column in has]
    return F.concat(*parts)


def changes(evaluations: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A stream of (counter, name, amount) from a stream of (lead_id, detected_at, row_id, amounts as JSON text)."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest = pickle.loads(zlib.decompress(state.get[0])) if state.exists else {}
        texts = {amounts: amounts for _, _, amounts in newest.values()}  # equal texts are stored once
        seen, detected, times = 0, 0, Counter()
        for batch in batches:
            seen += len(batch)
            for lead, at, row, amounts in zip(batch["lead_id"], batch["at_us"], batch["row_id"], batch["amounts"], strict=True):
                old = newest.get(lead)
                if old is None:
                    detected += 1
                elif (at, row) <= old[:2]:
                    continue
                else:
                    times[old[2]] -= 1
                amounts = texts.setdefault(amounts, amounts)
                times[amounts] += 1
                newest[lead] = (at, row, amounts)
        sums = defaultdict(float, {("scan", "processed"): float(seen), ("scan", "detected"): float(detected)})
        for amounts, n in times.items():
            for a in json.loads(amounts) if n else ():
                sums[a["counter"], a["name"]] += n * a["amount"]
        if times:
            state.update((zlib.compress(pickle.dumps(newest), 1),))
        yield pd.DataFrame([(*name, amount) for name, amount in sums.items()], columns=["counter", "name", "amount"])

    at = F.unix_micros(F.col("detected_at").cast("timestamp"))
    narrow = evaluations.select(
        F.pmod(F.xxhash64("lead_id"), F.lit(buckets)).alias("bucket"), "lead_id", F.coalesce(at, F.lit(_FIRST)).alias("at_us"),
        F.coalesce("row_id", F.lit("")).alias("row_id"), "amounts",
    )
    grouped = narrow.groupBy("bucket")
    return grouped.applyInPandasWithState(step, CHANGES, "newest binary", "append", GroupStateTimeout.NoTimeout)


def running_totals(evaluations: DataFrame, folder: str, name: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Appends the summed changes of every batch below ``folder``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        summed = batch.groupBy("counter", "name").agg(F.sum("amount").alias("amount"))
        write_batch(summed.where("amount <> 0"), batch_id, folder)

    return run_available(changes(evaluations, buckets), handle, name)


def totals(rows: DataFrame) -> DataFrame:
    """The counters after all changes that were written; counters without anything are not listed."""
    return rows.groupBy("counter", "name").agg(F.sum("amount").alias("amount")).where("amount <> 0")

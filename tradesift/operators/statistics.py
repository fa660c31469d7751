"""Counters and histograms over verdicts, outcomes and extraction results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradesift.operators.ordered import exploded, newest_of_key
from tradesift.operators.scoring import PRIORITIES

CARD_SAMPLES = 20


def verdict_counts(evaluations: DataFrame) -> DataFrame:
    return evaluations.agg(
        F.count_if("passed").alias("matched"), F.count_if(~F.col("passed")).alias("rejected")
    )


def _histogram(rows: DataFrame, items: Column, name: str) -> DataFrame:
    return exploded(rows, items, name).groupBy(name).agg(F.count("*").alias("n"))


def match_reasons(evaluations: DataFrame) -> DataFrame:
    """Pass reasons by type over matched leads; every reason counts."""
    passes = F.filter("reasons", lambda reason: reason.outcome == "pass")
    types = F.transform(passes, lambda reason: reason.type)
    return _histogram(evaluations, F.when(F.col("passed"), types), "reason")


def rejection_reasons(evaluations: DataFrame) -> DataFrame:
    failed = F.when(~F.col("passed"), F.col("failed_groups"))
    return _histogram(evaluations, failed, "failed_group")


def priority_counts(evaluations: DataFrame) -> DataFrame:
    """All six states, zero where no lead has one."""
    counts = evaluations.agg(
        *[F.count_if(F.col("priority") == name).alias(name) for name in PRIORITIES]
    )
    rows = F.array(
        *[F.struct(F.lit(name).alias("priority"), F.col(name).alias("n")) for name in PRIORITIES]
    )
    return counts.select(F.inline(rows))


def score_summary(evaluations: DataFrame) -> DataFrame:
    """Over scored leads only; null when there are none."""
    return evaluations.agg(
        F.count_if("passed").alias("eligible"),
        F.count("score").alias("scored"),
        (F.floor(F.avg("score") * 10 + 0.5) / 10).alias("average_score"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    outcome = F.col("outcome")
    return outcomes.agg(
        F.count_if(outcome == "new").alias("detected"),
        F.count_if(outcome != "unchanged").alias("processed"),
        F.count_if(outcome == "duplicate").alias("duplicates"),
        F.count_if(outcome == "failed").alias("failures"),
    )


def extraction_histograms(extractions: DataFrame) -> DataFrame:
    """Failed fields, missing fields and notes by name, in one pass."""
    tag = lambda kind: lambda item: F.struct(F.lit(kind).alias("kind"), item.alias("name"))
    tagged = [
        F.transform(name, tag(kind))
        for kind, name in (
            ("failed", "failed_fields"), ("missing", "missing_fields"), ("note", "notes")
        )
    ]
    items = exploded(extractions, F.concat(*tagged), "item")
    return items.groupBy("item.kind", "item.name").agg(F.count("*").alias("n"))


def _hundredths(value: Column) -> Column:
    return F.floor(value * 100 + 0.5) / 100


def extraction_averages(extractions: DataFrame) -> DataFrame:
    return extractions.agg(
        F.coalesce(_hundredths(F.avg("confidence")), F.lit(0.0)).alias("average_confidence"),
        F.coalesce(_hundredths(F.avg("completeness")), F.lit(0.0)).alias("average_completeness"),
    )


def warning_counts(leads: DataFrame) -> DataFrame:
    return _histogram(leads, F.col("normalization_warnings"), "warning")


def value_percentiles(
    values: DataFrame,
    keys: list[str],
    value: str,
    shares: dict[str, float],
    newest: list[Column] | None = None,
    last_n: int | None = None,
) -> DataFrame:
    """Average, maximum and nearest-rank percentiles per key, over the same values: all of them, or the
    newest ``last_n`` where that is given."""
    if last_n is not None:
        values = newest_of_key(values, keys, newest, last_n)
    return values.groupBy(*keys).agg(
        _hundredths(F.avg(value)).alias("average"),
        F.max(value).alias("maximum"),
        *[
            F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})").alias(name)
            for name, share in shares.items()
        ],
    )


def button_counts(results: DataFrame, order: list[str]) -> DataFrame:
    """Button checks: how they were found, what went wrong, and the last failure."""
    code, ok = F.col("code"), F.col("ok")
    failure = F.concat(code, F.lit(": "), F.col("reason"))
    return results.agg(
        F.count_if(ok).alias("found"),
        F.count_if(~ok & (code == "IDENTITY_MISMATCH")).alias("identity_mismatch"),
        F.count_if(~ok & (code != "IDENTITY_MISMATCH")).alias("not_found"),
        F.count_if(ok & (code == "FOUND_REFERENCE")).alias("by_reference"),
        F.count_if(ok & (code == "FOUND_TEXT")).alias("by_text"),
        F.max_by(F.when(~ok, failure), F.when(~ok, F.struct(*order))).alias("last_failure"),
    )


def recent_samples(samples: DataFrame, newest: list[Column], limit: int = CARD_SAMPLES) -> DataFrame:
    return samples.orderBy(*newest).limit(limit)


def scan_summary(outcomes: DataFrame) -> DataFrame:
    """New leads and duration of every scan."""
    millis = F.unix_millis(F.max(F.col("at").cast("timestamp"))) - F.unix_millis(
        F.min(F.col("at").cast("timestamp"))
    )
    return outcomes.groupBy("scan_id").agg(
        F.count_if(F.col("outcome") == "new").alias("new_leads"), millis.alias("duration_ms")
    )

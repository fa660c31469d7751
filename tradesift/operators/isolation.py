"""Leads that fail in a step keep what arrived, with the step and the reason, beside the leads that went on.

A step is a projection that never stops the job (``try_`` forms, permissive reading) and a condition that says what went
wrong. A lead that failed in one step is not judged by the later ones and what they compute of it is null; its payload
stays. Good and failed leads leave one pass together, so nothing is computed twice and none is lost between two filters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradesift.operators.normalize import normalize_leads
from tradesift.operators.ordered import filter_computed

#: Columns of a captured lead, as they arrive in its JSON text.
PAYLOAD = (
    "raw_title string, country string, quantity_raw string, raw_lead_age string, category string, product_category string, buys_raw string, "
    "strength_raw string, dosage_form string, mobile_available boolean, whatsapp_available boolean, email_available boolean"
)
_NAMES = [column.split()[0] for column in PAYLOAD.split(", ")]

Step = tuple[str, Callable[[DataFrame], DataFrame], Column]


def isolated(rows: DataFrame, steps: list[Step]) -> DataFrame:
    """Runs the steps ``(name, projection, error)``; adds ``failed_step`` and ``error``, null for a row that went through.

    ``error`` of a step reads its columns and is a text, or null where all is well. Columns that a failed row gets from its
    failing step or a later one are null.
    """
    rows = rows.withColumns({"failed_step": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
    for name, project, error in steps:
        before = rows.columns
        after = project(rows)
        made = [column for column in after.columns if column not in before]
        fails = F.when(F.col("failed_step").isNull(), error)
        # computed once: every column below reads the error
        after = filter_computed(after.withColumn("_fails", fails), F.lit(True))
        whole = F.col("failed_step").isNull() & F.col("_fails").isNull()
        rows = after.select(
            *[column for column in before if column not in ("failed_step", "error")],
            *[F.when(whole, F.col(column)).alias(column) for column in made],
            F.coalesce("failed_step", F.when(F.col("_fails").isNotNull(), name)).alias("failed_step"),
            F.coalesce("error", "_fails").alias("error"),
        )
    return rows


def read_payload(rows: DataFrame) -> DataFrame:
    """The columns of the payload, and ``corrupt`` where it is no JSON object of these columns."""
    schema = f"struct<{', '.join(c.replace(' ', ':', 1) for c in PAYLOAD.split(', '))}, corrupt:string>"
    read = F.from_json("payload", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    parsed = filter_computed(rows.withColumn("_read", read), F.lit(True))
    return parsed.select(*rows.columns, *[F.col(f"_read.{name}").alias(name) for name in _NAMES], F.col("_read.corrupt").alias("corrupt"))


def normalize_payloads(captured: DataFrame) -> DataFrame:
    """``(row_id, payload)`` to normalized leads; a lead that fails keeps its payload, ``failed_step`` and ``error``."""
    not_read = F.when(F.col("payload").isNull(), "payload: missing").when(F.col("corrupt").isNotNull(), "payload: not a lead")
    # an amount that no double holds has no value after normalization, unlike one that is no number at all
    digits = F.regexp_extract(F.replace("quantity_raw", F.lit(","), F.lit("")), r"^\s*(\d+)", 1)
    beyond = F.col("quantity_value").isNull() & (F.abs(digits.try_cast("double")) == float("inf"))
    not_finite = F.when(beyond, "quantity: not a finite number")
    steps = [("read", read_payload, not_read), ("normalize", normalize_leads, not_finite)]
    return isolated(captured, steps).drop("corrupt")


def failure_counts(rows: DataFrame) -> DataFrame:
    return rows.where("failed_step IS NOT NULL").groupBy("failed_step", "error").agg(F.count(F.lit(1)).alias("n"))


def write_isolated(rows: DataFrame, folder: str) -> None:
    """One write of both outputs: ``folder/failed=false`` and ``folder/failed=true``."""
    rows.withColumn("failed", F.col("failed_step").isNotNull()).write.partitionBy("failed").parquet(folder)

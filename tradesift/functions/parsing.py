"""Numbers, units, strengths and ages out of text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradesift.functions.lookups import DOSAGE_FORMS, STRENGTH_UNITS, UNITS, lookup
from tradesift.functions.text import (
    WHITESPACE_CLASS,
    collapse_spaces,
    half_up,
    let,
)

# Patterns and limits that decide which texts count as a measure.
MEASURE_PATTERN = r"^(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?\s*(.*)$"
UNIT_PATTERN = r"^[\p{L}%\x{B5}][\p{L}\p{N}%\x{B5} ./]*$"
MAX_UNIT_LENGTH = 40
RANGE_UNIT_PATTERN = r"(?i)^(?:to|[-\x{2013}\x{2014}])\s*\d"
STRENGTH_NUMBER = r"\d+(?:\.\d+)?"
STRENGTH_UNIT = r"[a-z\x{B5}\x{3BC}%][a-z\x{B5}\x{3BC}%.]*(?:\s*/\s*\d*\s*[a-z\x{B5}\x{3BC}]+)?|%\s*[wv]/[wv]"
SIMPLE_STRENGTH = rf"(?iu)^({STRENGTH_NUMBER})\s*({STRENGTH_UNIT})$"
EQUIVALENT_STRENGTH = (
    rf"(?iu)^({STRENGTH_NUMBER})\s*({STRENGTH_UNIT})"
    rf"\s*\(\s*({STRENGTH_NUMBER})\s*({STRENGTH_UNIT})\s*\)$"
)
COMBINED_STRENGTH = (
    rf"(?iu)^({STRENGTH_NUMBER})\s*({STRENGTH_UNIT})"
    rf"\s*(\+|&|/|,|and)\s*({STRENGTH_NUMBER})\s*({STRENGTH_UNIT})$"
)
DENOMINATOR = r"^(\d*)([a-z]+)$"
AGE_PATTERN = r"^(\d+|an?|one)\s*([a-z]+)\s+ago$"
RAW_AGE_PATTERN = r"^(\d+)\s*([a-z]+)\s+ago$"
# Minutes per age unit; the last two are only approximate.
SECOND_UNITS = ["s", "sec", "secs", "second", "seconds"]
MINUTE_UNITS = ["m", "min", "mins", "minute", "minutes"]
HOUR_UNITS = ["h", "hr", "hrs", "hour", "hours"]
DAY_UNITS = ["d", "day", "days"]
WEEK_UNITS = ["w", "wk", "wks", "week", "weeks"]
MONTH_UNITS = ["mo", "mos", "month", "months"]
RAW_MONTH_UNITS = ["mo", "month", "months"]
YEAR_UNITS = ["y", "yr", "yrs", "year", "years"]


def no_text() -> Column:
    return F.lit(None).cast("string")


def no_number() -> Column:
    return F.lit(None).cast("double")


def finite(number: Column) -> Column:
    return let(number, lambda value: F.when(F.abs(value) < F.lit(float("inf")), value))


def add_measure(rows: DataFrame, cleaned: str, prefix: str) -> DataFrame:
    """Adds ``{prefix}_value`` and ``{prefix}_unit`` of one number with an optional unit.

    Both are null for ranges and other text. ``cleaned`` is a column of single-spaced text.
    """
    text = F.col(cleaned)
    whole, fraction, rest = (f"_{prefix}_{part}" for part in ("whole", "fraction", "rest"))
    number, readable = f"_{prefix}_number", f"_{prefix}_readable"
    rows = rows.withColumns(
        {
            whole: F.replace(F.regexp_extract(text, MEASURE_PATTERN, 1), F.lit(","), F.lit("")),
            fraction: F.regexp_extract(text, MEASURE_PATTERN, 2),
            rest: F.trim(F.regexp_extract(text, MEASURE_PATTERN, 3)),
        }
    )
    # a text without a number is not cast: Spark would raise and catch an error for each
    digits = F.when(F.col(whole) == "", no_text()).when(F.col(fraction) == "", F.col(whole)).otherwise(F.concat_ws(".", whole, fraction))
    rows = rows.withColumn(number, digits.try_cast("double"))
    unit = F.col(rest)
    rows = rows.withColumn(
        readable,
        (F.col(number) < F.lit(float("inf")))
        & ((unit == "") | ((F.length(unit) <= MAX_UNIT_LENGTH) & unit.rlike(UNIT_PATTERN))),
    )
    return rows.withColumns(
        {
            f"{prefix}_value": F.when(F.col(readable), F.col(number)),
            f"{prefix}_unit": F.when(F.col(readable) & (unit != ""), unit),
        }
    ).drop(whole, fraction, rest, number, readable)


def canonical_unit(key: Column) -> Column:
    return lookup(UNITS, key)


def add_strength_units(rows: DataFrame, units: list[str]) -> DataFrame:
    """Replaces unit texts by their canonical form and adds ``{unit}_known``.

    Known is an alias, or an alias over an optional number and an alias.
    """
    spaces = rf"[{WHITESPACE_CLASS}]+"
    rows = rows.withColumns(
        {
            unit: F.regexp_replace(
                F.regexp_replace(F.lower(unit), spaces, ""), r"[\x{B5}\x{3BC}]", "u"
            )
            for unit in units
        }
    )
    rows = rows.withColumns({f"{unit}_below": F.get(F.split(unit, "/"), F.lit(1)) for unit in units})
    rows = rows.withColumns(
        {
            f"{unit}_known": F.coalesce(
                lookup(STRENGTH_UNITS, F.col(unit)),
                F.concat(
                    lookup(STRENGTH_UNITS, F.get(F.split(unit, "/"), F.lit(0))),
                    F.lit("/"),
                    F.regexp_extract(f"{unit}_below", DENOMINATOR, 1),
                    lookup(STRENGTH_UNITS, F.regexp_extract(f"{unit}_below", DENOMINATOR, 2)),
                ),
            )
            for unit in units
        }
    )
    known = {unit: F.coalesce(f"{unit}_known", unit) for unit in units}
    known |= {f"{unit}_known": F.col(f"{unit}_known").isNotNull() for unit in units}
    return rows.withColumns(known).drop(*[f"{unit}_below" for unit in units])


def canonical_dosage_form(key: Column) -> Column:
    return lookup(DOSAGE_FORMS, key)


def unit_minutes(unit: Column, month_units: list[str], weeks: list[str] = WEEK_UNITS) -> Column:
    return (
        F.when(unit.isin(SECOND_UNITS), F.lit(1 / 60))
        .when(unit.isin(MINUTE_UNITS), F.lit(1.0))
        .when(unit.isin(HOUR_UNITS), F.lit(60.0))
        .when(unit.isin(DAY_UNITS), F.lit(1440.0))
        .when(unit.isin(weeks), F.lit(10080.0))
        .when(unit.isin(month_units), F.lit(43200.0))
        .when(unit.isin(YEAR_UNITS), F.lit(525600.0))
    )


def parse_lead_age_minutes(text: Column) -> Column:
    """Minutes of a relative age as shown on the card; "yesterday" counts as one day."""

    def minutes(shown: Column) -> Column:
        found = F.regexp_extract(shown, RAW_AGE_PATTERN, 1)
        amount = F.when(found != "", found).try_cast("double")
        unit = F.regexp_extract(shown, RAW_AGE_PATTERN, 2)
        counted = half_up(let(unit, lambda u: unit_minutes(u, RAW_MONTH_UNITS)) * amount)
        return (
            F.when(shown == "just now", F.lit(0))
            .when(shown == "yesterday", F.lit(1440))
            .otherwise(counted)
            .cast("double")
        )

    return let(F.lower(collapse_spaces(text)), minutes)

"""Lead table to normalized lead table.

The steps add flat columns, each computed once in its own projection, because later filters and
scores read them many times. ``normalized_record`` nests them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tradesift.functions import parsing as P
from tradesift.functions import text as X
from tradesift.functions.lookups import country_aliases, country_codes, lookup

NORMALIZATION_VERSION = "1.0.0"
# joins list items for one pass through Unicode normalization; never part of visible text
ITEM_SEPARATOR = "\x1f"

OPTIONAL_COLUMNS = {
    "quantity_per_strip_raw": "string",
    "strength_raw": "string",
    "dosage_form": "string",
    "breadcrumbs": "array<string>",
    "buys_raw": "string",
    "requirements": "int",
    "calls": "int",
    "replies": "int",
    "verified": "boolean",
}


def with_optional_columns(leads: DataFrame) -> DataFrame:
    absent = {
        name: F.lit(None).cast(kind)
        for name, kind in OPTIONAL_COLUMNS.items()
        if name not in leads.columns
    }
    leads = leads.withColumns(absent)
    if "buys" not in leads.columns:
        leads = leads.withColumn("buys", X.split_list(F.col("buys_raw")))
    return leads


NFKC_PREFIX = "_nfkc_"
PLAIN_PREFIX = "_plain_"


def prepare_texts(leads: DataFrame, composed: list[str] = (), plain: list[str] = ()) -> DataFrame:
    """Unicode forms of raw columns, all in one projection and so in one Arrow pass.

    Steps must not add Python calls of their own: Spark merges the projections between two of them
    and would repeat the expressions in there.
    """
    new = lambda prefix, names: [name for name in names if f"{prefix}{name}" not in leads.columns]
    texts = {f"{NFKC_PREFIX}{name}": _as_text(leads, name) for name in new(NFKC_PREFIX, composed)}
    plain_texts = {f"{PLAIN_PREFIX}{name}": F.col(name) for name in new(PLAIN_PREFIX, plain)}
    return leads.withColumns({**X.nfkc_together(texts), **X.nfkc_without_accents_together(plain_texts)})


def drop_prepared(leads: DataFrame) -> DataFrame:
    prefixes = (NFKC_PREFIX, PLAIN_PREFIX)
    return leads.drop(*[name for name in leads.columns if name.startswith(prefixes)])


def _as_text(leads: DataFrame, name: str) -> Column:
    """List columns travel as one separated string."""
    if not isinstance(leads.schema[name].dataType, ArrayType):
        return F.col(name)
    blanks = F.transform(F.col(name), lambda item: F.coalesce(item, F.lit("")))
    return F.array_join(blanks, ITEM_SEPARATOR)


def composed(name: str) -> Column:
    return F.col(f"{NFKC_PREFIX}{name}")


def plain(name: str) -> Column:
    return F.col(f"{PLAIN_PREFIX}{name}")


def _display_items(joined: Column) -> Column:
    """Clean, non-empty items; a list that is clean ASCII already is only split."""
    items = F.transform(F.split(joined, ITEM_SEPARATOR), X.clean_display)
    return (
        F.when(joined.isNull() | (joined == ""), X.no_items())
        .when(is_clean_list(joined), F.split(joined, ITEM_SEPARATOR))
        .otherwise(F.filter(items, lambda item: item.isNotNull()))
    )


def is_clean_list(joined: Column) -> Column:
    return X.is_ascii(joined) & ~joined.rlike(X.unclean_items(ITEM_SEPARATOR))


def _warning(condition: Column, message: str) -> Column:
    return F.when(condition, F.lit(message))


def with_country(leads: DataFrame, raw: str = "country") -> DataFrame:
    """Adds ``country_normalized``, ``country_code``, ``country_key`` and ``country_warning``."""
    leads = prepare_texts(leads, [raw], [raw])
    shown, alias = "_country_display", "_country_alias"
    leads = X.add_clean_display(
        leads, {shown: f"{NFKC_PREFIX}{raw}", alias: f"{PLAIN_PREFIX}{raw}"}
    )
    leads = X.add_alias_keys(leads, {alias: F.col(alias)})
    known = F.broadcast(country_aliases(leads.sparkSession))
    joined = leads.join(known, leads[alias] == known["alias"], "left")
    return joined.withColumns(
        {
            "country_normalized": F.coalesce("country_name", shown),
            "country_code": F.col("code"),
            "country_key": F.coalesce("country_name_key", alias),
            "country_warning": _warning(
                F.col(shown).isNotNull() & F.col("code").isNull(), "country: not in alias map"
            ),
        }
    ).drop("alias", "code", "country_name", "country_name_key", shown, alias)


def with_country_by_code(rows: DataFrame, code: str) -> DataFrame:
    """Adds ``country_code`` and ``country_name`` for an ISO code in any case."""
    known = F.broadcast(country_codes(rows.sparkSession))
    known = known.select(F.col("code").alias("country_code"), "country_name")
    return rows.join(known, F.upper(X.collapse_spaces(F.col(code))) == known["country_code"], "left")


def with_compiled_countries(terms: DataFrame, label: str) -> DataFrame:
    """Adds ``term_code`` and ``term_key`` of configured countries: alias first, else ISO code."""
    terms = with_country(terms, label)
    by_code = F.broadcast(
        country_aliases(terms.sparkSession).select(
            F.col("code").alias("_iso"), F.col("country_name_key").alias("_iso_key")
        ).distinct()
    )
    two_letters = F.col(label).rlike("(?i)^[a-z]{2}$") & F.col("country_code").isNull()
    typed = F.when(two_letters, F.upper(F.col(label)))
    terms = terms.withColumn("_typed", typed)
    terms = terms.join(by_code, terms["_typed"] == by_code["_iso"], "left")
    return drop_prepared(
        terms.withColumns(
            {
                "term_code": F.coalesce("country_code", "_iso"),
                "term_key": F.coalesce("_iso_key", "country_key"),
            }
        ).drop("_typed", "_iso", "_iso_key")
    )


def with_measure(leads: DataFrame, field: str, raw: str, prefix: str) -> DataFrame:
    """Adds ``{prefix}_value``, ``_unit``, ``_normalized_unit`` and ``_warning``."""
    leads = prepare_texts(leads, [raw], [raw])
    shown, key = f"_{prefix}_display", f"_{prefix}_key"
    leads = X.add_clean_display(leads, {shown: f"{NFKC_PREFIX}{raw}", key: f"{PLAIN_PREFIX}{raw}"})
    leads = P.add_measure(leads, shown, prefix)
    value, unit, is_range = F.col(f"{prefix}_value"), F.col(f"{prefix}_unit"), f"_{prefix}_is_range"
    leads = leads.withColumn(is_range, F.coalesce(unit.rlike(P.RANGE_UNIT_PATTERN), F.lit(False)))
    single = ~F.col(is_range)
    leads = leads.withColumns(
        {
            f"{prefix}_value": F.when(single, value),
            f"{prefix}_unit": F.when(single, unit),
            # the unit again, from the text without accents, for the lookups
            key: F.when(
                single & unit.isNotNull(), F.trim(F.regexp_extract(key, P.MEASURE_PATTERN, 3))
            ),
        }
    )
    first, exact = f"_{prefix}_first", f"_{prefix}_exact"
    leads = X.add_alias_keys(leads, {key: F.col(key), first: F.split_part(key, F.lit(" "), F.lit(1))})
    leads = leads.withColumns(
        {
            exact: P.canonical_unit(F.col(key)),
            first: P.canonical_unit(F.col(first)),
        }
    )
    return leads.withColumns(
        {
            f"{prefix}_normalized_unit": F.when(unit.isNotNull(), F.coalesce(exact, first, key)),
            f"{prefix}_warning": F.when(F.col(shown).isNull(), P.no_text())
            .when(value.isNull(), F.lit(f"{field}: not a single number with a unit"))
            .when(unit.isNull(), F.lit(f"{field}: no unit"))
            .when(F.col(exact).isNotNull(), P.no_text())
            .when(F.col(first).isNotNull(), F.lit(f"{field}: unit has extra detail"))
            .otherwise(F.lit(f"{field}: unrecognized unit")),
        }
    ).drop(shown, key, is_range, first, exact)


def with_strength(leads: DataFrame, raw: str = "strength_raw") -> DataFrame:
    """Adds the ``strength_*`` columns: value, unit, secondary value and unit, complex, warnings."""
    leads = prepare_texts(leads, [raw])
    leads = X.add_clean_display(leads, {"_strength": f"{NFKC_PREFIX}{raw}"})
    text = F.col("_strength")
    leads = leads.withColumn(
        "_strength_kind",
        F.when(text.rlike(P.COMBINED_STRENGTH), "combined")
        .when(text.rlike(P.EQUIVALENT_STRENGTH), "equivalent")
        .when(text.rlike(P.SIMPLE_STRENGTH), "simple"),
    )
    kind = F.col("_strength_kind")

    def part(combined: int, equivalent: int, simple: int | None = None) -> Column:
        taken = F.when(
            kind == "combined", F.regexp_extract(text, P.COMBINED_STRENGTH, combined)
        ).when(kind == "equivalent", F.regexp_extract(text, P.EQUIVALENT_STRENGTH, equivalent))
        if simple:
            taken = taken.when(
                kind == "simple", F.regexp_extract(text, P.SIMPLE_STRENGTH, simple)
            )
        return taken

    leads = leads.withColumns(
        {
            "_first_value": part(1, 1, 1),
            "_first_unit": part(2, 2, 2),
            "_second_value": part(4, 3),
            "_second_unit": part(5, 4),
            "_separator": F.when(
                kind == "combined", F.regexp_extract(text, P.COMBINED_STRENGTH, 3)
            ),
        }
    )
    leads = P.add_strength_units(leads, ["_first_unit", "_second_unit"])
    # a slash between two different units is a concentration, which no single pattern reads
    concentration = (F.col("_separator") == "/") & (F.col("_first_unit") != F.col("_second_unit"))
    leads = leads.withColumn(
        "_strength_kind",
        F.when(F.coalesce(concentration, F.lit(False)), F.when(text.rlike(P.SIMPLE_STRENGTH), "ratio"))
        .otherwise(kind),
    )
    leads = leads.withColumns(
        {
            "_ratio_value": F.when(kind == "ratio", F.regexp_extract(text, P.SIMPLE_STRENGTH, 1)),
            "_ratio_unit": F.when(kind == "ratio", F.regexp_extract(text, P.SIMPLE_STRENGTH, 2)),
        }
    )
    leads = P.add_strength_units(leads, ["_ratio_unit"])
    is_pair = kind.isin("combined", "equivalent")
    unknown = lambda known: _warning(~F.col(known), "strength: unrecognized unit")
    number = lambda digits: digits.try_cast("double")
    leads = leads.withColumns(
        {
            "_first_number": number(
                F.when(kind == "ratio", F.col("_ratio_value")).when(
                    kind.isNotNull(), F.col("_first_value")
                )
            ),
            "_second_number": number(F.when(is_pair, F.col("_second_value"))),
        }
    )
    infinite = F.lit(float("inf"))
    return leads.withColumns(
        {
            "strength_value": F.when(F.col("_first_number") < infinite, F.col("_first_number")),
            "strength_unit": F.when(kind == "ratio", F.col("_ratio_unit")).when(
                kind.isNotNull(), F.col("_first_unit")
            ),
            "strength_secondary_value": F.when(
                F.col("_second_number") < infinite, F.col("_second_number")
            ),
            "strength_secondary_unit": F.when(is_pair, F.col("_second_unit")),
            "strength_complex": F.coalesce(is_pair, F.lit(False)),
            "strength_warnings": F.array_compact(
                F.when(text.isNull(), F.array().cast("array<string>"))
                .when(kind.isNull(), F.array(F.lit("strength: unrecognized format")))
                .when(kind == "ratio", F.array(unknown("_ratio_unit_known")))
                .when(kind == "simple", F.array(unknown("_first_unit_known")))
                .otherwise(
                    F.array(
                        F.when(kind == "combined", F.lit("strength: combination")).otherwise(
                            F.lit("strength: complex format (value with equivalent)")
                        ),
                        unknown("_first_unit_known"),
                        unknown("_second_unit_known"),
                    )
                )
            ),
        }
    ).drop(
        "_strength", "_strength_kind", "_separator", "_first_value", "_second_value",
        "_first_unit", "_second_unit", "_first_unit_known", "_second_unit_known",
        "_ratio_value", "_ratio_unit", "_ratio_unit_known", "_first_number", "_second_number",
    )


def with_dosage_form(leads: DataFrame, raw: str = "dosage_form") -> DataFrame:
    leads = prepare_texts(leads, plain=[raw])
    leads = X.add_clean_display(leads, {"_form_key": f"{PLAIN_PREFIX}{raw}"})
    leads = X.add_alias_keys(leads, {"_form_key": F.col("_form_key")})
    leads = leads.withColumn("_form", P.canonical_dosage_form(F.col("_form_key")))
    return leads.withColumns(
        {
            "dosage_form_normalized": F.coalesce("_form", "_form_key"),
            "dosage_form_warning": _warning(
                F.col("_form_key").isNotNull() & F.col("_form").isNull(),
                "dosageForm: unrecognized form",
            ),
        }
    ).drop("_form_key", "_form")


def with_buyer_products(leads: DataFrame) -> DataFrame:
    leads = prepare_texts(leads, ["buys"])
    leads = leads.withColumn("buyer_products", _display_items(composed("buys")))
    return leads.withColumns(
        {
            "buyer_products_normalized": F.transform("buyer_products", F.lower),
            "buys_warning": _warning(
                F.col("buys_raw").isNotNull() & (F.size("buyer_products") == 0),
                "buys: no products in value",
            ),
        }
    )


def with_lead_age(leads: DataFrame, raw: str = "raw_lead_age") -> DataFrame:
    """Adds ``age_minutes``, ``age_approximate`` and ``age_warning``; never reads the clock."""
    leads = prepare_texts(leads, [raw])
    leads = X.add_clean_display(leads, {"_age_text": f"{NFKC_PREFIX}{raw}"})
    leads = leads.withColumn("_age_text", F.lower("_age_text"))
    text = F.col("_age_text")
    leads = leads.withColumns(
        {
            "_age_amount": F.regexp_extract(text, P.AGE_PATTERN, 1),
            "_age_unit": F.regexp_extract(text, P.AGE_PATTERN, 2),
        }
    )
    amount, unit = F.col("_age_amount"), F.col("_age_unit")
    number = F.when(amount.rlike(r"^\d+$"), amount.try_cast("double")).otherwise(F.lit(1.0))
    leads = leads.withColumn("_age_factor", P.unit_minutes(unit, P.MONTH_UNITS))
    factor = F.col("_age_factor")
    now = text.isin("just now", "now")
    undated = text.isin("yesterday", "today")
    calendar = unit.isin(P.MONTH_UNITS + P.YEAR_UNITS)
    return leads.withColumns(
        {
            "age_minutes": F.when(now, F.lit(0.0))
            .when(amount == "", P.no_number())
            .when(calendar, number * factor)
            .otherwise(X.half_up(number * factor).cast("double")),
            "age_approximate": F.coalesce(calendar & ~now, F.lit(False)),
            "age_warning": F.when(text.isNull() | now, P.no_text())
            .when(undated, F.lit("leadAge: imprecise (needs current date)"))
            .when(amount == "", F.lit("leadAge: unrecognized format"))
            .when(calendar, F.lit("leadAge: approximate (calendar unit)"))
            .when(factor.isNull(), F.lit("leadAge: unrecognized unit")),
        }
    ).drop("_age_text", "_age_amount", "_age_unit", "_age_factor")


def with_contact_flags(leads: DataFrame) -> DataFrame:
    flags = ["mobile_available", "whatsapp_available", "email_available"]
    return leads.withColumns({flag: F.coalesce(flag, F.lit(False)) for flag in flags})


COMPOSED_TEXTS = [
    "raw_title", "country", "quantity_raw", "quantity_per_strip_raw", "strength_raw", "category",
    "product_category", "breadcrumbs", "buys", "raw_lead_age",
]
PLAIN_TEXTS = ["country", "quantity_raw", "quantity_per_strip_raw", "dosage_form"]


ALL_COMPOSED = [*COMPOSED_TEXTS, "dosage_form"]


def normalize_leads(leads: DataFrame) -> DataFrame:
    """All normalized columns next to the raw ones, with the warnings in fixed order."""
    leads = prepare_texts(with_optional_columns(leads), COMPOSED_TEXTS, PLAIN_TEXTS)
    leads = X.add_clean_display(
        leads,
        {
            "title_normalized": f"{NFKC_PREFIX}raw_title",
            "category_text": f"{NFKC_PREFIX}category",
            "product_category_text": f"{NFKC_PREFIX}product_category",
        },
    )
    leads = leads.withColumns(
        {
            "title_normalized": F.lower("title_normalized"),
            "breadcrumbs_text": _display_items(composed("breadcrumbs")),
        }
    )
    leads = leads.withColumn("title_tokens", X.tokens_of_comparison(F.col("title_normalized")))
    leads = with_country(leads)
    leads = with_measure(leads, "quantity", "quantity_raw", "quantity")
    leads = with_measure(leads, "quantityPerStrip", "quantity_per_strip_raw", "per_strip")
    leads = with_strength(leads)
    leads = with_dosage_form(leads)
    leads = with_buyer_products(leads)
    leads = with_lead_age(leads)
    leads = drop_prepared(with_contact_flags(leads))
    return leads.withColumn(
        "normalization_warnings",
        F.array_compact(
            F.concat(
                F.array("country_warning", "quantity_warning", "per_strip_warning"),
                F.col("strength_warnings"),
                F.array("dosage_form_warning", "buys_warning", "age_warning"),
            )
        ),
    )


def normalized_record(leads: DataFrame, normalized_at: Column) -> DataFrame:
    """The nested record: every raw value next to its normalized form."""
    c = F.col

    def record(**fields: Column) -> Column:
        return F.struct(*[value.alias(name) for name, value in fields.items()])

    nested = {
        "title": record(raw=c("raw_title"), normalized=c("title_normalized"), tokens=c("title_tokens")),
        "country_record": record(
            raw=c("country"), normalized=c("country_normalized"), code=c("country_code")
        ),
        "quantity": record(
            raw=c("quantity_raw"),
            value=c("quantity_value"),
            unit=c("quantity_unit"),
            normalized_unit=c("quantity_normalized_unit"),
        ),
        "quantity_per_strip": record(
            raw=c("quantity_per_strip_raw"),
            value=c("per_strip_value"),
            unit=c("per_strip_unit"),
            normalized_unit=c("per_strip_normalized_unit"),
        ),
        "strength": record(
            raw=c("strength_raw"),
            value=c("strength_value"),
            unit=c("strength_unit"),
            secondary_value=c("strength_secondary_value"),
            secondary_unit=c("strength_secondary_unit"),
            complex=c("strength_complex"),
        ),
        "dosage_form_record": record(raw=c("dosage_form"), normalized=c("dosage_form_normalized")),
        "category": c("category_text"),
        "product_category": c("product_category_text"),
        "breadcrumbs": c("breadcrumbs_text"),
        "buys": record(
            raw=c("buys_raw"),
            products=c("buyer_products"),
            normalized_products=c("buyer_products_normalized"),
        ),
        "engagement": record(
            requirements=c("requirements"),
            calls=c("calls"),
            replies=c("replies"),
            verified=F.coalesce(c("verified"), F.lit(False)),
        ),
        "contact": record(
            mobile_available=c("mobile_available"),
            whatsapp_available=c("whatsapp_available"),
            email_available=c("email_available"),
        ),
        "lead_age": record(
            raw=c("raw_lead_age"), minutes=c("age_minutes"), approximate=c("age_approximate")
        ),
        "normalization": record(
            warnings=c("normalization_warnings"),
            normalized_at=normalized_at,
            version=F.lit(NORMALIZATION_VERSION),
        ),
    }
    keys = [name for name in ("row_id", "lead_id", "fingerprint") if name in leads.columns]
    renamed = {"country_record": "country", "dosage_form_record": "dosage_form"}
    return leads.select(
        *keys, *[value.alias(renamed.get(name, name)) for name, value in nested.items()]
    )


def isolate_failures(leads: DataFrame, failed: Column) -> DataFrame:
    """A lead that could not be normalized keeps its raw columns and has no normalized record."""
    return leads.withColumn(
        "normalized", F.when(~F.coalesce(failed, F.lit(False)), F.col("normalized"))
    )

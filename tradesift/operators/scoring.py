"""Score of matched leads, 0 to 100, with a priority and the points of every component."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradesift.functions import text as X
from tradesift.plans.profiles import SCORE_COMPONENTS

# Age tiers (minutes, fraction), priorities in order and short component names.
AGE_TIERS = [(15, 1.0), (60, 0.75), (180, 0.5), (1440, 0.25)]
PRIORITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "UNSCORED", "REJECTED"]
SHORT_NAMES = {"whatsapp": "WhatsApp", "buyerProducts": "buyer products", "leadAge": "lead age"}
SCORE_REASON = "struct<type:string,points:double,max_points:double,message:string>"


def _prefixed(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), text)


def country_part() -> tuple[Column, Column]:
    name = F.col("country_normalized")
    matched = F.size("matched_countries") > 0
    # read from the failed groups: no reason has to be made for a score
    judged = F.array_contains("failed_groups", "countries")
    fraction = F.when(matched, 1.0).when(judged | name.isNull(), 0.0).otherwise(1.0)
    message = (
        F.when(matched, _prefixed("Country matched: ", name))
        .when(
            judged,
            _prefixed("Country not in the filter list: ", F.coalesce(name, F.lit("unknown"))),
        )
        .when(name.isNull(), "Country unavailable")
        .otherwise(_prefixed("Country: ", name))
    )
    return fraction, message


def quantity_part(full: float) -> tuple[Column, Column]:
    value, raw, unit = F.col("quantity_value"), F.col("quantity_raw"), F.col("quantity_unit")
    share = F.least(F.greatest(value, F.lit(0.0)) / F.lit(float(full)), F.lit(1.0))
    counted = X.short_number_text(F.least(value, F.lit(float(full))))
    shown_full = X.short_number_text(F.lit(float(full)))
    message = (
        F.when(
            value.isNotNull(),
            F.concat(
                F.concat_ws(" ", F.lit("Quantity"), X.short_number_text(value), unit),
                F.lit(" ("), counted, F.lit("/"), shown_full, F.lit(")"),
            ),
        )
        .when(raw.isNull(), "Quantity unavailable")
        .otherwise(_prefixed("Quantity not a single number: ", raw))
    )
    return F.coalesce(share, F.lit(0.0)), message


def flag_part(flag: str, label: str) -> tuple[Column, Column]:
    available = F.col(flag)
    message = F.when(available, f"{label} available").otherwise(f"{label} unavailable")
    return available.cast("double"), message


def keyword_part() -> tuple[Column, Column]:
    matched = F.col("matched_keywords")
    count = F.size(matched)
    more = F.when(
        count > 1, F.concat(F.lit(" (+"), (count - 1).cast("string"), F.lit(" more)"))
    ).otherwise("")
    searched = F.exists("reasons", lambda r: (r.group == "keywords") & (r.type != "GROUP_EMPTY"))
    message = (
        F.when(count > 0, F.concat(F.lit("Keyword matched: "), F.get(matched, F.lit(0)), more))
        .when(searched, "No keyword matched")
        .otherwise("Keyword filter off")
    )
    return (count > 0).cast("double"), message


def category_part() -> tuple[Column, Column]:
    category = F.coalesce("product_category_text", "category_text")
    message = F.when(category.isNotNull(), _prefixed("Category: ", category))
    return category.isNotNull().cast("double"), message.otherwise("Category unavailable")


def products_part() -> tuple[Column, Column]:
    count = F.size("buyer_products_normalized")
    message = F.when(count > 0, _prefixed("Buyer products listed: ", count.cast("string")))
    return (count > 0).cast("double"), message.otherwise("No buyer products listed")


def age_part(allow_approximate: bool) -> tuple[Column, Column]:
    minutes, raw = F.col("age_minutes"), F.col("raw_lead_age")
    unusable = F.lit(False) if allow_approximate else F.col("age_approximate")
    fraction = F.when(minutes.isNull() | unusable, 0.0)
    for limit, share in AGE_TIERS:
        fraction = fraction.when(minutes <= limit, share)
    skipped = F.concat(F.lit("Lead age approximate, not scored: "), F.coalesce(raw, F.lit("")))
    message = (
        F.when(minutes.isNull(), "Lead age unavailable")
        .when(unusable, F.trim(skipped))
        .otherwise(F.concat(F.lit("Lead age "), X.short_number_text(minutes), F.lit(" min")))
    )
    return fraction.otherwise(0.0), message


def component_parts(profile: dict) -> dict[str, tuple[Column, Column]]:
    """Fraction in 0 to 1 and message of every component."""
    return {
        "country": country_part(),
        "quantity": quantity_part(profile["quantityForFullPoints"]),
        "mobile": flag_part("mobile_available", "Mobile"),
        "whatsapp": flag_part("whatsapp_available", "WhatsApp"),
        "email": flag_part("email_available", "Email"),
        "keyword": keyword_part(),
        "category": category_part(),
        "buyerProducts": products_part(),
        "leadAge": age_part(profile["allowApproximateLeadAge"]),
    }


def priority_for(score: Column, thresholds: dict) -> Column:
    return (
        F.when(score >= thresholds["critical"], "CRITICAL")
        .when(score >= thresholds["high"], "HIGH")
        .when(score >= thresholds["medium"], "MEDIUM")
        .otherwise("LOW")
    )


def score_leads(leads: DataFrame, profile: dict) -> DataFrame:
    """Adds kind, eligible, score, raw_score, max_raw_score, priority and score_reasons.

    Rejected leads and leads that are not scored have a null score, never 0.
    """
    no_reasons = F.array().cast(f"array<{SCORE_REASON}>")
    kind = F.when(~F.col("passed"), "REJECTED").otherwise(
        "SCORED" if profile["enabled"] else "UNSCORED"
    )
    leads = leads.withColumns({"kind": kind, "eligible": F.col("passed")})
    scored = F.col("kind") == "SCORED"
    weights = {name: profile["weights"][name] for name in SCORE_COMPONENTS}
    weights = {name: float(weight) for name, weight in weights.items() if weight}
    parts = component_parts(profile)
    points = {
        f"_points_{name}": F.when(
            scored, X.half_up(F.lit(weight) * parts[name][0] * F.lit(100.0)).cast("bigint")
        )
        for name, weight in weights.items()
    }
    leads = leads.withColumns(points)
    total = sum(weights.values())
    hundredths = sum((F.col(name) for name in points), F.lit(0))
    leads = leads.withColumn("_hundredths", hundredths)
    earned = F.col("_hundredths")
    clamped = F.least(F.lit(100), F.greatest(F.lit(0), X.half_up(earned / F.lit(total))))
    leads = leads.withColumn("score", F.when(scored, clamped.cast("int")))
    reasons = [
        F.struct(
            F.lit(name).alias("type"),
            (F.col(f"_points_{name}") / 100.0).alias("points"),
            F.lit(weight).alias("max_points"),
            parts[name][1].alias("message"),
        ).cast(SCORE_REASON)
        for name, weight in weights.items()
    ]
    return leads.withColumns(
        {
            "raw_score": F.when(scored, earned / 100.0),
            "max_raw_score": F.when(scored, F.lit(total)),
            "priority": F.when(scored, priority_for(F.col("score"), profile["thresholds"])).otherwise(
                F.col("kind")
            ),
            "score_reasons": F.when(scored, F.array(*reasons)).otherwise(no_reasons),
        }
    ).drop("_hundredths", *points)


def unscored_on_error(leads: DataFrame) -> DataFrame:
    """A matched lead whose scoring gave no result stays, as UNSCORED."""
    return leads.withColumn("priority", F.coalesce("priority", F.lit("UNSCORED")))


def _points_text(points: Column) -> Column:
    return _prefixed("+", X.short_number_text(points))


def explain_score() -> Column:
    """One line: the parts that earned points, largest first, ties in component order."""
    short = F.create_map(
        *[F.lit(text) for name in SCORE_COMPONENTS for text in (name, SHORT_NAMES.get(name, name))]
    )
    positioned = F.transform(
        "score_reasons",
        lambda reason, position: F.struct(
            (-reason.points).alias("order"),
            position.alias("position"),
            F.concat(_points_text(reason.points), F.lit(" "), F.element_at(short, reason.type)).alias(
                "text"
            ),
        ),
    )
    earned = F.array_sort(F.filter(positioned, lambda part: part.order < 0))
    listed = F.array_join(F.transform(earned, lambda part: part.text), ", ")
    start = F.concat(
        F.lit("Score "), F.col("score").cast("string"), F.lit("/100 ("), F.col("priority"), F.lit(")")
    )
    text = X.let(listed, lambda t: F.concat(start, F.when(t != "", _prefixed(": ", t)).otherwise("")))
    return (
        F.when(F.col("kind") == "REJECTED", "Not scored: rejected by filters")
        .when(F.col("kind") == "UNSCORED", "Not scored: scoring is off")
        .otherwise(text)
    )

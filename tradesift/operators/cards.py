"""Fields of a lead out of the raw texts of its card.

Rows come from ``sources.pages.extract_cards``; everything here is column work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradesift.functions import parsing as P
from tradesift.functions import text as X

# Signal and field weights, labels and patterns of the card markup.
CARD_SIGNALS = {
    "title": 0.25, "country": 0.2, "quantity": 0.15, "buyer": 0.15, "category": 0.1,
    "engagement": 0.1, "contact": 0.05,
}
CARD_THRESHOLD = 0.5
NOISE_PATTERN = r"(?i)\s*Click here to view BuyLeads\b.*$"
FIELD_LABELS = {
    "quantity": ["Quantity", "Qty"],
    "strength": ["Strength"],
    "dosageForm": ["Dosage Form"],
    "quantityPerStrip": ["Quantity per Strip"],
    "buys": ["Buys"],
}
CONTACT_PATTERNS = {
    "mobile": r"(?i)\bMobile\s+Number\s+Available\b",
    "whatsapp": r"(?i)\bWhats\s*App\s+Available\b",
    "email": r"(?i)\bEmail(?:\s+ID)?\s+Available\b",
}
ENGAGEMENT_PATTERNS = {
    "requirements": r"(?i)\bRequirements?\s*:?\s*(\d[\d,]*)",
    "calls": r"(?i)\bCalls?\s*:?\s*(\d[\d,]*)",
    "replies": r"(?i)\bRepl(?:y|ies)\s*:?\s*(\d[\d,]*)",
}
ENGAGEMENT_NOTE = "engagement: markup not verified, values not read"
CORE_WEIGHTS = {
    "title": 0.3, "country": 0.2, "category": 0.15, "quantity": 0.15, "buys": 0.1, "leadAge": 0.1,
}
ALL_FIELDS = [
    "title", "country", "leadAge", "category", "quantity", "strength", "dosageForm",
    "quantityPerStrip", "buys", "engagement", "contact",
]
OPTIONAL_FIELDS = ["strength", "dosageForm", "quantityPerStrip"]
OPTIONAL_PENALTY = 0.05
BUTTON_TEXT = r"(?i)\bContact\s+Buyer\b"
SAFE_INTEGER = 9007199254740991


def _thousandths(value: Column) -> Column:
    return F.floor(value * 1000 + 0.5) / 1000


def with_card_confidence(cards: DataFrame, keep_failures: bool = False) -> DataFrame:
    """Adds the confidence of the present signals and keeps accepted cards; those that failed only where they are asked for."""
    weights = sum(
        (
            F.when(F.array_contains("signals", name), F.lit(weight)).otherwise(0.0)
            for name, weight in CARD_SIGNALS.items()
        ),
        F.lit(0.0),
    )
    scored = cards.withColumn("card_confidence", _thousandths(weights))
    accepted = F.col("card_confidence") >= CARD_THRESHOLD
    if keep_failures or "failure" not in cards.columns:
        return scored.filter(accepted)
    return scored.filter(accepted & F.col("failure").isNull())


def first_hit(hits: Column) -> Column:
    """The hit of the earliest strategy; hits are ``{strategy, position, text, confidence}``."""
    return F.array_min(hits)


def strip_noise(text: Column) -> Column:
    return F.coalesce(X.collapse_spaces(F.regexp_replace(text, NOISE_PATTERN, "")), F.lit(""))


def add_labels(cards: DataFrame, rows: str = "rows") -> DataFrame:
    """Adds what all rows say, in the lists that ``labeled_value`` looks fields up in; rows are ``{pairs: [{label, value}], text}``.

    Two columns, as Spark would compute the fields of a struct again wherever they are read.
    """
    names = sorted({label for labels in FIELD_LABELS.values() for label in labels}, key=len, reverse=True)
    inline = "(?i)^(" + "|".join(names) + r")\s*:\s*(.+)$"

    def pairs_of(row: Column, number: Column) -> Column:
        return F.transform(
            row.pairs,
            lambda p: F.struct(p.label.alias("label"), F.when(p.value.isNotNull(), p.label).alias("found"), p.value.alias("value"), number.alias("row")),
        )

    def text_of(row: Column) -> Column:
        value = F.trim(F.regexp_extract(row.text, inline, 2))
        return F.struct(
            F.when(value != "", F.lower(F.regexp_extract(row.text, inline, 1))).alias("found"),
            value.alias("value"),
            F.lower(F.regexp_replace(row.text, r"\s*:$", "")).alias("label"),
        )

    return cards.withColumns({"_pairs": F.flatten(F.transform(rows, pairs_of)), "_texts": F.transform(rows, text_of)})


def labeled_value(field: str) -> Column:
    """``{state, value, method}`` of a labeled field in what ``add_labels`` added: of the first row that has a value, beside the
    label or else in one text with it."""
    wanted = [label.lower() for label in FIELD_LABELS[field]]
    far = 1 << 30  # the place before it stands for none

    def at(labels: Column) -> Column:
        places = [F.array_position(labels, label) for label in wanted]
        return F.least(*[F.coalesce(F.pmod(place - 1, F.lit(far)), F.lit(far - 1)) for place in places], F.lit(far - 1)).cast("int")

    none = far - 1
    pairs, texts = F.col("_pairs"), F.col("_texts")
    beside, inline = at(pairs.found), at(texts.found)
    is_beside = F.coalesce(F.get(pairs.row, beside) <= inline, F.lit(False))
    broken = (at(pairs.label) < none) | (at(texts.label) < none)
    return F.struct(
        F.when((beside < none) | (inline < none), "found").when(broken, "failed").otherwise("missing").alias("state"),
        F.when(is_beside, F.get(pairs.value, beside)).otherwise(F.get(texts.value, inline)).alias("value"),
        F.when(is_beside, "sibling").when(inline < none, "inline").alias("method"),
    )


def breadcrumb_trail(crumbs: Column) -> Column:
    """``{crumbs, category, product_category}`` without consecutive repeats."""

    def trail(items: Column) -> Column:
        kept = F.filter(
            items,
            lambda item, i: (i == 0) | ~F.get(items, i - 1).eqNullSafe(item),
        )
        return X.let(kept, record)

    def record(kept: Column) -> Column:
        count = F.size(kept)
        last, above = F.get(kept, count - 1), F.get(kept, count - 2)
        return F.struct(
            kept.alias("crumbs"),
            F.when(count >= 2, above).otherwise(F.get(kept, F.lit(0))).alias("category"),
            F.when(count >= 2, last).alias("product_category"),
        )

    cleaned = F.filter(F.transform(crumbs, X.collapse_spaces), lambda item: item.isNotNull())
    return X.let(cleaned, trail)


def contact_availability(markers: Column, leaf_texts: Column, max_leaf_chars: int | None = None) -> Column:
    """Flags and source; marker texts win, else leaf texts (of at most ``max_leaf_chars``) that read like a marker."""
    short = lambda text: F.lit(True) if max_leaf_chars is None else F.length(text) <= max_leaf_chars
    looks_like = lambda text: short(text) & (
        text.rlike(CONTACT_PATTERNS["mobile"])
        | text.rlike(CONTACT_PATTERNS["whatsapp"])
        | text.rlike(CONTACT_PATTERNS["email"])
    )
    has_markers = F.size(markers) > 0
    texts = F.when(has_markers, markers).otherwise(F.filter(leaf_texts, looks_like))

    def record(used: Column) -> Column:
        reads_like = lambda pattern: lambda text: text.rlike(pattern)
        flags = [
            F.exists(used, reads_like(pattern)).alias(name)
            for name, pattern in CONTACT_PATTERNS.items()
        ]
        source = F.when(has_markers, "marker").when(F.size(used) > 0, "text").otherwise("none")
        return F.struct(*flags, source.alias("source"))

    return X.let(texts, record)


def engagement_counts(container_text: Column) -> Column:
    """Counts of a configured container; null text means no verified container."""
    counts = {}
    for name, pattern in ENGAGEMENT_PATTERNS.items():
        digits = F.replace(F.regexp_extract(container_text, pattern, 1), F.lit(","), F.lit(""))
        number = digits.try_cast("bigint")
        counts[name] = F.when(number <= SAFE_INTEGER, number)
    found = container_text.isNotNull()
    return F.struct(
        *[value.alias(name) for name, value in counts.items()],
        found.alias("verified"),
        F.when(found, "found").otherwise("missing").alias("state"),
        F.when(~found, ENGAGEMENT_NOTE).alias("note"),
    )


def with_extraction_info(cards: DataFrame) -> DataFrame:
    """Adds measures, field states, failed and missing fields, warnings, confidence, completeness.

    Needs ``state_{field}`` columns with the reading outcome and ``sure_{field}`` with the strategy
    confidence of core fields. A measure or age that cannot be parsed fails, its raw text stays.
    """
    measured = {
        "quantity": "quantity_raw",
        "strength": "strength_raw",
        "quantityPerStrip": "quantity_per_strip_raw",
    }
    cards = X.add_collapsed(cards, {f"_cleaned_{field}": raw for field, raw in measured.items()})
    for field in measured:
        cards = P.add_measure(cards, f"_cleaned_{field}", f"read_{field}").drop(f"_cleaned_{field}")
    cards = cards.withColumn("lead_age_minutes", P.parse_lead_age_minutes(F.col("raw_lead_age")))
    unparsed = {field: (raw, F.col(f"read_{field}_value")) for field, raw in measured.items()}
    unparsed["leadAge"] = ("raw_lead_age", F.col("lead_age_minutes"))
    problems = {
        field: F.when(
            F.col(raw).isNotNull() & value.isNull(),
            F.concat(F.lit(f'{field}: could not parse "'), F.col(raw), F.lit('"')),
        )
        for field, (raw, value) in unparsed.items()
    }
    cards = cards.withColumns({f"_problem_{field}": text for field, text in problems.items()})
    cards = cards.withColumns(
        {
            f"state_{field}": F.when(F.col(f"_problem_{field}").isNotNull(), "failed").otherwise(
                F.col(f"state_{field}")
            )
            for field in problems
        }
    )
    state = {field: F.col(f"state_{field}") for field in ALL_FIELDS}
    in_state = lambda name: F.array_compact(
        F.array(*[F.when(state[field] == name, F.lit(field)) for field in ALL_FIELDS])
    )
    total = sum(
        (
            F.lit(weight)
            if field == "title"
            else F.when(state[field] == "missing", 0.0).otherwise(weight)
            for field, weight in CORE_WEIGHTS.items()
        ),
        F.lit(0.0),
    )
    read = sum(
        (
            F.when(state[field] == "found", F.lit(weight) * F.col(f"sure_{field}")).otherwise(0.0)
            for field, weight in CORE_WEIGHTS.items()
        ),
        F.lit(0.0),
    )
    failed_optional = sum(
        ((state[field] == "failed").cast("int") for field in OPTIONAL_FIELDS), F.lit(0)
    )
    found_weight = sum(
        (
            F.when(state[field] == "found", weight).otherwise(0.0)
            for field, weight in CORE_WEIGHTS.items()
        ),
        F.lit(0.0),
    )
    confidence = F.greatest(F.lit(0.0), read / total - OPTIONAL_PENALTY * failed_optional)
    own_warnings = (
        F.col("reading_warnings")
        if "reading_warnings" in cards.columns
        else F.array().cast("array<string>")
    )
    cards = cards.withColumns(
        {
            "failed_fields": in_state("failed"),
            "missing_fields": in_state("missing"),
            "extraction_warnings": F.concat(
                own_warnings,
                F.array_compact(
                    F.array(
                        *[
                            F.col(f"_problem_{field}")
                            for field in ("leadAge", "quantity", "strength", "quantityPerStrip")
                        ]
                    )
                ),
            ),
            "confidence": _thousandths(F.least(F.lit(1.0), confidence)),
            "completeness": _thousandths(F.least(F.lit(1.0), found_weight)),
        }
    )
    return cards.drop(*[f"_problem_{field}" for field in problems])


def states_of_raw_leads(leads: DataFrame) -> DataFrame:
    """Reading outcomes of a table of raw texts: a text is found, a null is missing."""
    texts = {
        "title": "raw_title", "country": "country", "leadAge": "raw_lead_age",
        "category": "category", "quantity": "quantity_raw", "strength": "strength_raw",
        "dosageForm": "dosage_form", "quantityPerStrip": "quantity_per_strip_raw",
        "buys": "buys_raw",
    }
    missing_title = F.col("raw_title").isNull()
    states = {
        field: F.when(F.col(raw).isNotNull(), "found").otherwise("missing")
        for field, raw in texts.items()
    }
    states["title"] = F.when(missing_title, "failed").otherwise("found")
    contact = F.col("mobile_available") | F.col("whatsapp_available") | F.col("email_available")
    states["contact"] = F.when(contact, "found").otherwise("missing")
    states["engagement"] = F.lit("missing")
    leads = leads.withColumns({f"state_{field}": value for field, value in states.items()})
    leads = leads.withColumns(
        {
            **{f"sure_{field}": F.lit(1.0) for field in CORE_WEIGHTS},
            "notes": F.array(F.lit(ENGAGEMENT_NOTE)),
            "reading_warnings": F.array_compact(
                F.array(F.when(missing_title, "title: no readable title in the card"))
            ),
        }
    )
    return with_extraction_info(leads)


def read_cards(cards: DataFrame) -> DataFrame:
    """Raw lead columns and extraction info of extracted cards."""
    cards = add_labels(cards)
    cards = cards.withColumns(
        {
            **{f"_{name}": first_hit(F.col(f"{name}_hits")) for name in ("title", "country", "age")},
            "_crumbs": breadcrumb_trail(F.transform("crumb_hits", lambda hit: hit.text)),
            "_contact": contact_availability(F.col("contact_markers"), F.col("contact_leaves")),
            "_engagement": engagement_counts(F.col("engagement_text")),
            **{f"_{field}": labeled_value(field) for field in FIELD_LABELS},
        }
    )
    cleaned = {
        "title": "_title.text", "country": "_country.text", "age": "_age.text",
        **{field: f"_{field}.value" for field in FIELD_LABELS},
    }
    cards = X.add_collapsed(cards, {f"_clean_{name}": source for name, source in cleaned.items()})
    clean = lambda name: F.col(f"_clean_{name}")

    def resolved(hit: str, present: Column) -> Column:
        return F.when(F.col(hit).isNotNull(), "found").when(present, "failed").otherwise("missing")

    crumbs = F.size("crumb_hits") > 0
    category_state = (
        F.when(crumbs & (F.size("_crumbs.crumbs") > 0), "found")
        .when(crumbs | F.col("crumb_present"), "failed")
        .otherwise("missing")
    )
    texts = {
        "raw_title": clean("title"),
        "country": clean("country"),
        "raw_lead_age": clean("age"),
        "category": F.col("_crumbs.category"),
        "product_category": F.col("_crumbs.product_category"),
        "breadcrumbs": F.col("_crumbs.crumbs"),
        "quantity_raw": clean("quantity"),
        "strength_raw": clean("strength"),
        "dosage_form": clean("dosageForm"),
        "quantity_per_strip_raw": clean("quantityPerStrip"),
        "buys_raw": clean("buys"),
        "buys": X.split_list(F.col("_buys.value")),
        "mobile_available": F.col("_contact.mobile"),
        "whatsapp_available": F.col("_contact.whatsapp"),
        "email_available": F.col("_contact.email"),
        "requirements": F.col("_engagement.requirements").cast("int"),
        "calls": F.col("_engagement.calls").cast("int"),
        "replies": F.col("_engagement.replies").cast("int"),
        "verified": F.col("_engagement.verified"),
    }
    elsewhere = (category_state == "missing") & F.col("crumb_elsewhere")
    sure = lambda field: F.when(F.col(f"_{field}.method") == "inline", 0.9).otherwise(1.0)
    states = {
        "title": F.when(texts["raw_title"].isNotNull(), "found").otherwise("failed"),
        "country": resolved("_country", F.col("country_present")),
        "leadAge": resolved("_age", F.col("age_present")),
        "category": category_state,
        **{field: F.col(f"_{field}.state") for field in FIELD_LABELS},
        "engagement": F.col("_engagement.state"),
        "contact": F.when(F.col("_contact.source") == "none", "missing").otherwise("found"),
    }
    unread = "present in the card but no value could be read"
    problems = {
        "title": F.when(states["title"] == "failed", "title: no readable title in the card"),
        "country": F.when(states["country"] == "failed", f"country: {unread}"),
        "leadAge": F.when(states["leadAge"] == "failed", f"leadAge: {unread}"),
        "category": F.when(
            states["category"] == "failed",
            F.when(crumbs, "category: breadcrumb present but empty").otherwise(f"category: {unread}"),
        ),
        **{
            field: F.when(states[field] == "failed", f"{field}: row present but value empty")
            for field in FIELD_LABELS
        },
    }
    selector_failures = [
        F.when(states["title"] == "failed", "title"),
        F.when(states["country"] == "failed", "country"),
        F.when(states["leadAge"] == "failed", "timestamp"),
        F.when((states["category"] == "failed") & ~crumbs, "categoryBreadcrumb"),
    ]
    read = cards.select(
        *[name for name in ("page_id", "snapshot", "card_no", "failure", "titles", "buttons") if name in cards.columns],
        *[value.alias(name) for name, value in texts.items()],
        *[value.alias(f"state_{field}") for field, value in states.items()],
        F.coalesce("_title.confidence", F.lit(0.0)).alias("sure_title"),
        F.coalesce("_country.confidence", F.lit(0.0)).alias("sure_country"),
        F.coalesce("_age.confidence", F.lit(0.0)).alias("sure_leadAge"),
        F.coalesce(F.get("crumb_hits", F.lit(0)).confidence, F.lit(0.0)).alias("sure_category"),
        sure("quantity").alias("sure_quantity"),
        sure("buys").alias("sure_buys"),
        F.array_compact(
            F.array(
                F.when(elsewhere, "category: page-level breadcrumb unavailable for card"),
                F.col("_engagement.note"),
            )
        ).alias("notes"),
        F.array_compact(F.array(*problems.values())).alias("reading_warnings"),
        F.array_compact(F.array(*selector_failures)).alias("selector_failures"),
    )
    return with_extraction_info(read)


def button_check(expected_title: str = "raw_title") -> Column:
    """``{ok, code, reason}``: exactly one title, the expected one, and one enabled button."""
    titles, buttons = F.col("titles"), F.col("buttons")
    shown = F.lower(X.collapse_spaces(F.get(titles, F.lit(0))))
    wanted = F.lower(X.collapse_spaces(F.col(expected_title)))
    best = F.filter(buttons, lambda b: b.strategy == F.array_min(F.transform(buttons, lambda x: x.strategy)))
    button = F.get(best, F.lit(0))

    def answer(ok: bool, code: str, reason: Column | str | None) -> Column:
        reason = reason if isinstance(reason, Column) else F.lit(reason).cast("string")
        return F.struct(F.lit(ok).alias("ok"), F.lit(code).alias("code"), reason.alias("reason"))

    mismatch, absent = "IDENTITY_MISMATCH", "ACTION_NOT_FOUND"
    count = lambda items: F.size(items).cast("string")
    return (
        F.when(
            F.size(titles) != 1,
            answer(False, mismatch, F.concat(F.lit("expected one lead in the card, found "), count(titles))),
        )
        .when(
            wanted.isNotNull() & ~shown.eqNullSafe(wanted),
            answer(False, mismatch, "the card now shows a different lead"),
        )
        .when(F.size(buttons) == 0, answer(False, absent, "no Contact Buyer button in the card"))
        .when(
            F.size(best) > 1,
            answer(False, mismatch, F.concat(count(best), F.lit(" Contact Buyer buttons in the card"))),
        )
        .when(~button.text.rlike(BUTTON_TEXT), answer(False, absent, "button text is not Contact Buyer"))
        .when(button.disabled, answer(False, absent, "button is disabled"))
        .when(button.strategy == 0, answer(True, "FOUND_REFERENCE", None))
        .otherwise(answer(True, "FOUND_TEXT", None))
    )

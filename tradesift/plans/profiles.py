"""Filter, scoring and action profiles: defaults, strict validation, compiled terms.

A profile is a plain dictionary with the field names of the stored JSON. Tables of profiles are
validated in Spark (``valid_*_profile``); one profile used by a query is compiled on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradesift.functions.lookups import country_rows
from tradesift.functions.text import alias_key_of, words_of

# Default profiles, limits, component order and score tiers.
TEXT_FIELDS = ["title", "productCategory", "category", "buyerProducts"]
FILTER_VERSION = 1
MAX_TERMS = 50
MAX_TERM_LENGTH = 60
MAX_NUMBER = 1_000_000_000


def _terms(*values: str) -> list[dict]:
    return [{"value": value, "enabled": True} for value in values]


DEFAULT_FILTER = {
    "version": FILTER_VERSION,
    "enabled": True,
    "countries": {
        "enabled": True,
        "mode": "ANY",
        "values": _terms("Canada", "United States", "United Kingdom", "Australia", "New Zealand"),
    },
    "keywords": {
        "enabled": True,
        "mode": "ANY",
        "values": _terms("Medicine", "Tablet", "Capsule", "Injection", "Pharmaceutical"),
        "fields": ["title", "productCategory", "category", "buyerProducts"],
    },
    "negativeKeywords": {
        "enabled": True,
        "values": _terms("Retail", "Personal Use", "Home Use"),
        "fields": ["title", "productCategory", "category"],
    },
    "quantity": {"enabled": True, "min": 20, "max": None},
    "contact": {"enabled": True, "mode": "ANY", "mobile": True, "whatsapp": True, "email": True},
    "leadAge": {"enabled": False, "minMinutes": None, "maxMinutes": None},
    "logic": {"mode": "AND"},
}
SCORE_COMPONENTS = [
    "country", "quantity", "mobile", "whatsapp", "email", "keyword", "category", "buyerProducts",
    "leadAge",
]
SCORING_VERSION = 1
MAX_WEIGHT = 100
MAX_FULL_QUANTITY = 1_000_000
DEFAULT_SCORING = {
    "version": SCORING_VERSION,
    "enabled": True,
    "weights": {
        "country": 25, "quantity": 20, "mobile": 10, "whatsapp": 15, "email": 10, "keyword": 8,
        "category": 5, "buyerProducts": 3, "leadAge": 4,
    },
    "thresholds": {"critical": 90, "high": 75, "medium": 50},
    "quantityForFullPoints": 100,
    "allowApproximateLeadAge": False,
}
ACTION_VERSION = 2
MIN_DELAY_MS, MAX_DELAY_MS, MAX_RETRIES = 500, 60_000, 5
DEFAULT_ACTION = {
    "version": ACTION_VERSION,
    "autoClickEnabled": True,
    "delayBetweenActionsMs": 1000,
    "maxRetries": 2,
}


# --- compiled filter ---


@dataclass(frozen=True)
class Keyword:
    label: str
    words: tuple[str, ...]

    @property
    def pattern(self) -> str:
        """Matches in `` word word `` text, each word in any of its regular plural forms."""
        alternatives = ["|".join(word_forms(word)) for word in self.words]
        return " (" + " ".join(f"(?:{forms})" for forms in alternatives) + ") "


@dataclass(frozen=True)
class Country:
    label: str
    code: str | None
    key: str | None


@dataclass(frozen=True)
class CompiledFilter:
    profile: dict
    countries: tuple[Country, ...] = field(default=())
    keywords: tuple[Keyword, ...] = field(default=())
    negatives: tuple[Keyword, ...] = field(default=())
    channels: tuple[str, ...] = field(default=())


def word_forms(word: str) -> list[str]:
    """The word and every word that differs from it by a regular plural, either way."""
    forms = {word, f"{word}s", f"{word}es", word.removesuffix("s"), word.removesuffix("es")}
    if word.endswith("y"):
        forms.add(word[:-1] + "ies")
    if word.endswith("ies"):
        forms.add(word[:-3] + "y")
    return sorted(form for form in forms if form)


def _enabled(group: dict) -> list[str]:
    return [term["value"] for term in group["values"] if term["enabled"]]


def _compiled_keywords(group: dict) -> tuple[Keyword, ...]:
    keywords = [Keyword(value.strip(), tuple(words_of(value))) for value in _enabled(group)]
    return tuple(keyword for keyword in keywords if keyword.words)


def _compiled_countries(group: dict) -> tuple[Country, ...]:
    by_alias = {alias: (code, name_key) for alias, code, _, name_key in country_rows()}
    by_code = {code: (code, name_key) for _, code, _, name_key in country_rows()}
    countries = []
    for label in _enabled(group):
        key = alias_key_of(label)
        text = label.strip()
        is_code = len(text) == 2 and text.isascii() and text.isalpha()
        found = by_alias.get(key) or (by_code.get(text.upper()) if is_code else None)
        countries.append(Country(label, *(found or (None, key))))
    return tuple(countries)


def compile_filter(profile: dict) -> CompiledFilter:
    contact = profile["contact"]
    return CompiledFilter(
        profile=profile,
        countries=_compiled_countries(profile["countries"]),
        keywords=_compiled_keywords(profile["keywords"]),
        negatives=_compiled_keywords(profile["negativeKeywords"]),
        channels=tuple(name for name in ("mobile", "whatsapp", "email") if contact[name]),
    )


# --- validation of profile tables (JSON text in a column) ---


def _is_type(document: Column, path: str, kind: str) -> Column:
    found = F.schema_of_variant(F.try_variant_get(document, path, "variant"))
    return F.coalesce(found.rlike(f"^(?:{kind})"), F.lit(False))


def _is_boolean(document: Column, *paths: str) -> Column:
    checks = [_is_type(document, path, "BOOLEAN") for path in paths]
    return _all(checks)


def _is_object(document: Column, *paths: str) -> Column:
    return _all([_is_type(document, path, "OBJECT") for path in paths])


def _all(checks: list[Column]) -> Column:
    result = F.lit(True)
    for check in checks:
        result = result & F.coalesce(check, F.lit(False))
    return result


NUMBER_KINDS = "BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT"


def _number(document: Column, path: str) -> Column:
    return F.when(
        _is_type(document, path, NUMBER_KINDS), F.try_variant_get(document, path, "double")
    )


def _text(document: Column, path: str) -> Column:
    return F.when(_is_type(document, path, "STRING"), F.try_variant_get(document, path, "string"))


def _is_absent(document: Column, path: str) -> Column:
    found = F.try_variant_get(document, path, "variant")
    return found.isNull() | F.is_variant_null(found)


def _optional_number(document: Column, path: str) -> Column:
    number = _number(document, path)
    return _is_absent(document, path) | number.between(0, MAX_NUMBER)


def _ordered(document: Column, low: str, high: str) -> Column:
    return F.coalesce(_number(document, low) <= _number(document, high), F.lit(True))


def _items(document: Column, path: str) -> Column:
    return F.when(
        _is_type(document, path, "ARRAY"), F.try_variant_get(document, path, "array<variant>")
    )


def _valid_terms(document: Column, path: str) -> Column:
    items = _items(document, path)

    def valid(item: Column) -> Column:
        value = F.trim(F.regexp_replace(F.try_variant_get(item, "$.value", "string"), r"\s+", " "))
        return (
            _is_type(item, "$.value", "STRING")
            & _is_type(item, "$.enabled", "BOOLEAN")
            & F.length(value).between(1, MAX_TERM_LENGTH)
        )

    return (F.size(items) <= MAX_TERMS) & F.forall(items, lambda i: F.coalesce(valid(i), F.lit(False)))


def _valid_fields(document: Column, path: str) -> Column:
    def valid(item: Column) -> Column:
        return F.coalesce(
            _is_type(item, "$", "STRING") & F.try_variant_get(item, "$", "string").isin(TEXT_FIELDS),
            F.lit(False),
        )

    return F.forall(_items(document, path), valid)


def valid_filter_profile(document: Column) -> Column:
    """True for a document that can be used as it is; anything else falls back as a whole."""
    mode = lambda path: _text(document, path).isin("ANY", "ALL")
    return _all(
        [
            document.isNotNull(),
            _number(document, "$.version") == FILTER_VERSION,
            _is_object(
                document, "$.countries", "$.keywords", "$.negativeKeywords", "$.quantity",
                "$.contact", "$.leadAge", "$.logic",
            ),
            _is_boolean(
                document, "$.enabled", "$.countries.enabled", "$.keywords.enabled",
                "$.negativeKeywords.enabled", "$.quantity.enabled", "$.contact.enabled",
                "$.leadAge.enabled", "$.contact.mobile", "$.contact.whatsapp", "$.contact.email",
            ),
            mode("$.countries.mode"), mode("$.keywords.mode"), mode("$.contact.mode"),
            _text(document, "$.logic.mode").isin("AND", "OR"),
            _valid_terms(document, "$.countries.values"),
            _valid_terms(document, "$.keywords.values"),
            _valid_terms(document, "$.negativeKeywords.values"),
            _valid_fields(document, "$.keywords.fields"),
            _valid_fields(document, "$.negativeKeywords.fields"),
            _optional_number(document, "$.quantity.min"),
            _optional_number(document, "$.quantity.max"),
            _optional_number(document, "$.leadAge.minMinutes"),
            _optional_number(document, "$.leadAge.maxMinutes"),
            _ordered(document, "$.quantity.min", "$.quantity.max"),
            _ordered(document, "$.leadAge.minMinutes", "$.leadAge.maxMinutes"),
        ]
    )


def valid_scoring_profile(document: Column) -> Column:
    weight = {name: _number(document, f"$.weights.{name}") for name in SCORE_COMPONENTS}
    total = sum(weight.values(), F.lit(0.0))
    names = F.map_keys(F.try_variant_get(document, "$.weights", "map<string,variant>"))
    bound = {name: _number(document, f"$.thresholds.{name}") for name in ("critical", "high", "medium")}
    full = _number(document, "$.quantityForFullPoints")
    return _all(
        [
            document.isNotNull(),
            _number(document, "$.version") == SCORING_VERSION,
            _is_boolean(document, "$.enabled", "$.allowApproximateLeadAge"),
            _is_object(document, "$.weights", "$.thresholds"),
            *[value.between(0, MAX_WEIGHT) for value in weight.values()],
            F.size(F.array_except(names, F.array(*map(F.lit, SCORE_COMPONENTS)))) == 0,
            total > 0,
            *[value.between(1, 100) & (value == F.floor(value)) for value in bound.values()],
            (bound["critical"] > bound["high"]) & (bound["high"] > bound["medium"]),
            (full > 0) & (full <= MAX_FULL_QUANTITY),
        ]
    )


def valid_action_profile(document: Column) -> Column:
    delay = _number(document, "$.delayBetweenActionsMs")
    retries = _number(document, "$.maxRetries")
    return _all(
        [
            document.isNotNull(),
            _number(document, "$.version") == ACTION_VERSION,
            _is_boolean(document, "$.autoClickEnabled"),
            delay.between(MIN_DELAY_MS, MAX_DELAY_MS) & (delay == F.floor(delay)),
            retries.between(0, MAX_RETRIES) & (retries == F.floor(retries)),
        ]
    )


VALIDATORS = {
    "filter": valid_filter_profile,
    "scoring": valid_scoring_profile,
    "action": valid_action_profile,
}


def parse_document(text: Column) -> Column:
    """JSON text as a variant; null unless the whole text is exactly one value.

    The parser stops after the first value, so the text is read as the only item of a list.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    items = F.try_variant_get(listed, "$", "array<variant>")
    return F.when(F.size(items) == 1, F.get(items, F.lit(0)))


def with_validity(profiles: DataFrame, kind: str, text: str = "profile") -> DataFrame:
    """Adds ``valid``; unreadable JSON is invalid."""
    parsed = profiles.withColumn("_document", parse_document(F.col(text)))
    return parsed.withColumn("valid", VALIDATORS[kind](F.col("_document"))).drop("_document")


def stored_profile(
    owners: DataFrame, current: DataFrame, legacy: DataFrame, kind: str, default: str
) -> DataFrame:
    """Current profile of each owner if valid; the older store counts only where none is stored.

    ``owners(owner)``; the two stores are ``(owner, profile)`` with one row per owner.
    """

    def checked(store: DataFrame, name: str) -> DataFrame:
        valid = with_validity(store, kind)
        return valid.select(
            "owner",
            F.lit(True).alias(f"has_{name}"),
            F.when(F.col("valid"), F.col("profile")).alias(name),
        )

    joined = owners.join(checked(current, "current"), "owner", "left").join(
        checked(legacy, "legacy"), "owner", "left"
    )
    older = F.when(F.col("has_current").isNull(), F.col("legacy"))
    stored = F.coalesce("current", older)
    return joined.select(
        "owner",
        F.coalesce(stored, F.lit(default)).alias("profile"),
        stored.isNull().alias("from_defaults"),
    )

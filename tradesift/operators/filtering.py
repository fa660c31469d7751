"""Leads against a filter profile: every group evaluated, every reason kept.

Reads the columns of ``normalize_leads``. ``add_word_lines`` and the keyword hits come first as
plain columns so that no regular expression runs twice.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradesift.functions import text as X
from tradesift.operators.ordered import exploded
from tradesift.plans.profiles import CompiledFilter, Country, Keyword, compile_filter

WORD_LINES = {
    "title": "_words_title",
    "productCategory": "_words_product_category",
    "category": "_words_category",
    "buyerProducts": "_words_buyer_products",
}
# separates products in a word line; no word contains it, so no phrase spans two products
PRODUCT_BREAK = "|"
# joins the items of a list while their words are read
LIST_BREAK = "\x1f"
# Reason layout and texts.
REASON_TYPE = (
    "struct<type:string,group:string,outcome:string,message:string,value:string,code:string,"
    "expected:string,keyword:string,field:string,matched_text:string,keywords:array<string>,"
    "channels:array<string>,raw:string>"
)
REASON_FIELDS = [part.split(":")[0] for part in REASON_TYPE[7:-1].split(",")]
CHANNELS = {
    "mobile": ("mobile_available", "Mobile"),
    "whatsapp": ("whatsapp_available", "WhatsApp"),
    "email": ("email_available", "Email"),
}


def _line(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _padded(words: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def _text_line(text: str) -> Column:
    """Word line of a text column; ASCII text needs no list of words."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")
    return F.when(X.is_ascii(F.col(text)), _padded(plain)).otherwise(_line(X.words_of_clean(F.col(text))))


def _list_line(items: str) -> Column:
    """Word lines of a list column, joined by ``PRODUCT_BREAK``; lists of ASCII text are read as one text."""
    joined = F.array_join(items, LIST_BREAK, "")
    words = F.trim(F.regexp_replace(F.lower(joined), f"[^a-z0-9{LIST_BREAK}]+", " "))
    plain = F.concat(F.lit(" "), F.regexp_replace(words, f" ?{LIST_BREAK} ?", f" {PRODUCT_BREAK} "), F.lit(" "))
    lines = F.array_join(F.transform(items, lambda item: _line(X.words_of_clean(item))), PRODUCT_BREAK)
    return F.when(F.size(items) == 0, "").when(X.is_ascii(joined) & (F.size(F.split(joined, LIST_BREAK)) == F.size(items)), plain).otherwise(lines)


def add_word_lines(leads: DataFrame) -> DataFrame:
    """One `` word word `` string per searched field."""
    texts = {
        "title": "title_normalized",
        "productCategory": "product_category_text",
        "category": "category_text",
    }
    lines = {WORD_LINES[name]: _text_line(text) for name, text in texts.items()}
    lines[WORD_LINES["buyerProducts"]] = _list_line("buyer_products")
    return leads.withColumns(lines)


def keyword_hit(keyword: Keyword, fields: list[str]) -> Column:
    """``{field, matched_text}`` of the first field in order that holds the phrase."""
    hit = F
    for name in fields:
        line = F.col(WORD_LINES[name])
        hit = hit.when(
            line.rlike(keyword.pattern),
            F.struct(
                F.lit(name).alias("field"),
                F.regexp_extract(line, keyword.pattern, 1).alias("matched_text"),
            ),
        )
    return hit.otherwise(F.lit(None))


ANY_PREFIX = "_any_"


def _hit_field(keyword: Keyword, fields: list[str]) -> Column:
    """The first field in order that holds the phrase, of those that hold one of the keywords."""
    hit = F
    for name in fields:
        hit = hit.when(F.col(f"{ANY_PREFIX}{name}") & F.col(WORD_LINES[name]).rlike(keyword.pattern), F.lit(name))
    return hit.otherwise(F.lit(None))


def _reason(type_: str, group: str, outcome: str, message: Column | str, **fields) -> Column:
    values = {"type": type_, "group": group, "outcome": outcome, "message": message, **fields}
    columns = []
    for name in REASON_FIELDS:
        value = values.get(name)
        columns.append((value if isinstance(value, Column) else F.lit(value)).alias(name))
    return F.struct(*columns).cast(REASON_TYPE)


def _skipped(group: str, what: str) -> Column:
    message = f"{what}: nothing selected, not applied"
    return F.array(_reason("GROUP_EMPTY", group, "info", message))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _text_list(values) -> Column:
    return F.array(*[F.lit(value) for value in values]).cast("array<string>")


def _list_of(items: list[tuple[Column, Column]]) -> Column:
    """The texts whose condition holds, in order, without the lambda of ``array_compact``."""
    if not items:
        return _text_list([])
    return F.concat(*[F.when(holds, F.array(text)).otherwise(_text_list([])) for holds, text in items])


def country_matches(country: Country) -> Column:
    same_key = F.col("country_key").eqNullSafe(F.lit(country.key))
    if country.code is None:
        return same_key
    code = F.col("country_code")
    return F.when(code.isNotNull(), code == country.code).otherwise(same_key)


class FilterColumns:
    """Column expressions of one compiled profile.

    ``hits`` maps a keyword and a field list to the name of a column with its hit.
    """

    def __init__(self, compiled: CompiledFilter, hits: dict):
        self.compiled, self.profile, self.hits = compiled, compiled.profile, hits

    def _hit(self, keyword: Keyword, group: str) -> Column:
        """The field of the hit, or null; ``_matched_text`` is asked for by reasons only."""
        return F.col(self.hits[keyword.words, tuple(self.profile[group]["fields"])])

    def _matched_text(self, keyword: Keyword, group: str) -> Column:
        fields = tuple(self.profile[group]["fields"])
        hit, text = self._hit(keyword, group), F
        for name in fields:
            text = text.when(hit == name, F.regexp_extract(WORD_LINES[name], keyword.pattern, 1))
        return text.otherwise(F.lit(None))

    # each group: (passed, reasons); passed is None for a group that does not take part

    def countries(self) -> tuple[Column | None, Column]:
        group = "countries"
        countries = self.compiled.countries
        if not countries:
            return None, _skipped(group, "Countries")
        name = F.col("country_normalized")
        matches = [country_matches(country) for country in countries]
        any_match, any_mode = _any(matches), self.profile[group]["mode"] == "ANY"
        passed = name.isNotNull() & (any_match if any_mode else _every(matches))
        expected = ", ".join(country.label for country in countries)
        refused = F.concat(F.lit("Country not allowed: "), name)
        if not any_mode:
            impossible = F.concat(F.lit("Country "), name, F.lit(f" cannot match all of: {expected}"))
            refused = F.when(any_match, impossible).otherwise(refused)
        reason = (
            F.when(
                name.isNull(), _reason("COUNTRY_MISSING", group, "fail", "Country unavailable")
            )
            .when(
                passed,
                _reason(
                    "COUNTRY_MATCH", group, "pass", F.concat(F.lit("Country matched: "), name),
                    value=name, code=F.col("country_code"),
                ),
            )
            .otherwise(
                _reason("COUNTRY_MISMATCH", group, "fail", refused, value=name, expected=expected)
            )
        )
        return passed, F.array(reason)

    def _hit_reasons(self, keywords, group: str, type_: str, outcome: str, prefix: str):
        reasons = []
        for keyword in keywords:
            hit = self._hit(keyword, group)
            message = F.concat(F.lit(f"{prefix}: {keyword.label} ("), hit, F.lit(")"))
            reasons.append(
                F.when(
                    hit.isNotNull(),
                    _reason(
                        type_, group, outcome, message,
                        keyword=keyword.label, field=hit, matched_text=self._matched_text(keyword, group),
                    ),
                )
            )
        return reasons

    def _labels(self, keywords, group: str, found: bool) -> Column:
        labels = []
        for keyword in keywords:
            hit = self._hit(keyword, group)
            labels.append((hit.isNotNull() if found else hit.isNull(), F.lit(keyword.label)))
        return _list_of(labels)

    def keywords(self) -> tuple[Column | None, Column, Column]:
        group, keywords = "keywords", self.compiled.keywords
        if not keywords or not self.profile[group]["fields"]:
            return None, _skipped(group, "Keywords"), _text_list([])
        found = [self._hit(keyword, group).isNotNull() for keyword in keywords]
        any_mode = self.profile[group]["mode"] == "ANY"
        passed = _any(found) if any_mode else _every(found)
        missing = self._labels(keywords, group, found=False)
        message = (
            F.lit("No keyword matched")
            if any_mode
            else F.concat(F.lit("Keywords not found: "), F.array_join(missing, ", "))
        )
        mismatch = F.when(
            ~passed, _reason("KEYWORD_MISMATCH", group, "fail", message, keywords=missing)
        )
        matched = self._hit_reasons(keywords, group, "KEYWORD_MATCH", "pass", "Keyword matched")
        reasons = F.array_compact(F.array(*matched, mismatch))
        return passed, reasons, self._labels(keywords, group, found=True)

    def negatives(self) -> tuple[Column | None, Column, Column]:
        group, keywords = "negativeKeywords", self.compiled.negatives
        if not keywords or not self.profile[group]["fields"]:
            return None, _skipped(group, "Excluded keywords"), _text_list([])
        found = _any([self._hit(keyword, group).isNotNull() for keyword in keywords])
        clear = F.when(~found, _reason("NEGATIVE_CLEAR", group, "pass", "No excluded keywords"))
        detected = self._hit_reasons(
            keywords, group, "NEGATIVE_KEYWORD", "fail", "Excluded keyword detected"
        )
        reasons = F.array_compact(F.array(*detected, clear))
        return ~found, reasons, self._labels(keywords, group, found=True)

    def quantity(self) -> tuple[Column, Column]:
        group = "quantity"
        low, high = self.profile[group]["min"], self.profile[group]["max"]
        value, raw, unit = F.col("quantity_value"), F.col("quantity_raw"), F.col("quantity_unit")
        number = X.number_text(value)
        missing = F.when(raw.isNull(), "Quantity unavailable").otherwise(
            F.concat(F.lit("Quantity not a single number: "), raw)
        )
        reason = F.when(
            value.isNull(), _reason("QUANTITY_MISSING", group, "fail", missing, raw=raw)
        )
        passed = value.isNotNull()
        bounds = []
        if low is not None:
            shown = _plain_number(low)
            passed = passed & (value >= low)
            bounds.append(f"≥ {shown}")
            message = F.concat(F.lit("Quantity "), number, F.lit(f" < minimum {shown}"))
            reason = reason.when(
                value < low,
                _reason("QUANTITY_TOO_LOW", group, "fail", message, value=number, expected=shown),
            )
        if high is not None:
            shown = _plain_number(high)
            passed = passed & (value <= high)
            bounds.append(f"≤ {shown}")
            message = F.concat(F.lit("Quantity "), number, F.lit(f" > maximum {shown}"))
            reason = reason.when(
                value > high,
                _reason("QUANTITY_TOO_HIGH", group, "fail", message, value=number, expected=shown),
            )
        message = F.concat_ws(
            " ", F.lit("Quantity"), number, unit, *([F.lit(", ".join(bounds))] if bounds else [])
        )
        reason = reason.otherwise(_reason("QUANTITY_PASS", group, "pass", message, value=number))
        return F.coalesce(passed, F.lit(False)), F.array(reason)

    def contact(self) -> tuple[Column | None, Column]:
        group, channels = "contact", self.compiled.channels
        if not channels:
            return None, _skipped(group, "Contact")
        flags = {name: F.col(CHANNELS[name][0]) for name in channels}

        def names(available: bool, labels: bool) -> Column:
            picked = [
                F.when(flag if available else ~flag, F.lit(CHANNELS[name][1] if labels else name))
                for name, flag in flags.items()
            ]
            return F.array_compact(F.array(*picked))

        any_mode = self.profile[group]["mode"] == "ANY"
        passed = _any(list(flags.values())) if any_mode else _every(list(flags.values()))
        have = F.concat(
            F.lit("Contact: "), F.array_join(names(True, True), ", "), F.lit(" available")
        )
        lacking = F.array_join(names(False, True), ", ")
        start = "Contact requirement failed: "
        failed = (
            F.concat(F.lit(f"{start}none of "), lacking, F.lit(" available"))
            if any_mode
            else F.concat(F.lit(start), lacking, F.lit(" unavailable"))
        )
        reason = F.when(
            passed, _reason("CONTACT_PASS", group, "pass", have, channels=names(True, False))
        ).otherwise(_reason("CONTACT_MISSING", group, "fail", failed, channels=names(False, False)))
        return passed, F.array(reason)

    def lead_age(self) -> tuple[Column, Column]:
        group = "leadAge"
        low, high = self.profile[group]["minMinutes"], self.profile[group]["maxMinutes"]
        minutes, raw = F.col("age_minutes"), F.col("raw_lead_age")
        number = X.number_text(minutes)
        missing = F.when(raw.isNull(), "Lead age unavailable").otherwise(
            F.concat(F.lit("Lead age not convertible: "), raw)
        )
        passed = minutes.isNotNull()
        reason = F.when(minutes.isNull(), _reason("LEAD_AGE_MISSING", group, "fail", missing, raw=raw))
        for bound, type_, relation, beyond in (
            (high, "LEAD_AGE_TOO_OLD", "> maximum", lambda limit: minutes > limit),
            (low, "LEAD_AGE_TOO_NEW", "< minimum", lambda limit: minutes < limit),
        ):
            if bound is None:
                continue
            shown = _plain_number(bound)
            passed = passed & ~beyond(bound)
            message = F.concat(
                F.lit("Lead age "), number, F.lit(f" min {relation} {shown} min")
            )
            reason = reason.when(
                beyond(bound), _reason(type_, group, "fail", message, value=number, expected=shown)
            )
        message = F.concat(F.lit("Lead age "), number, F.lit(" min"))
        reason = reason.otherwise(_reason("LEAD_AGE_PASS", group, "pass", message, value=number))
        approximate = F.when(
            minutes.isNotNull() & F.col("age_approximate"),
            _reason(
                "LEAD_AGE_APPROXIMATE", group, "info",
                F.trim(F.concat(F.lit("Lead age is approximate: "), F.coalesce(raw, F.lit("")))),
            ),
        )
        return F.coalesce(passed, F.lit(False)), F.array_compact(F.array(approximate, reason))

    def evaluation(self) -> dict[str, Column]:
        """Columns of the whole evaluation."""
        profile = self.profile
        constant = {
            "logic": F.lit(profile["logic"]["mode"]),
            "config_version": F.lit(profile["version"]),
        }
        if not profile["enabled"]:
            off = _reason("FILTER_DISABLED", "filters", "info", "Filters are off: every lead matches")
            lists = ["matched_keywords", "matched_countries", "negative_keywords", "failed_groups"]
            return {
                "passed": F.lit(True),
                "reasons": F.array(off),
                **{name: _text_list([]) for name in lists},
                **constant,
            }
        groups, matched, detected = [], _text_list([]), _text_list([])
        matched_countries = _text_list([])
        if profile["countries"]["enabled"]:
            passed, reasons = self.countries()
            groups.append(("countries", passed, reasons))
            if passed is not None:
                matched_countries = _list_of([(passed, F.col("country_normalized"))])
        if profile["keywords"]["enabled"]:
            passed, reasons, matched = self.keywords()
            groups.append(("keywords", passed, reasons))
        for name, part in (
            ("quantity", self.quantity), ("contact", self.contact), ("leadAge", self.lead_age)
        ):
            if profile[name]["enabled"]:
                groups.append((name, *part()))
        applied = [passed for _, passed, _ in groups if passed is not None]
        combine = _every if profile["logic"]["mode"] == "AND" else _any
        passed = combine(applied) if applied else F.lit(True)
        if profile["negativeKeywords"]["enabled"]:
            clear, reasons, detected = self.negatives()
            groups.append(("negativeKeywords", clear, reasons))
            if clear is not None:
                passed = passed & clear
        failed = [(~ok, F.lit(name)) for name, ok, _ in groups if ok is not None]
        empty = F.array().cast(f"array<{REASON_TYPE}>")
        return {
            "passed": passed,
            "reasons": F.concat(empty, *[reasons for _, _, reasons in groups]),
            "matched_keywords": matched,
            "matched_countries": matched_countries,
            "negative_keywords": detected,
            "failed_groups": _list_of(failed),
            **constant,
        }


def _plain_number(number: float) -> str:
    return str(int(number)) if float(number).is_integer() else str(number)


def add_keyword_hits(leads: DataFrame, filters: list[CompiledFilter]) -> tuple[DataFrame, dict]:
    """One column per distinct keyword and field list of all profiles, each searched once."""
    wanted: dict[tuple, Keyword] = {}
    for compiled in filters:
        for group, keywords in (
            ("keywords", compiled.keywords), ("negativeKeywords", compiled.negatives)
        ):
            fields = tuple(compiled.profile[group]["fields"])
            if fields and compiled.profile[group]["enabled"] and compiled.profile["enabled"]:
                wanted.update({(keyword.words, fields): keyword for keyword in keywords})
    names = {key: f"_hit_{number}" for number, key in enumerate(wanted)}
    # most lines hold none of the keywords: one search for all of them says so
    flags = {}
    for name, line in WORD_LINES.items():
        phrases = dict.fromkeys(keyword.pattern[2:-2] for (_, fields), keyword in wanted.items() if name in fields)
        if phrases:
            flags[f"{ANY_PREFIX}{name}"] = F.col(line).rlike(" (?:" + "|".join(phrases) + ") ")
    hits = {names[key]: _hit_field(keyword, list(key[1])) for key, keyword in wanted.items()}
    return add_word_lines(leads).withColumns(flags).withColumns(hits).drop(*flags), names


def _without_helpers(leads: DataFrame, hits: dict) -> DataFrame:
    return leads.drop(*hits.values(), *WORD_LINES.values())


def evaluate_filter(leads: DataFrame, profile: dict) -> DataFrame:
    """Adds status, passed, reasons, matched and failed lists of one profile."""
    compiled = compile_filter(profile)
    leads, hits = add_keyword_hits(leads, [compiled])
    evaluated = leads.withColumns(FilterColumns(compiled, hits).evaluation())
    status = F.when(F.col("passed"), "MATCHED").otherwise("REJECTED")
    return _without_helpers(evaluated.withColumn("status", status), hits)


GROUP_METHODS = {
    "countries": "countries",
    "keywords": "keywords",
    "quantity": "quantity",
    "contact": "contact",
    "leadAge": "lead_age",
    "negativeKeywords": "negatives",
}


def evaluate_profiles(leads: DataFrame, profiles: dict[str, dict], keep: list[str]) -> DataFrame:
    """One row per lead and profile, from one pass over the leads.

    Every distinct keyword is searched once per lead whatever number of profiles use it; the
    verdicts of all profiles are one array that is exploded, so nothing is joined.
    """
    compiled = {name: compile_filter(profile) for name, profile in profiles.items()}
    leads, hits = add_keyword_hits(leads, list(compiled.values()))
    # one set of columns per distinct group, however many profiles share it
    shared: dict[str, dict[str, Column]] = {}
    names: dict[str, str] = {}
    for one in compiled.values():
        for group, method in GROUP_METHODS.items():
            text = json.dumps([group, one.profile[group]], sort_keys=True)
            if one.profile["enabled"] and one.profile[group]["enabled"] and text not in names:
                names[text] = f"_group_{len(names)}"
                passed, _, *found = getattr(FilterColumns(one, hits), method)()
                shared[names[text]] = {"passed": passed, "found": found[0] if found else None}
    columns = {}
    for name, part in shared.items():
        columns |= {f"{name}_{key}": value for key, value in part.items() if value is not None}
    leads = leads.withColumns(columns)
    verdicts = []
    for name, one in compiled.items():
        profile = one.profile
        parts = {}
        for group in GROUP_METHODS:
            column = names.get(json.dumps([group, profile[group]], sort_keys=True))
            if column and profile["enabled"] and shared[column]["passed"] is not None:
                parts[group] = column
        ok = {group: F.col(f"{column}_passed") for group, column in parts.items()}
        positives = [passed for group, passed in ok.items() if group != "negativeKeywords"]
        combine = _every if profile["logic"]["mode"] == "AND" else _any
        passed = combine(positives) if positives else F.lit(True)
        passed = passed & ok.get("negativeKeywords", F.lit(True))
        found = lambda group: (
            F.col(f"{parts[group]}_found") if group in parts else _text_list([])
        )
        failed = [(~passes, F.lit(group)) for group, passes in ok.items()]
        verdicts.append(
            F.struct(
                F.lit(name).alias("profile_id"),
                passed.alias("passed"),
                found("keywords").alias("matched_keywords"),
                found("negativeKeywords").alias("negative_keywords"),
                _list_of(failed).alias("failed_groups"),
            )
        )
    pairs = exploded(leads, F.array(*verdicts), "verdict", tuple(keep))
    status = F.when(F.col("verdict.passed"), "MATCHED").otherwise("REJECTED").alias("status")
    return pairs.select(*keep, "verdict.*", status)


def explain_evaluation(limit: int = 4) -> Column:
    """Short text: what passed for a match, what failed for a rejection."""
    wanted = F.when(F.col("passed"), "pass").otherwise("fail")
    parts = F.transform(
        F.filter(
            "reasons", lambda r: (r.outcome == wanted) & (r.type != "NEGATIVE_CLEAR")
        ),
        lambda r: r.message,
    )

    def shorten(messages: Column) -> Column:
        rest = F.concat(F.lit("+"), (F.size(messages) - limit).cast("string"), F.lit(" more"))
        extra = F.when(F.size(messages) > limit, F.array(rest)).otherwise(
            F.array().cast("array<string>")
        )
        return F.array_join(F.concat(F.slice(messages, 1, limit), extra), "; ")

    disabled = F.exists("reasons", lambda r: r.type == "FILTER_DISABLED")
    return F.when(disabled, F.lit("filters are off")).otherwise(X.let(parts, shorten))

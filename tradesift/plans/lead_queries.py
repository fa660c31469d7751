"""Queries over the lead table: normalization, filter, score, verdict statistics."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.functions import text as X
from tradesift.functions.text import words_of
from tradesift.operators import (
    cards,
    filtering,
    identity,
    isolation,
    logs,
    normalize,
    profile_table,
    scoring,
    statistics,
    verdicts,
)
from tradesift.operators.ordered import exploded, filter_computed
from tradesift.plans import profiles
from tradesift.plans.profiles import DEFAULT_FILTER, DEFAULT_SCORING, word_forms
from tradesift.sources import tables


def joined(column: str, separator: str = "; "):
    return F.array_join(column, separator).alias(column)


def normalized(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.normalize_leads(tables.leads_raw(spark, folder))


def evaluated(spark: SparkSession, folder: str, profile: dict = DEFAULT_FILTER) -> DataFrame:
    return filtering.evaluate_filter(normalized(spark, folder), profile)


def scored(spark: SparkSession, folder: str, profile: dict = DEFAULT_SCORING) -> DataFrame:
    return scoring.score_leads(evaluated(spark, folder), profile)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Leads that match the default profile, with score and priority."""
    return filter_computed(scored(spark, folder), F.col("passed")).select(
        "row_id", "title_normalized", "country_normalized", "quantity_value", "score", "priority"
    )


def n1_display_text(spark, folder):
    leads = tables.leads_raw(spark, folder)
    return leads.select("row_id", X.display_text(F.col("raw_title")).alias("title_display"))


def n2_comparison_text(spark, folder):
    leads = tables.leads_raw(spark, folder)
    return leads.select("row_id", X.comparison_text(F.col("raw_title")).alias("title_comparison"))


def n3_tokens(spark, folder):
    leads = tables.leads_raw(spark, folder)
    tokens = X.edge_trimmed_tokens(F.col("raw_title"))
    return leads.select("row_id", F.array_join(tokens, "|").alias("tokens"))


def n4_alias_key(spark, folder):
    leads = tables.leads_raw(spark, folder)
    return leads.select("row_id", X.alias_key(F.col("country")).alias("country_key"))


def n5_country(spark, folder):
    leads = normalize.with_country(tables.leads_raw(spark, folder))
    return leads.select("row_id", "country_normalized", "country_code", "country_warning")


def n6_country_by_code(spark, folder):
    nations = tables.read_table(spark, folder, "nation")
    codes = nations.select("n_nationkey", F.lower(F.left("n_name", F.lit(2))).alias("typed_code"))
    return normalize.with_country_by_code(codes, "typed_code")


def n7_measure(spark, folder):
    leads = tables.leads_raw(spark, folder)
    leads = normalize.with_measure(leads, "quantity", "quantity_raw", "quantity")
    return leads.select("row_id", "quantity_value", "quantity_unit", "quantity_warning")


def n8_unit(spark, folder):
    leads = tables.leads_raw(spark, folder)
    leads = normalize.with_measure(leads, "quantity", "quantity_raw", "quantity")
    return leads.groupBy("quantity_unit", "quantity_normalized_unit").agg(F.count("*").alias("n"))


def n9_strength(spark, folder):
    leads = normalize.with_strength(tables.leads_raw(spark, folder))
    return leads.select(
        "row_id", "strength_value", "strength_unit", "strength_secondary_value",
        "strength_secondary_unit", "strength_complex", joined("strength_warnings"),
    )


def n10_strength_unit(spark, folder):
    leads = normalize.with_strength(tables.leads_raw(spark, folder))
    return leads.groupBy("strength_raw", "strength_unit").agg(F.count("*").alias("n"))


def n11_dosage_form(spark, folder):
    leads = normalize.with_dosage_form(tables.leads_raw(spark, folder))
    return leads.select("row_id", "dosage_form_normalized", "dosage_form_warning")


def n12_buyer_products(spark, folder):
    leads = normalize.with_optional_columns(tables.leads_raw(spark, folder))
    leads = normalize.with_buyer_products(leads)
    return leads.select(
        "row_id",
        joined("buyer_products", "|"),
        joined("buyer_products_normalized", "|"),
        "buys_warning",
    )


def n13_contact_flags(spark, folder):
    leads = normalize.with_contact_flags(tables.leads_raw(spark, folder))
    return leads.select("row_id", "mobile_available", "whatsapp_available", "email_available")


def n14_lead_age(spark, folder):
    leads = normalize.with_lead_age(tables.leads_raw(spark, folder))
    return leads.select("row_id", "age_minutes", "age_approximate", "age_warning")


def n15_normalized_lead(spark, folder):
    leads = normalize.normalized_record(normalized(spark, folder), F.col("detected_at"))
    return leads.select(
        "row_id",
        F.col("title.normalized").alias("title"),
        F.col("country.code").alias("country_code"),
        F.col("quantity.value").alias("quantity_value"),
        F.col("quantity.normalized_unit").alias("quantity_unit"),
        F.col("strength.value").alias("strength_value"),
        F.col("dosage_form.normalized").alias("dosage_form"),
        F.array_join("buys.normalized_products", "|").alias("products"),
        F.col("lead_age.minutes").alias("age_minutes"),
        F.array_join("normalization.warnings", "; ").alias("warnings"),
    )


def f1_words(spark, folder):
    leads = tables.leads_raw(spark, folder)
    return leads.select("row_id", F.array_join(X.words(F.col("raw_title")), " ").alias("words"))


STRICT_FILTER = {
    **DEFAULT_FILTER,
    "countries": {
        "enabled": True,
        "mode": "ALL",
        "values": [{"value": v, "enabled": True} for v in ("United States", "usa", "US")],
    },
    "keywords": {
        "enabled": True,
        "mode": "ALL",
        "values": [{"value": v, "enabled": True} for v in ("Tablet", "paracetamol tablets")],
        "fields": ["title", "buyerProducts"],
    },
    "negativeKeywords": {
        "enabled": True,
        "values": [{"value": v, "enabled": True} for v in ("home use", "cream")],
        "fields": ["title", "buyerProducts"],
    },
    "quantity": {"enabled": True, "min": 30, "max": 1020},
    "contact": {"enabled": True, "mode": "ALL", "mobile": True, "whatsapp": False, "email": True},
    "leadAge": {"enabled": True, "minMinutes": 10, "maxMinutes": 5000},
    "logic": {"mode": "OR"},
}
LENIENT_SCORING = {
    **DEFAULT_SCORING,
    "weights": {**DEFAULT_SCORING["weights"], "leadAge": 10, "category": 0, "quantity": 30},
    "thresholds": {"critical": 80, "high": 60, "medium": 40},
    "quantityForFullPoints": 500,
    "allowApproximateLeadAge": True,
}


def f2_same_word(spark, folder):
    leads = tables.leads_raw(spark, folder)
    found = leads.select(F.explode(X.words(F.col("raw_title"))).alias("word")).distinct()
    terms = ["tablet", "boxes", "medicine", "remedies", "injections", "dry"]
    same = [F.col("word").isin(word_forms(term)).alias(f"same_{term}") for term in terms]
    return found.select("word", *same)


def f3_phrase(spark, folder):
    leads = filtering.add_word_lines(normalized(spark, folder))
    columns = []
    for name, value in (("use", "personal uses"), ("tablet", "tablet")):
        pattern = profiles.Keyword(value, tuple(words_of(value))).pattern
        line = F.col("_words_title")
        before = F.regexp_extract(line, "^(.*?)" + pattern, 1)
        index = F.size(F.regexp_extract_all(before, F.lit(X.WORD), F.lit(0)))
        columns.append(F.when(line.rlike(pattern), index).otherwise(-1).alias(f"index_{name}"))
        columns.append(F.regexp_extract(line, pattern, 1).alias(f"text_{name}"))
    return leads.select("row_id", *columns)


def f4_field_search(spark, folder):
    leads = filtering.add_word_lines(normalized(spark, folder))
    hits = {
        value: filtering.keyword_hit(profiles.Keyword(value, tuple(words_of(value))), fields)
        for value, fields in (
            ("tablet", ["title", "productCategory", "category", "buyerProducts"]),
            ("home use", ["buyerProducts", "title"]),
        )
    }
    leads = leads.withColumns({f"_{value[:4]}": hit for value, hit in hits.items()})
    return leads.select(
        "row_id",
        F.col("_tabl.field").alias("tablet_field"),
        F.col("_tabl.matched_text").alias("tablet_text"),
        F.col("_home.field").alias("home_field"),
    )


def f5_compiled_terms(spark, folder):
    """Country terms of many profiles: alias first, then a two-letter code."""
    nations = tables.read_table(spark, folder, "nation")
    labels = nations.select(
        "n_nationkey", F.explode(F.array("n_name", F.left("n_name", F.lit(2)))).alias("label")
    )
    return normalize.with_compiled_countries(labels, "label").select(
        "n_nationkey", "label", "term_code", "term_key"
    )


def _group(spark, folder, part: str) -> DataFrame:
    """Result and reason texts of one group under the default and the strict profile."""
    compiled = [profiles.compile_filter(profile) for profile in (DEFAULT_FILTER, STRICT_FILTER)]
    leads, hits = filtering.add_keyword_hits(normalized(spark, folder), compiled)
    columns = []
    for name, one in zip(("default", "strict"), compiled):
        passed, reasons, *_ = getattr(filtering.FilterColumns(one, hits), part)()
        messages = F.array_join(F.transform(reasons, lambda reason: reason.message), "; ")
        columns += [passed.alias(f"{name}_passed"), messages.alias(f"{name}_reasons")]
    return leads.select("row_id", *columns)


def f6_country_group(spark, folder):
    return _group(spark, folder, "countries")


def f7_keyword_group(spark, folder):
    return _group(spark, folder, "keywords")


def f8_excluded_keywords(spark, folder):
    return _group(spark, folder, "negatives")


def f9_quantity_group(spark, folder):
    return _group(spark, folder, "quantity")


def f10_contact_group(spark, folder):
    return _group(spark, folder, "contact")


def f11_lead_age_group(spark, folder):
    return _group(spark, folder, "lead_age")


def f12_combine(spark, folder):
    strict = evaluated(spark, folder, STRICT_FILTER).withColumn("strict_passed", F.col("passed"))
    both = filtering.evaluate_filter(
        strict.select(*[c for c in strict.columns if c not in EVALUATION], "strict_passed"),
        DEFAULT_FILTER,
    )
    return both.select("row_id", "passed", "strict_passed")


def f13_master_switch(spark, folder):
    off = evaluated(spark, folder, {**DEFAULT_FILTER, "enabled": False})
    return off.select(
        "row_id", "status", F.get("reasons", F.lit(0)).type.alias("reason"),
        (F.size("matched_keywords") + F.size("failed_groups")).alias("listed"),
    )


def f14_evaluation(spark, folder):
    return evaluated(spark, folder).select(
        "row_id",
        "status",
        F.array_join(F.transform("reasons", lambda r: r.message), "; ").alias("reasons"),
        joined("matched_keywords", ","),
        joined("matched_countries", ","),
        joined("negative_keywords", ","),
        joined("failed_groups", ","),
    )


def f15_explanation(spark, folder):
    return evaluated(spark, folder).select(
        "row_id", filtering.explain_evaluation(2).alias("explanation")
    )


def profile_texts(spark, folder) -> DataFrame:
    """A filter profile in JSON for every customer; some break one rule each."""
    people = tables.read_table(spark, folder, "customer")
    k = F.col("c_custkey")
    pick = lambda cond, yes, no: F.when(cond, yes).otherwise(no)
    text = F.format_string(
        '{"version":%s,"enabled":%s,"countries":{"enabled":true,"mode":"%s","values":[{"value":"%s",'
        '"enabled":true}]},"keywords":{"enabled":true,"mode":"ALL","values":[],"fields":["%s"]},'
        '"negativeKeywords":{"enabled":false,"values":[],"fields":[]},"quantity":{"enabled":true,'
        '"min":%s,"max":%s},"contact":{"enabled":true,"mode":"ANY","mobile":true,"whatsapp":false,'
        '"email":true},"leadAge":{"enabled":false,"minMinutes":null,"maxMinutes":null},'
        '"logic":{"mode":"AND"}}%s',
        pick(k % 11 == 0, "2", "1"),
        pick(k % 13 == 0, '"true"', "true"),
        pick(k % 7 == 0, "SOME", "ANY"),
        pick(k % 17 == 0, F.repeat(F.lit("x"), 61), F.col("c_name")),
        pick(k % 19 == 0, "subject", "title"),
        (k % 50).cast("string"),
        pick(k % 3 == 0, (k % 40).cast("string"), F.lit("null")),
        pick(k % 23 == 0, "}", ""),
    )
    return people.select("c_custkey", text.alias("profile"))


def f16_profile_validation(spark, folder):
    return profiles.with_validity(profile_texts(spark, folder), "filter").select("c_custkey", "valid")


def f18_profile_grid(spark, folder):
    """Twenty profiles against every lead; counted so that the check stays small."""
    grid = {
        f"p{number:02d}": {
            **DEFAULT_FILTER,
            "quantity": {"enabled": True, "min": 5 * number, "max": None},
            "logic": {"mode": "AND" if number % 2 == 0 else "OR"},
        }
        for number in range(20)
    }
    pairs = filtering.evaluate_profiles(normalized(spark, folder), grid, ["row_id"])
    return pairs.groupBy("profile_id", "status").agg(F.count("*").alias("n"))


def seller_profiles(spark, folder) -> DataFrame:
    """Two profiles of each supplier as JSON; every seventh supplier's first one has an unknown version."""
    k = F.col("s_suppkey")
    terms = lambda *values: json.dumps([{"value": value, "enabled": True} for value in values])
    words = (
        F.when(k % 3 == 0, terms("Medicine", "Tablet", "Capsule", "Injection", "Pharmaceutical"))
        .when(k % 3 == 1, terms("Large Bolt", "red gizmos"))
        .otherwise(terms("Medicine", "Pharmaceutical"))
    )
    document = (
        '{"version":%s,"enabled":%s,"countries":{"enabled":true,"mode":"ANY","values":%s},"keywords":{"enabled":true,"mode":"%s","values":%s,'
        '"fields":["title","productCategory","category","buyerProducts"]},"negativeKeywords":{"enabled":true,"values":%s,'
        '"fields":["title","productCategory","category"]},"quantity":{"enabled":true,"min":%s,"max":null},"contact":{"enabled":true,'
        '"mode":"%s","mobile":true,"whatsapp":true,"email":%s},"leadAge":{"enabled":false,"minMinutes":null,"maxMinutes":null},"logic":{"mode":"%s"}}'
    )
    first = F.format_string(
        document, F.when(k % 7 == 0, "9").otherwise("1"), F.lit("true"), F.lit(terms("Canada", "USA", "GB", "Australia", "New Zealand")),
        F.when(k % 3 == 2, "ALL").otherwise("ANY"), words, F.lit(terms("Retail", "Personal Use", "Home Use")),
        (k % 20 * 5).cast("string"), F.lit("ANY"), F.lit("true"), F.when(k % 2 == 0, "AND").otherwise("OR"),
    )
    second = F.format_string(
        document, F.lit("1"), F.when(k % 5 == 0, "false").otherwise("true"), F.lit(terms("Canada", "Atlantis")), F.lit("ANY"), F.lit(terms()),
        F.lit(terms()), F.lit("10"), F.lit("ALL"), F.lit("false"), F.lit("AND"),
    )
    both = F.explode(F.array(F.struct(F.lit("a").alias("no"), first.alias("profile")), F.struct(F.lit("b").alias("no"), second.alias("profile"))))
    rows = tables.read_table(spark, folder, "supplier").select(k.alias("seller_id"), both.alias("x"))
    return rows.select(F.concat_ws("-", "seller_id", "x.no").alias("profile_id"), "seller_id", "x.profile")


def f18_profile_table(spark, folder):
    """Every lead against the profiles of its seller, from a table."""
    leads = normalized(spark, folder).withColumn("seller_id", F.split_part("card_id", F.lit("_"), F.lit(2)).cast("long"))
    pairs = profile_table.evaluate_profile_table(leads, seller_profiles(spark, folder), ["row_id"])
    return pairs.select("row_id", "profile_id", "valid", "status", F.array_join("failed_groups", ",").alias("failed_groups"))


EVALUATION = [
    "passed", "reasons", "matched_keywords", "matched_countries", "negative_keywords",
    "failed_groups", "logic", "config_version", "status",
]


def _part(spark, folder, part) -> DataFrame:
    fraction, message = part
    return evaluated(spark, folder).select(
        "row_id", fraction.cast("double").alias("fraction"), message.alias("message")
    )


def c1_country(spark, folder):
    return _part(spark, folder, scoring.country_part())


def c2_quantity(spark, folder):
    return _part(spark, folder, scoring.quantity_part(100))


def c3_contact(spark, folder):
    parts = {
        name: scoring.flag_part(f"{name}_available", name)[0] for name in ("mobile", "whatsapp", "email")
    }
    leads = normalize.with_contact_flags(tables.leads_raw(spark, folder))
    return leads.select("row_id", *[value.alias(name) for name, value in parts.items()])


def c4_keyword(spark, folder):
    return _part(spark, folder, scoring.keyword_part())


def c5_category(spark, folder):
    return _part(spark, folder, scoring.category_part())


def c6_buyer_products(spark, folder):
    return _part(spark, folder, scoring.products_part())


def c7_lead_age(spark, folder):
    return _part(spark, folder, scoring.age_part(False))


def c8_score(spark, folder):
    return scored(spark, folder).select("row_id", "score", "raw_score", "max_raw_score", "priority")


def c9_priority(spark, folder):
    return scored(spark, folder, LENIENT_SCORING).select("row_id", "score", "priority")


def c10_states(spark, folder):
    off = scored(spark, folder, {**DEFAULT_SCORING, "enabled": False})
    return off.groupBy("kind", "priority", "eligible").agg(
        F.count("*").alias("n"), F.count("score").alias("scores")
    )


def c11_score_reasons(spark, folder):
    lines = F.transform(
        "score_reasons", lambda r: F.concat(r.type, F.lit("="), F.round(r.points * 100).cast("int"))
    )
    return scored(spark, folder).select("row_id", F.array_join(lines, ",").alias("parts"))


def c12_explanation(spark, folder):
    return scored(spark, folder).select("row_id", scoring.explain_score().alias("explanation"))


def c13_scoring_validation(spark, folder):
    people = tables.read_table(spark, folder, "customer")
    k = F.col("c_custkey")
    text = F.format_string(
        '{"version":1,"enabled":true,"weights":{"country":%s,"quantity":20,"mobile":10,"whatsapp":15,'
        '"email":10,"keyword":8,"category":5,"buyerProducts":3,"leadAge":%s},"thresholds":{"critical":%s,'
        '"high":75,"medium":50},"quantityForFullPoints":%s,"allowApproximateLeadAge":false}',
        (k % 120).cast("string"),
        F.when(k % 5 == 0, '"4"').otherwise("4"),
        F.when(k % 3 == 0, "90.5").when(k % 7 == 0, "75").otherwise("90"),
        (k % 4).cast("string"),
    )
    documents = people.select("c_custkey", text.alias("profile"))
    return profiles.with_validity(documents, "scoring").select("c_custkey", "valid")


def c15_scoring_error(spark, folder):
    """A lead without a usable amount counts as a scoring error and stays, as UNSCORED."""
    leads = scored(spark, folder).withColumn(
        "priority", F.when(F.col("quantity_value").isNotNull(), F.col("priority"))
    )
    kept = scoring.unscored_on_error(leads)
    return kept.groupBy("priority").agg(F.count("*").alias("n"))


def captured_payloads(spark, folder) -> DataFrame:
    """Lead rows as the JSON text of a capture: some break off, some have another type, some an amount beyond all numbers."""
    leads = tables.leads_raw(spark, folder)
    order = F.split_part("row_id", F.lit("-"), F.lit(1)).cast("long")
    huge = F.when(order % 17 == 0, F.concat(F.repeat(F.lit("9"), 400), F.lit(" Strip"))).otherwise(F.col("quantity_raw"))
    text = F.to_json(F.struct(*[c for c in leads.columns if c not in ("row_id", "card_id", "detected_at", "quantity_raw")], huge.alias("quantity_raw")))
    broken = F.when(order % 13 == 0, F.substring(text, 1, 40)).when(order % 19 == 0, F.regexp_replace(text, '"mobile_available":(true|false)', '"mobile_available":"perhaps"'))
    return leads.select("row_id", F.when(order % 23 != 0, F.coalesce(broken, text)).alias("payload"))


def n16_error_isolation(spark, folder):
    rows = isolation.normalize_payloads(captured_payloads(spark, folder))
    kept = F.when(F.col("failed_step").isNotNull(), F.coalesce(F.length("payload"), F.lit(0)) > 0)
    return rows.select("row_id", "failed_step", "error", kept.alias("has_payload"), "title_normalized", "quantity_value", "country_code")


def n16_failure_counts(spark, folder):
    return isolation.failure_counts(isolation.normalize_payloads(captured_payloads(spark, folder)))


# --- verdict state ---


def with_session(leads: DataFrame) -> DataFrame:
    month = F.date_format("detected_at", "yyyy-MM")
    return leads.withColumn("session_id", F.concat(F.lit("s"), month))


def identified(spark, folder) -> DataFrame:
    rows = with_session(normalize.with_optional_columns(tables.leads_raw(spark, folder)))
    rows = normalize.prepare_texts(rows, normalize.ALL_COMPOSED, normalize.PLAIN_TEXTS)
    rows = identity.with_identity(rows, keep_prepared=True)
    key = F.left(F.sha2("canonical_key", 256), F.lit(14))
    rows = rows.withColumn("lead_id", F.concat(F.lit("lead_"), key))
    return filter_computed(rows, F.col("canonical_key").isNotNull())


def judged(spark, folder) -> DataFrame:
    """Every rendering with its lead, verdict and score."""
    leads = normalize.normalize_leads(identified(spark, folder))
    return scoring.score_leads(filtering.evaluate_filter(leads, DEFAULT_FILTER), DEFAULT_SCORING)


def v1_current_verdict(spark, folder):
    narrow = judged(spark, folder).select("lead_id", "row_id", "detected_at", "status", "score", "priority")
    return verdicts.current_verdicts(narrow)


def v2_previous_verdict(spark, folder):
    narrow = judged(spark, folder).select("lead_id", "row_id", "detected_at", "status", "priority")
    rows = verdicts.with_previous_verdict(narrow)
    return rows.select("row_id", "lead_id", "previous_status", "previous_priority")


def v3_match_events(spark, folder):
    narrow = judged(spark, folder).select(
        "lead_id", "row_id", "detected_at", "raw_title", "status", "priority"
    )
    events = verdicts.match_events(narrow, F.lit("session"))
    return events.select("lead_id", "row_id", "title", "trigger", "at", F.length("match_event_id").alias("id_length"))


def v4_new_filter(spark, folder):
    leads = normalized(spark, folder)
    changed = verdicts.reevaluate_filter(leads, DEFAULT_FILTER, STRICT_FILTER)
    return verdicts.filter_change_summary(changed)


def v5_new_scoring(spark, folder):
    rows = verdicts.rescore(evaluated(spark, folder), DEFAULT_SCORING, LENIENT_SCORING)
    return verdicts.scoring_change_summary(rows)


def v6_scan_outcomes(spark, folder):
    rows = with_session(tables.leads_raw(spark, folder))
    return identity.scan_outcomes(rows).drop("revealed")


def v7_recent_results(spark, folder):
    narrow = judged(spark, folder).select("lead_id", "row_id", "detected_at", "status", "score", "priority")
    return verdicts.recent_results(narrow)


def v8_result_row(spark, folder):
    rows = verdicts.compact_result(scored(spark, folder))
    return rows.select(
        "row_id", "label", "country", "quantity", "status", "score", "priority",
        F.array_join(F.transform("reasons", lambda r: r.message), "; ").alias("reasons"),
        F.size("score_parts").alias("parts"),
    )


# --- statistics ---


def g1_verdict_counts(spark, folder):
    return statistics.verdict_counts(evaluated(spark, folder))


def g2_match_reasons(spark, folder):
    return statistics.match_reasons(evaluated(spark, folder))


def g3_rejection_reasons(spark, folder):
    return statistics.rejection_reasons(evaluated(spark, folder))


def g4_priority_counts(spark, folder):
    return statistics.priority_counts(scored(spark, folder))


def g5_score_summary(spark, folder):
    return statistics.score_summary(scored(spark, folder))


def event_outcomes(spark, folder) -> DataFrame:
    kinds = {"signup": "new", "click": "updated", "view": "duplicate", "purchase": "unchanged"}
    outcome = F
    for kind, name in kinds.items():
        outcome = outcome.when(F.col("event_type") == kind, name)
    return tables.read_table(spark, folder, "events").select(
        "event_id",
        F.col("user_id").alias("scan_id"),
        F.col("ts").alias("at"),
        outcome.otherwise("failed").alias("outcome"),
    )


def g6_outcome_counts(spark, folder):
    return statistics.outcome_counts(event_outcomes(spark, folder))


def g7_extraction_histograms(spark, folder):
    leads = normalize.with_optional_columns(tables.leads_raw(spark, folder))
    return statistics.extraction_histograms(cards.states_of_raw_leads(leads))


def g8_extraction_averages(spark, folder):
    leads = normalize.with_optional_columns(tables.leads_raw(spark, folder))
    return statistics.extraction_averages(cards.states_of_raw_leads(leads))


def g9_warning_counts(spark, folder):
    return statistics.warning_counts(normalized(spark, folder))


def g10_recent_percentiles(spark, folder):
    events = tables.read_table(spark, folder, "events").filter("value IS NOT NULL")
    return statistics.value_percentiles(events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


def g11_button_counts(spark, folder):
    kind = F.col("event_type")
    code = (
        F.when(kind == "click", "FOUND_REFERENCE")
        .when(kind.isin("purchase", "signup"), "FOUND_TEXT")
        .when(kind == "view", "IDENTITY_MISMATCH")
        .otherwise("ACTION_NOT_FOUND")
    )
    results = tables.read_table(spark, folder, "events").select(
        "ts", "event_id", code.alias("code"), code.startswith("FOUND").alias("ok"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("reason"),
    )
    return statistics.button_counts(results, ["ts", "event_id"])


def g12_recent_samples(spark, folder):
    leads = tables.leads_raw(spark, folder).select("row_id", "detected_at", "raw_title")
    return statistics.recent_samples(leads, [F.desc("detected_at"), F.desc("row_id")])


def g13_scan_summary(spark, folder):
    return statistics.scan_summary(event_outcomes(spark, folder))


# --- logs ---


def l1_processed_lines(spark, folder):
    leads = cards.states_of_raw_leads(scored(spark, folder))
    lines = exploded(leads, logs.processed_lead_lines(), "line")
    return lines.groupBy("line.level", "line.message").agg(F.count("*").alias("n"))


def l2_update_lines(spark, folder):
    # the texts of the lines are made first, so that reasons and points don't take part in the ordering
    lead = judged(spark, folder).withColumns({"filter_line": logs.filter_line(), "score_line": logs.score_line()})
    columns = ["lead_id", "row_id", "detected_at", "raw_title", "product_category", "status", "priority", "filter_line", "score_line"]
    rows = verdicts.with_previous_verdict(lead.select(*columns))
    rows = rows.filter("previous_row_id IS NOT NULL").withColumn(
        "revealed", F.array(F.lit("category"))
    )
    lines = exploded(rows, logs.updated_lead_lines(F.col("filter_line"), F.col("score_line")), "line")
    return lines.groupBy(F.col("line.level").alias("level")).agg(F.count("*").alias("n"))


def l3_truncate(spark, folder):
    leads = tables.leads_raw(spark, folder)
    return leads.select("row_id", X.truncate(F.col("raw_title"), 20).alias("short_title"))


def log_table(spark, folder) -> DataFrame:
    return tables.read_table(spark, folder, "events").select("event_type", "ts", "event_id")


def l4_last_lines(spark, folder):
    lines = logs.numbered_lines(log_table(spark, folder), ["event_type"], ["ts", "event_id"])
    return logs.last_lines(lines, ["event_type"], [F.desc("id")], 200)


def s7_lines_since(spark, folder):
    lines = logs.numbered_lines(log_table(spark, folder), ["event_type"], ["ts", "event_id"])
    return logs.lines_since(lines, 100)


def l5_action_lines(spark, folder):
    kinds = [
        "AUTOMATION_STARTED", "AUTOMATION_STOPPED", "ACTION_STARTED", "ACTION_QUEUED",
        "ACTION_SUCCESS", "ACTION_FAILED", "ACTION_RETRYING", "ACTION_SKIPPED", "ACTION_CANCELLED",
    ]
    e = F.col("event_id")
    reasons = F.array(*map(F.lit, ("licence", "user", "standby", "disabled")))
    events = tables.read_table(spark, folder, "events").select(
        "event_id",
        F.get(F.array(*map(F.lit, kinds)), (e % 9).cast("int")).alias("type"),
        F.get(reasons, (F.floor(e / 9) % 4).cast("int")).alias("reason"),
        (e % 3).alias("count"),
        F.concat(F.lit("lead of user "), F.col("user_id").cast("string")).alias("lead_label"),
        (e % 4).alias("attempt"),
        F.when(e % 2 == 0, "STALE_LEAD").alias("error_code"),
        F.col("event_type").alias("error_message"),
    )
    line = logs.action_event_line()
    return events.select("event_id", line.level.alias("level"), line.message.alias("message"))


# --- identity ---


def d1_canonical_key(spark, folder):
    rows = identity.with_identity(tables.leads_raw(spark, folder))
    return rows.select("row_id", "canonical_key")


def d2_fingerprint(spark, folder):
    return identity.distinct_fingerprints(tables.leads_raw(spark, folder)).select(
        "canonical_key", "fingerprint"
    )


def d3_lead_id(spark, folder):
    return identity.distinct_fingerprints(tables.leads_raw(spark, folder)).select(
        "fingerprint", "lead_id"
    )


def d4_title_key(spark, folder):
    rows = identity.with_identity(tables.leads_raw(spark, folder))
    return rows.select("row_id", "title_key", "cross_card_key")


def d5_information(spark, folder):
    rows = identity.with_identity(tables.leads_raw(spark, folder))
    entries = F.transform(
        F.map_entries("info"), lambda entry: F.concat(entry.key, F.lit("="), entry.value)
    )
    return rows.select("row_id", F.array_join(entries, "|").alias("info"))


def d6_exact_duplicates(spark, folder):
    rows = identity.with_identity(with_session(tables.leads_raw(spark, folder)))
    narrow = rows.select("session_id", "canonical_key", "detected_at", "row_id")
    return identity.exact_duplicates(narrow).select("session_id", "row_id", "canonical_key")


def _card_history(spark, folder):
    rows = identity.with_identity(with_session(tables.leads_raw(spark, folder)))
    narrow = rows.select("session_id", "card_id", "row_id", "detected_at", "title_key", "canonical_key", "info")
    return identity.with_card_history(narrow, keep=["row_id"])


def d7_unchanged(spark, folder):
    return _card_history(spark, folder).select("row_id", "unchanged")


def d8_same_card(spark, folder):
    good, _ = identity.split_failures(_card_history(spark, folder).filter(~F.col("unchanged")))
    return good.select("row_id", "linked_row_id")


def d9_resolution(spark, folder):
    """Renderings that were resolved, with the lead each one belongs to."""
    outcomes = v6_scan_outcomes(spark, folder).filter("lead_id IS NOT NULL")
    return outcomes.select("session_id", "row_id", "lead_id")


def d10_merge(spark, folder):
    """What each resolved rendering revealed, and what became of it."""
    outcomes = identity.scan_outcomes(with_session(tables.leads_raw(spark, folder))).filter("lead_id IS NOT NULL")
    return outcomes.select("session_id", "row_id", "outcome", F.array_join("revealed", ",").alias("revealed"))


def d12_failures(spark, folder):
    rows = identity.with_identity(with_session(tables.leads_raw(spark, folder)))
    _, failed = identity.split_failures(identity.with_signature(rows))
    return failed.select("row_id", "signature")


QUERIES = {
    name: function
    for name, function in list(globals().items())
    if name[:1] in "nfcvglds" and name[1:2].isdigit()
}

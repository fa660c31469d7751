"""Expected rows of each lead query."""

from oracle.leads import (
    COUNTRIES,
    EVALUATE,
    FRACTIONS,
    LEADS_RAW,
    NORMALIZE,
    SCORE,
    SHORT,
    WANTED,
    WANTED_FIELDS,
    WARNINGS,
    alias,
    hit_field,
    hit_text,
    measured,
    number,
    select,
    shown,
)

RAW = LEADS_RAW
FULL_REASONS = (
    "concat_ws('; ', country_reason, keyword_reasons, quantity_reason, contact_reason, negative_reasons)"
)
SQL = {
    "n1_display_text": select(RAW, f"SELECT row_id, {shown('raw_title')} AS title_display FROM leads_raw"),
    "n2_comparison_text": select(
        RAW, f"SELECT row_id, lower({shown('raw_title')}) AS title_comparison FROM leads_raw"
    ),
    "n3_tokens": select(
        RAW,
        rf"""SELECT row_id, coalesce((SELECT string_agg(t, '|' ORDER BY p) FROM (
          SELECT t, min(i) AS p FROM (
            SELECT regexp_replace(regexp_replace(x, '^[\s,.;:!?()\[\]]+', ''), '[\s,.;:!?()\[\]]+$', '') AS t, i
            FROM (SELECT unnest(string_split(lower({shown("raw_title")}), ' ')) AS x,
                         generate_subscripts(string_split(lower({shown("raw_title")}), ' '), 1) AS i))
          WHERE t <> '' GROUP BY t)), '') AS tokens FROM leads_raw""",
    ),
    "n4_alias_key": select(RAW, f"SELECT row_id, {alias('country')} AS country_key FROM leads_raw"),
    "n5_country": select(
        NORMALIZE, "SELECT row_id, country_normalized, country_code, country_warning FROM normalized"
    ),
    "n6_country_by_code": select(
        NORMALIZE,
        """SELECT n_nationkey, lower(left(n_name, 2)) AS typed_code, c.code AS country_code, c.name AS country_name
        FROM nation LEFT JOIN (SELECT DISTINCT code, name FROM countries) c ON c.code = upper(trim(left(n_name, 2)))""",
    ),
    "n7_measure": select(
        NORMALIZE, "SELECT row_id, quantity_value, quantity_unit, quantity_warning FROM normalized"
    ),
    "n8_unit": select(
        NORMALIZE,
        "SELECT quantity_unit, quantity_normalized_unit, count(*) AS n FROM normalized GROUP BY ALL",
    ),
    "n9_strength": select(
        NORMALIZE,
        """SELECT row_id, strength_value, strength_unit, strength_secondary_value, strength_secondary_unit,
        coalesce(strength_complex, FALSE) AS strength_complex, coalesce(strength_warnings, '') AS strength_warnings
        FROM normalized""",
    ),
    "n10_strength_unit": select(
        NORMALIZE, "SELECT strength_raw, strength_unit, count(*) AS n FROM normalized GROUP BY ALL"
    ),
    "n11_dosage_form": select(
        NORMALIZE, "SELECT row_id, dosage_form_normalized, dosage_form_warning FROM normalized"
    ),
    "n12_buyer_products": select(
        NORMALIZE,
        """SELECT row_id, array_to_string(buyer_products, '|') AS buyer_products,
        lower(array_to_string(buyer_products, '|')) AS buyer_products_normalized, buys_warning FROM normalized""",
    ),
    "n13_contact_flags": select(
        RAW, "SELECT row_id, mobile_available, whatsapp_available, email_available FROM leads_raw"
    ),
    "n14_lead_age": select(
        NORMALIZE, "SELECT row_id, age_minutes, age_approximate, age_warning FROM normalized"
    ),
    "n15_normalized_lead": select(
        NORMALIZE,
        f"""SELECT row_id, title_normalized AS title, country_code, quantity_value,
        quantity_normalized_unit AS quantity_unit, strength_value, dosage_form_normalized AS dosage_form,
        lower(array_to_string(buyer_products, '|')) AS products, age_minutes, {WARNINGS} AS warnings FROM normalized""",
    ),
    "f1_words": select(
        RAW,
        rf"""SELECT row_id, array_to_string(regexp_extract_all(lower(coalesce({shown("raw_title")}, '')),
        '[\pL\pN]+'), ' ') AS words FROM leads_raw""",
    ),
    "f14_evaluation": select(
        EVALUATE,
        f"""SELECT row_id, status, {FULL_REASONS} AS reasons, matched_keywords,
        CASE WHEN country_ok THEN country_normalized ELSE '' END AS matched_countries, negative_keywords,
        failed_groups FROM evaluated""",
    ),
    "c8_score": select(
        SCORE,
        """SELECT row_id, score, CASE WHEN passed THEN hundredths / 100.0::DOUBLE END AS raw_score,
        CASE WHEN passed THEN 100.0::DOUBLE END AS max_raw_score, priority FROM scored""",
    ),
}

# --- filter groups under the default and the strict profile ---

STRICT = f"""strict AS (
  SELECT *, coalesce(country_code = 'US', FALSE) AS s_country,
    {hit_field("tablet", ["title", "buyerProducts"])} AS t0,
    {hit_field("paracetamol tablets", ["title", "buyerProducts"])} AS t1,
    {hit_field("home use", ["title", "buyerProducts"])} AS x0,
    {hit_field("cream", ["title", "buyerProducts"])} AS x1,
    t0 IS NOT NULL AND t1 IS NOT NULL AS s_keyword, x0 IS NULL AND x1 IS NULL AS s_clear,
    coalesce(quantity_value BETWEEN 30 AND 1020, FALSE) AS s_quantity,
    mobile_available AND email_available AS s_contact,
    coalesce(age_minutes BETWEEN 10 AND 5000, FALSE) AS s_age
  FROM evaluated)"""
BOTH = ",\n".join([EVALUATE, STRICT])
_Q = number("quantity_value")
_A = number("age_minutes")
SQL |= {
    "f2_same_word": select(
        NORMALIZE,
        "SELECT word, "
        + ", ".join(
            f"""word = '{t}' OR word IN ('{t}s', '{t}es') OR '{t}' IN (word || 's', word || 'es')
            OR (word LIKE '%y' AND '{t}' = left(word, length(word) - 1) || 'ies')
            OR ('{t}' LIKE '%y' AND word = left('{t}', length('{t}') - 1) || 'ies') AS same_{t}"""
            for t in ("tablet", "boxes", "medicine", "remedies", "injections", "dry")
        )
        + r""" FROM (SELECT DISTINCT unnest(regexp_extract_all(title_normalized, '[\pL\pN]+')) AS word FROM normalized)""",
    ),
    "f3_phrase": select(
        EVALUATE,
        r"""SELECT row_id,
        coalesce((SELECT min(i) - 1 FROM generate_series(1, len(w) - 1) t(i) WHERE w[i] IN ('personal', 'personals', 'personales')
          AND w[i + 1] IN ('uses', 'use', 'useses', 'usess', 'us')), -1) AS index_use,
        coalesce((SELECT min(i) - 1 FROM generate_series(1, len(w)) t(i) WHERE w[i] IN ('tablet', 'tablets', 'tabletes')), -1) AS index_tablet,
        coalesce((SELECT w[min(i)] || ' ' || w[min(i) + 1] FROM generate_series(1, len(w) - 1) t(i)
          WHERE w[i] IN ('personal', 'personals', 'personales') AND w[i + 1] IN ('uses', 'use', 'useses', 'usess', 'us')), '') AS text_use,
        coalesce((SELECT w[min(i)] FROM generate_series(1, len(w)) t(i) WHERE w[i] IN ('tablet', 'tablets', 'tabletes')), '') AS text_tablet
        FROM (SELECT row_id, regexp_extract_all(coalesce(title_normalized, ''), '[\pL\pN]+') AS w FROM normalized)""",
    ),
    "f4_field_search": select(
        EVALUATE,
        f"""SELECT row_id, {hit_field("tablet", WANTED_FIELDS)} AS tablet_field,
        {hit_text("tablet", WANTED_FIELDS)} AS tablet_text,
        {hit_field("home use", ["buyerProducts", "title"])} AS home_field FROM lines""",
    ),
    "f5_compiled_terms": select(
        COUNTRIES,
        f"""SELECT n_nationkey, label, coalesce(c.code, i.code) AS term_code,
        coalesce(i.name_key, c.name_key, {alias("label")}) AS term_key
        FROM (SELECT n_nationkey, n_name AS label FROM nation UNION ALL SELECT n_nationkey, left(n_name, 2) FROM nation)
        LEFT JOIN countries c ON c.alias_key = {alias("label")}
        LEFT JOIN (SELECT DISTINCT code, name_key FROM countries) i
          ON c.code IS NULL AND regexp_matches(label, '^[A-Za-z]{{2}}$') AND i.code = upper(label)""",
    ),
    "f6_country_group": select(
        BOTH,
        """SELECT row_id, country_ok AS default_passed, country_reason AS default_reasons, s_country AS strict_passed,
        CASE WHEN country_normalized IS NULL THEN 'Country unavailable'
          WHEN s_country THEN 'Country matched: ' || country_normalized
          ELSE 'Country not allowed: ' || country_normalized END AS strict_reasons FROM strict""",
    ),
    "f7_keyword_group": select(
        BOTH,
        """SELECT row_id, keyword_ok AS default_passed, keyword_reasons AS default_reasons, s_keyword AS strict_passed,
        concat_ws('; ', 'Keyword matched: Tablet (' || t0 || ')', 'Keyword matched: paracetamol tablets (' || t1 || ')',
          CASE WHEN NOT s_keyword THEN 'Keywords not found: ' || concat_ws(', ', CASE WHEN t0 IS NULL THEN 'Tablet' END,
            CASE WHEN t1 IS NULL THEN 'paracetamol tablets' END) END) AS strict_reasons FROM strict""",
    ),
    "f8_excluded_keywords": select(
        BOTH,
        """SELECT row_id, negative_ok AS default_passed, negative_reasons AS default_reasons, s_clear AS strict_passed,
        concat_ws('; ', 'Excluded keyword detected: home use (' || x0 || ')', 'Excluded keyword detected: cream (' || x1 || ')',
          CASE WHEN s_clear THEN 'No excluded keywords' END) AS strict_reasons FROM strict""",
    ),
    "f9_quantity_group": select(
        BOTH,
        f"""SELECT row_id, quantity_ok AS default_passed, quantity_reason AS default_reasons, s_quantity AS strict_passed,
        CASE WHEN quantity_value IS NULL AND quantity_raw IS NULL THEN 'Quantity unavailable'
          WHEN quantity_value IS NULL THEN 'Quantity not a single number: ' || quantity_raw
          WHEN quantity_value < 30 THEN 'Quantity ' || {_Q} || ' < minimum 30'
          WHEN quantity_value > 1020 THEN 'Quantity ' || {_Q} || ' > maximum 1020'
          ELSE concat_ws(' ', 'Quantity', {_Q}, quantity_unit, '≥ 30, ≤ 1020') END AS strict_reasons FROM strict""",
    ),
    "f10_contact_group": select(
        BOTH,
        """SELECT row_id, contact_ok AS default_passed, contact_reason AS default_reasons, s_contact AS strict_passed,
        CASE WHEN s_contact THEN 'Contact: Mobile, Email available' ELSE 'Contact requirement failed: ' ||
          concat_ws(', ', CASE WHEN NOT mobile_available THEN 'Mobile' END, CASE WHEN NOT email_available THEN 'Email' END)
          || ' unavailable' END AS strict_reasons FROM strict""",
    ),
    "f11_lead_age_group": select(
        BOTH,
        f"""SELECT row_id, age_minutes IS NOT NULL AS default_passed, concat_ws('; ', approx,
          CASE WHEN age_minutes IS NULL THEN missing ELSE 'Lead age ' || {_A} || ' min' END) AS default_reasons,
        s_age AS strict_passed, concat_ws('; ', approx, CASE WHEN age_minutes IS NULL THEN missing
          WHEN age_minutes > 5000 THEN 'Lead age ' || {_A} || ' min > maximum 5000 min'
          WHEN age_minutes < 10 THEN 'Lead age ' || {_A} || ' min < minimum 10 min'
          ELSE 'Lead age ' || {_A} || ' min' END) AS strict_reasons
        FROM (SELECT *, CASE WHEN raw_lead_age IS NULL THEN 'Lead age unavailable'
          ELSE 'Lead age not convertible: ' || raw_lead_age END AS missing,
          CASE WHEN age_approximate THEN 'Lead age is approximate: ' || raw_lead_age END AS approx FROM strict)""",
    ),
    "f12_combine": select(
        BOTH,
        """SELECT row_id, passed, (s_country OR s_keyword OR s_quantity OR s_contact OR s_age) AND s_clear AS strict_passed
        FROM strict""",
    ),
    "f13_master_switch": select(
        RAW, "SELECT row_id, 'MATCHED' AS status, 'FILTER_DISABLED' AS reason, 0 AS listed FROM leads_raw"
    ),
    "f15_explanation": select(
        EVALUATE,
        """SELECT row_id, array_to_string(list_slice(m, 1, 2), '; ') ||
          CASE WHEN len(m) > 2 THEN '; +' || CAST(len(m) - 2 AS STRING) || ' more' ELSE '' END AS explanation
        FROM (SELECT row_id, list_filter(CASE WHEN passed THEN
            [country_reason] || string_split(keyword_reasons, '; ') || [quantity_reason, contact_reason]
          ELSE [CASE WHEN NOT country_ok THEN country_reason END, CASE WHEN NOT keyword_ok THEN 'No keyword matched' END,
            CASE WHEN NOT quantity_ok THEN quantity_reason END, CASE WHEN NOT contact_ok THEN contact_reason END]
            || CASE WHEN negative_ok THEN [] ELSE string_split(negative_reasons, '; ') END END,
          lambda x: x IS NOT NULL) AS m FROM evaluated)""",
    ),
    "f16_profile_validation": """SELECT c_custkey, NOT (c_custkey % 11 = 0 OR c_custkey % 13 = 0 OR c_custkey % 7 = 0
        OR c_custkey % 17 = 0 OR c_custkey % 19 = 0 OR c_custkey % 23 = 0
        OR (c_custkey % 3 = 0 AND c_custkey % 50 > c_custkey % 40)) AS valid FROM customer""",
    "f18_profile_table": select(
        EVALUATE,
        f"""SELECT row_id, k || '-a' AS profile_id, k % 7 <> 0 AS valid, CASE WHEN ok THEN 'MATCHED' ELSE 'REJECTED' END AS status,
        CASE WHEN k % 7 = 0 THEN failed_groups ELSE concat_ws(',', CASE WHEN NOT country_ok THEN 'countries' END, CASE WHEN NOT words THEN 'keywords' END,
          CASE WHEN NOT q THEN 'quantity' END, CASE WHEN NOT contact_ok THEN 'contact' END, CASE WHEN NOT negative_ok THEN 'negativeKeywords' END) END
        AS failed_groups FROM (SELECT *, CASE WHEN k % 7 = 0 THEN passed WHEN NOT negative_ok THEN FALSE
            WHEN k % 2 = 0 THEN country_ok AND words AND q AND contact_ok ELSE country_ok OR words OR q OR contact_ok END AS ok
          FROM (SELECT *, split_part(card_id, '_', 2)::BIGINT AS k, coalesce(quantity_value >= k % 20 * 5, FALSE) AS q,
            CASE k % 3 WHEN 0 THEN keyword_ok WHEN 1 THEN coalesce({hit_field("Large Bolt", WANTED_FIELDS)}, {hit_field("red gizmos", WANTED_FIELDS)}) IS NOT NULL
              ELSE k0 IS NOT NULL AND k4 IS NOT NULL END AS words FROM evaluated))
        UNION ALL
        SELECT row_id, k || '-b', TRUE, CASE WHEN k % 5 = 0 OR (c AND q AND t) THEN 'MATCHED' ELSE 'REJECTED' END,
          CASE WHEN k % 5 = 0 THEN '' ELSE concat_ws(',', CASE WHEN NOT c THEN 'countries' END, CASE WHEN NOT q THEN 'quantity' END, CASE WHEN NOT t THEN 'contact' END) END
        FROM (SELECT *, split_part(card_id, '_', 2)::BIGINT AS k, coalesce(country_code = 'CA' OR country_key = 'atlantis', FALSE) AS c,
          coalesce(quantity_value >= 10, FALSE) AS q, mobile_available AND whatsapp_available AS t FROM evaluated)""",
    ),
    "f18_profile_grid": select(
        EVALUATE,
        """SELECT 'p' || lpad(CAST(p AS STRING), 2, '0') AS profile_id, CASE WHEN negative_ok AND
          CASE WHEN p % 2 = 0 THEN country_ok AND keyword_ok AND q AND contact_ok
            ELSE country_ok OR keyword_ok OR q OR contact_ok END THEN 'MATCHED' ELSE 'REJECTED' END AS status, count(*) AS n
        FROM (SELECT *, coalesce(quantity_value >= 5 * p, FALSE) AS q FROM evaluated, generate_series(0, 19) t(p)) GROUP BY ALL""",
    ),
}

# --- score parts ---


def part(fraction: str, message: str) -> str:
    return select(
        SCORE, f"SELECT row_id, CAST({fraction} AS DOUBLE) AS fraction, {message} AS message FROM scored"
    )


_FIRST = "coalesce(" + ", ".join(
    f"CASE WHEN k{n} IS NOT NULL THEN '{word}' END" for n, word in enumerate(WANTED)
) + ")"
_COUNT = " + ".join(f"CAST(k{n} IS NOT NULL AS INT)" for n in range(len(WANTED)))
_AGE_TEXT = f"""CASE WHEN age_minutes IS NULL THEN 'Lead age unavailable'
  WHEN age_approximate THEN 'Lead age approximate, not scored: ' || raw_lead_age
  ELSE 'Lead age ' || {_A} || ' min' END"""
_MESSAGES = {
    "country": "CASE WHEN country_ok THEN 'Country matched: ' || country_normalized "
    "ELSE 'Country not in the filter list: ' || coalesce(country_normalized, 'unknown') END",
    "quantity": f"""CASE WHEN quantity_value IS NOT NULL THEN concat_ws(' ', 'Quantity', {_Q}, quantity_unit) || ' (' ||
      {number("least(quantity_value, 100)")} || '/100)' WHEN quantity_raw IS NULL THEN 'Quantity unavailable'
      ELSE 'Quantity not a single number: ' || quantity_raw END""",
    "keyword": f"""CASE WHEN {_FIRST} IS NULL THEN 'No keyword matched' ELSE 'Keyword matched: ' || {_FIRST} ||
      CASE WHEN {_COUNT} > 1 THEN ' (+' || CAST({_COUNT} - 1 AS STRING) || ' more)' ELSE '' END END""",
    "category": "coalesce('Category: ' || coalesce(product_category_text, category_text), 'Category unavailable')",
    "buyers": """CASE WHEN len(buyer_products) > 0 THEN 'Buyer products listed: ' || CAST(len(buyer_products) AS STRING)
      ELSE 'No buyer products listed' END""",
    "age": _AGE_TEXT,
}
SQL |= {
    name: part(FRACTIONS[key], _MESSAGES[key])
    for name, key in (
        ("c1_country", "country"), ("c2_quantity", "quantity"), ("c4_keyword", "keyword"),
        ("c5_category", "category"), ("c6_buyer_products", "buyers"), ("c7_lead_age", "age"),
    )
}
_ORDER = ["country", "quantity", "mobile", "whatsapp", "email", "keyword", "category", "buyers", "age"]
_NAMES = {"buyers": "buyerProducts", "age": "leadAge"}
_PARTS = ", ".join(f"'{_NAMES.get(n, n)}=' || CAST(h_{n} AS STRING)" for n in _ORDER)
_EARNED = ", ".join(
    f"{{'p': -h_{n}, 'i': {i}, 't': '+' || CASE WHEN h_{n} % 100 = 0 THEN CAST(h_{n} // 100 AS STRING) "
    f"ELSE printf('%.1f', h_{n} / 100.0) END || ' {SHORT[n]}'}}"
    for i, n in enumerate(_ORDER)
)
_LENIENT = """floor(30 * coalesce(least(greatest(quantity_value, 0) / 500.0::DOUBLE, 1), 0) * 100 + 0.5)
  + floor(10 * (CASE WHEN age_minutes IS NULL THEN 0 WHEN age_minutes <= 15 THEN 1 WHEN age_minutes <= 60 THEN 0.75
      WHEN age_minutes <= 180 THEN 0.5 WHEN age_minutes <= 1440 THEN 0.25 ELSE 0 END)::DOUBLE * 100 + 0.5)
  + h_country + h_mobile + h_whatsapp + h_email + h_keyword + h_buyers"""
LENIENT = f"""lenient AS (SELECT *, CASE WHEN passed THEN CAST(floor(({_LENIENT}) / 111.0::DOUBLE + 0.5) AS INT) END AS l_score,
    CASE WHEN NOT passed THEN 'REJECTED' WHEN l_score >= 80 THEN 'CRITICAL' WHEN l_score >= 60 THEN 'HIGH'
      WHEN l_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS l_priority FROM scored)"""
BOTH_SCORES = ",\n".join([SCORE, LENIENT])
SQL |= {
    "c3_contact": select(
        RAW,
        """SELECT row_id, CAST(mobile_available AS DOUBLE) AS mobile, CAST(whatsapp_available AS DOUBLE) AS whatsapp,
        CAST(email_available AS DOUBLE) AS email FROM leads_raw""",
    ),
    "c9_priority": select(
        BOTH_SCORES, "SELECT row_id, l_score AS score, l_priority AS priority FROM lenient"
    ),
    "c10_states": select(
        EVALUATE,
        """SELECT CASE WHEN passed THEN 'UNSCORED' ELSE 'REJECTED' END AS kind, kind AS priority, passed AS eligible,
        count(*) AS n, 0 AS scores FROM evaluated GROUP BY ALL""",
    ),
    "c11_score_reasons": select(
        SCORE, f"SELECT row_id, CASE WHEN passed THEN concat_ws(',', {_PARTS}) ELSE '' END AS parts FROM scored"
    ),
    "c12_explanation": select(
        SCORE,
        f"""SELECT row_id, CASE WHEN NOT passed THEN 'Not scored: rejected by filters' ELSE 'Score ' ||
        CAST(score AS STRING) || '/100 (' || priority || '): ' || array_to_string(list_transform(list_sort(
        list_filter([{_EARNED}], lambda x: x.p < 0)), lambda x: x.t), ', ') END AS explanation FROM scored""",
    ),
    "c13_scoring_validation": """SELECT c_custkey, c_custkey % 120 <= 100 AND c_custkey % 5 <> 0 AND c_custkey % 3 <> 0
        AND c_custkey % 7 <> 0 AND c_custkey % 4 > 0 AS valid FROM customer""",
    "c15_scoring_error": select(
        SCORE,
        """SELECT CASE WHEN quantity_value IS NULL THEN 'UNSCORED' ELSE priority END AS priority, count(*) AS n
        FROM scored GROUP BY ALL""",
    ),
}

# --- identity and verdict state ---

_I = {name: f"lower({shown(name)})" for name in ("raw_title", "country", "quantity_raw", "product_category", "category", "strength_raw", "dosage_form")}
_BUYS = "lower(array_to_string(buyer_products, '|'))"
IDENTITY = f"""leads AS (
  SELECT *, chr(9247) AS sep, 's' || strftime(detected_at, '%Y-%m') AS session_id,
    coalesce({_I["raw_title"]}, {_I["product_category"]}) AS title_key,
    CASE WHEN title_key IS NOT NULL THEN 't=' || coalesce({_I["raw_title"]}, '') || sep || 'c=' || coalesce({_I["country"]}, '')
      || sep || 'q=' || coalesce({_I["quantity_raw"]}, '') || sep || 'p=' || coalesce({_I["product_category"]}, '')
      || sep || 'b=' || {_BUYS} END AS canonical_key,
    title_key || sep || coalesce({_I["country"]}, '') AS cross_card_key,
    concat_ws('|', 'country=' || {_I["country"]}, 'quantity=' || {_I["quantity_raw"]}, 'category=' || {_I["category"]},
      'productCategory=' || {_I["product_category"]}, 'buys=' || nullif({_BUYS}, ''), 'strength=' || {_I["strength_raw"]},
      'dosageForm=' || {_I["dosage_form"]}, CASE WHEN mobile_available THEN 'mobile=yes' END,
      CASE WHEN whatsapp_available THEN 'whatsapp=yes' END, CASE WHEN email_available THEN 'email=yes' END) AS info,
    'lead_' || left(sha256(canonical_key), 14) AS lead_id
  FROM {{source}}),
known AS (SELECT * FROM leads WHERE canonical_key IS NOT NULL),
shown_before AS (
  SELECT *, coalesce(canonical_key || info, 'unidentified') AS signature,
    lag(coalesce(canonical_key || info, 'unidentified')) OVER (PARTITION BY session_id, card_id ORDER BY detected_at, row_id) AS before
  FROM leads)"""
NAMED = ",\n".join([NORMALIZE, IDENTITY.format(source="normalized")])
VERDICTS = ",\n".join([SCORE, IDENTITY.format(source="scored")])
_SEEN = "PARTITION BY lead_id ORDER BY detected_at, row_id"
_LATEST = "QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY detected_at DESC, row_id DESC) = 1"
# the 53-bit hash of an identity: two 32-bit rounds over the UTF-16 units, then a final mix
_UNITS = """list_transform(string_split(canonical_key, ''), lambda c: CAST(ord(c) AS UBIGINT))"""
_WIDE = f"""flatten(list_transform({_UNITS}, lambda u: CASE WHEN u < 65536 THEN [u]
    ELSE [55296 + (u - 65536) // 1024, 56320 + (u - 65536) % 1024] END))"""
_ROUND = lambda start, by: (
    f"list_reduce(list_prepend(CAST({start} AS UBIGINT), {_WIDE}), lambda h, u: (xor(h, u) * {by}) % 4294967296)"
)
_MIX = lambda one, other: (
    f"xor((xor({one}, {one} >> 16) * 2246822507) % 4294967296, (xor({other}, {other} >> 13) * 3266489909) % 4294967296)"
)
_HASHED = f"""(SELECT canonical_key, h1, {_MIX("h2", "h1")} AS h2 FROM (SELECT canonical_key, {_MIX("h1", "h2")} AS h1, h2 FROM (
    SELECT canonical_key, {_ROUND(3735928559, 2654435761)} AS h1, {_ROUND(1103547991, 1597334677)} AS h2
    FROM (SELECT DISTINCT canonical_key FROM leads WHERE canonical_key IS NOT NULL))))"""
_FINGERPRINT = "'fp_' || lpad(lower(to_hex((h2 % 2097152) * 4294967296 + h1)), 14, '0')"
# the registry of one session and title, one rendering a step: its leads, and who owns an identity or a card
_INFO_PAIRS = """list_filter([('country', i_country), ('quantity', i_quantity), ('category', i_category), ('productCategory', i_product),
    ('buys', i_buys), ('strength', i_strength), ('dosageForm', i_form), ('mobile', CASE WHEN mobile_available THEN 'yes' END),
    ('whatsapp', CASE WHEN whatsapp_available THEN 'yes' END), ('email', CASE WHEN email_available THEN 'yes' END)], lambda x: x[2] IS NOT NULL)"""
_REGISTRY = f"""shown_events AS (
  SELECT *, {_I["country"]} AS i_country, {_I["quantity_raw"]} AS i_quantity, {_I["category"]} AS i_category, {_I["product_category"]} AS i_product,
    nullif({_BUYS}, '') AS i_buys, {_I["strength_raw"]} AS i_strength, {_I["dosage_form"]} AS i_form,
    coalesce(lag(title_key) OVER (PARTITION BY session_id, card_id ORDER BY detected_at, row_id) = title_key, FALSE) AS linked
  FROM shown_before WHERE canonical_key IS NOT NULL AND signature IS DISTINCT FROM before),
steps AS MATERIALIZED (
  SELECT session_id, title_key, card_id, row_id, canonical_key AS fp, cross_card_key AS ck, linked, {_INFO_PAIRS} AS pairs,
    map_from_entries({_INFO_PAIRS}) AS shown, row_number() OVER (PARTITION BY session_id, title_key ORDER BY detected_at, row_id) AS n
  FROM shown_events),
replayed AS (
  SELECT session_id, title_key, 0::BIGINT AS n, ''::VARCHAR AS row_id, ''::VARCHAR AS lead, ''::VARCHAR AS outcome, ''::VARCHAR AS revealed,
    []::STRUCT(id VARCHAR, ck VARCHAR, info MAP(VARCHAR, VARCHAR))[] AS leads, MAP([], [])::MAP(VARCHAR, VARCHAR) AS owners, MAP([], [])::MAP(VARCHAR, VARCHAR) AS cards
  FROM steps WHERE n = 1
  UNION ALL
  SELECT session_id, title_key, n, row_id, lead, CASE WHEN fresh THEN 'new' WHEN len(news) > 0 THEN 'updated' ELSE 'duplicate' END,
    CASE WHEN fresh THEN '' ELSE array_to_string(news, ',') END,
    CASE WHEN fresh THEN list_append(leads, struct_pack(id := lead, ck := ck, info := shown))
      ELSE list_transform(leads, lambda l: CASE WHEN l.id <> lead THEN l WHEN known IS NULL
        THEN struct_pack(id := l.id, ck := l.ck, info := map_concat(shown, l.info)) ELSE struct_pack(id := l.id, ck := l.ck, info := map_concat(l.info, shown)) END) END,
    map_concat(owners, MAP([fp], [lead])), map_concat(cards, MAP([card_id], [lead]))
  FROM (SELECT *, coalesce(known, fits, fp) AS lead, known IS NULL AND fits IS NULL AS fresh,
      list_concat(list_filter(list_transform(pairs, lambda x: x[1]), lambda k: NOT map_contains(had, k)),
        CASE WHEN known IS NULL THEN [] ELSE list_transform(list_filter(pairs, lambda x: map_contains(had, x[1]) AND had[x[1]] <> x[2]), lambda x: x[1]) END) AS news
    FROM (SELECT *, coalesce(list_filter(leads, lambda l: l.id = coalesce(known, fits))[1].info, MAP([], [])::MAP(VARCHAR, VARCHAR)) AS had
      FROM (SELECT r.session_id, r.title_key, s.n, s.row_id, s.card_id, s.fp, s.ck, s.pairs, s.shown, r.leads, r.owners, r.cards,
          CASE WHEN s.linked THEN r.cards[s.card_id] ELSE r.owners[s.fp] END AS known,
          list_filter(r.leads, lambda l: l.ck = s.ck AND coalesce(l.info['quantity'] = s.shown['quantity'], TRUE)
            AND coalesce(l.info['productCategory'] = s.shown['productCategory'], TRUE) AND coalesce(l.info['buys'] = s.shown['buys'], TRUE))[1].id AS fits
        FROM replayed r JOIN steps s ON s.session_id = r.session_id AND s.title_key = r.title_key AND s.n = r.n + 1)))),
resolved AS (SELECT session_id, row_id, lead, outcome, revealed FROM replayed WHERE n > 0),
fingerprints AS (SELECT canonical_key, 'lead_' || right({_FINGERPRINT}, 14) AS lead_id FROM {_HASHED})"""
_RESOLVE = "RECURSIVE " + ",\n".join([NAMED, _REGISTRY])
SQL |= {
    "v6_scan_outcomes": select(
        _RESOLVE,
        """SELECT l.session_id, l.card_id, l.row_id, f.lead_id, coalesce(r.outcome, CASE WHEN l.canonical_key IS NULL THEN 'failed' ELSE 'unchanged' END)
        AS outcome FROM leads l LEFT JOIN resolved r ON r.session_id = l.session_id AND r.row_id = l.row_id
        LEFT JOIN fingerprints f ON f.canonical_key = r.lead""",
    ),
    "d9_resolution": select(
        _RESOLVE, "SELECT session_id, row_id, lead_id FROM resolved r JOIN fingerprints f ON f.canonical_key = r.lead"
    ),
    "d10_merge": select(_RESOLVE, "SELECT session_id, row_id, outcome, revealed FROM resolved"),
    "d1_canonical_key": select(NAMED, "SELECT row_id, canonical_key FROM leads"),
    "d2_fingerprint": select(NAMED, f"SELECT canonical_key, {_FINGERPRINT} AS fingerprint FROM {_HASHED}"),
    "d3_lead_id": select(
        NAMED,
        f"SELECT fingerprint, 'lead_' || right(fingerprint, 14) AS lead_id FROM (SELECT {_FINGERPRINT} AS fingerprint FROM {_HASHED})",
    ),
    "d4_title_key": select(NAMED, "SELECT row_id, title_key, cross_card_key FROM leads"),
    "d5_information": select(NAMED, "SELECT row_id, info FROM leads"),
    "d6_exact_duplicates": select(
        NAMED,
        """SELECT session_id, row_id, canonical_key FROM known QUALIFY
        row_number() OVER (PARTITION BY session_id, canonical_key ORDER BY detected_at, row_id) = 1""",
    ),
    "d7_unchanged": select(
        NAMED, "SELECT row_id, coalesce(signature = before, FALSE) AS unchanged FROM shown_before"
    ),
    "d8_same_card": select(
        NAMED,
        """SELECT row_id, CASE WHEN lag(title_key) OVER w = title_key THEN lag(row_id) OVER w END AS linked_row_id
        FROM shown_before WHERE canonical_key IS NOT NULL AND signature IS DISTINCT FROM before
        WINDOW w AS (PARTITION BY session_id, card_id ORDER BY detected_at, row_id)""",
    ),
    "d12_failures": select(
        NAMED, "SELECT row_id, 'unidentified' AS signature FROM leads WHERE canonical_key IS NULL"
    ),
    "v1_current_verdict": select(
        VERDICTS, f"SELECT lead_id, row_id, detected_at, status, score, priority FROM known {_LATEST}"
    ),
    "v2_previous_verdict": select(
        VERDICTS,
        f"""SELECT row_id, lead_id, lag(status) OVER ({_SEEN}) AS previous_status,
        lag(priority) OVER ({_SEEN}) AS previous_priority FROM known""",
    ),
    "v3_match_events": select(
        VERDICTS,
        f"""SELECT lead_id, row_id, raw_title AS title, CASE WHEN n = 1 THEN 'detected' ELSE 'updated' END AS trigger,
        detected_at AS "at", 66 AS id_length FROM (SELECT *, row_number() OVER ({_SEEN}) AS n FROM known) WHERE passed""",
    ),
    "v4_new_filter": select(
        BOTH,
        """SELECT count(*) FILTER (after) AS matched, count(*) FILTER (NOT after) AS rejected,
        count(*) FILTER (after <> passed) AS changed, count(*) FILTER (after AND NOT passed) AS newly_matched
        FROM (SELECT *, (s_country OR s_keyword OR s_quantity OR s_contact OR s_age) AND s_clear AS after FROM strict)""",
    ),
    "v5_new_scoring": select(
        BOTH_SCORES,
        """SELECT count(l_score) AS scored, floor(avg(l_score) * 10 + 0.5) / 10 AS average_score,
        count(*) FILTER (l_score IS DISTINCT FROM score OR l_priority <> priority) AS changed FROM lenient""",
    ),
    "v7_recent_results": select(
        VERDICTS,
        f"""SELECT * FROM (SELECT lead_id, row_id, detected_at, status, score, priority FROM known {_LATEST})
        ORDER BY detected_at DESC, row_id DESC LIMIT 20""",
    ),
    "v8_result_row": select(
        SCORE,
        f"""SELECT row_id, coalesce({shown("raw_title")}, product_category_text, 'Untitled lead') AS label,
        country_normalized AS country, quantity_raw AS quantity, status, score, priority,
        concat_ws('; ', country_reason, keyword_reasons, quantity_reason, contact_reason,
          CASE WHEN NOT negative_ok THEN negative_reasons END) AS reasons,
        CASE WHEN passed THEN 9 ELSE 0 END AS parts FROM scored""",
    ),
}

# --- statistics and logs ---

_OUTCOMES = """outcomes AS (SELECT user_id AS scan_id, ts AS moment, CASE event_type WHEN 'signup' THEN 'new'
  WHEN 'click' THEN 'updated' WHEN 'view' THEN 'duplicate' WHEN 'purchase' THEN 'unchanged' ELSE 'failed' END AS outcome
  FROM events)"""
_PASSES = {
    "COUNTRY_MATCH": "country_ok", "QUANTITY_PASS": "quantity_ok", "CONTACT_PASS": "contact_ok",
    "NEGATIVE_CLEAR": "negative_ok",
}
_AGE_READ = """CASE WHEN age_text = 'just now' THEN 0 WHEN age_text = 'yesterday' THEN 1440
  WHEN regexp_matches(age_text, '^\\d+\\s*[a-z]+\\s+ago$') THEN floor(TRY_CAST(age_amount AS DOUBLE) * age_factor + 0.5) END"""
_STRENGTH_READ = measured("strength_text")[0]
EXTRACTED = f"""extracted AS (
  SELECT *, {_AGE_READ} AS minutes, {_STRENGTH_READ} AS strength_number,
    CASE WHEN raw_title IS NULL THEN 'failed' ELSE 'found' END AS title_state,
    CASE WHEN country IS NULL THEN 'missing' ELSE 'found' END AS country_state,
    CASE WHEN category IS NULL THEN 'missing' ELSE 'found' END AS category_state,
    CASE WHEN buys_raw IS NULL THEN 'missing' ELSE 'found' END AS buys_state,
    CASE WHEN raw_lead_age IS NULL THEN 'missing' WHEN minutes IS NULL THEN 'failed' ELSE 'found' END AS age_state,
    CASE WHEN quantity_raw IS NULL THEN 'missing' WHEN any_value IS NULL THEN 'failed' ELSE 'found' END AS quantity_state,
    CASE WHEN strength_raw IS NULL THEN 'missing' WHEN strength_number IS NULL THEN 'failed' ELSE 'found' END AS strength_state,
    concat_ws(',', CASE WHEN title_state = 'failed' THEN 'title' END, CASE WHEN age_state = 'failed' THEN 'leadAge' END,
      CASE WHEN quantity_state = 'failed' THEN 'quantity' END, CASE WHEN strength_state = 'failed' THEN 'strength' END) AS failed_fields,
    concat_ws(',', CASE WHEN country IS NULL THEN 'country' END, CASE WHEN age_state = 'missing' THEN 'leadAge' END,
      CASE WHEN category IS NULL THEN 'category' END, CASE WHEN quantity_raw IS NULL THEN 'quantity' END,
      CASE WHEN strength_raw IS NULL THEN 'strength' END, CASE WHEN dosage_form IS NULL THEN 'dosageForm' END,
      'quantityPerStrip', CASE WHEN buys_raw IS NULL THEN 'buys' END, 'engagement',
      CASE WHEN NOT (mobile_available OR whatsapp_available OR email_available) THEN 'contact' END) AS missing_fields,
    concat_ws('; ', CASE WHEN title_state = 'failed' THEN 'title: no readable title in the card' END,
      CASE WHEN age_state = 'failed' THEN 'leadAge: could not parse "' || raw_lead_age || '"' END,
      CASE WHEN quantity_state = 'failed' THEN 'quantity: could not parse "' || quantity_raw || '"' END,
      CASE WHEN strength_state = 'failed' THEN 'strength: could not parse "' || strength_raw || '"' END) AS warnings,
    0.3::DOUBLE + (country_state <> 'missing')::INT * 0.2::DOUBLE + (category_state <> 'missing')::INT * 0.15::DOUBLE
      + (quantity_state <> 'missing')::INT * 0.15::DOUBLE + (buys_state <> 'missing')::INT * 0.1::DOUBLE
      + (age_state <> 'missing')::INT * 0.1::DOUBLE AS present_weight,
    (title_state = 'found')::INT * 0.3::DOUBLE + (country_state = 'found')::INT * 0.2::DOUBLE
      + (category_state = 'found')::INT * 0.15::DOUBLE + (quantity_state = 'found')::INT * 0.15::DOUBLE
      + (buys_state = 'found')::INT * 0.1::DOUBLE + (age_state = 'found')::INT * 0.1::DOUBLE AS found_weight,
    floor(greatest(0, found_weight / present_weight - 0.05::DOUBLE * (strength_state = 'failed')::INT) * 1000 + 0.5) / 1000 AS confidence,
    floor(least(1, found_weight) * 1000 + 0.5) / 1000 AS completeness
  FROM normalized)"""
EXTRACT = ",\n".join([NORMALIZE, EXTRACTED])
SQL |= {
    "g1_verdict_counts": select(
        EVALUATE,
        "SELECT count(*) FILTER (passed) AS matched, count(*) FILTER (NOT passed) AS rejected FROM evaluated",
    ),
    "g2_match_reasons": select(
        EVALUATE,
        "SELECT reason, count(*) AS n FROM ("
        + " UNION ALL ".join(
            [f"SELECT '{name}' AS reason FROM evaluated WHERE passed AND {ok}" for name, ok in _PASSES.items()]
            + [f"SELECT 'KEYWORD_MATCH' FROM evaluated WHERE passed AND k{n} IS NOT NULL" for n in range(5)]
        )
        + ") GROUP BY reason",
    ),
    "g3_rejection_reasons": select(
        EVALUATE,
        """SELECT failed_group, count(*) AS n FROM (SELECT unnest(string_split(failed_groups, ',')) AS failed_group
        FROM evaluated WHERE NOT passed) GROUP BY failed_group""",
    ),
    "g4_priority_counts": select(
        SCORE,
        """SELECT p.priority, count(s.priority) AS n FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW'),
        ('UNSCORED'), ('REJECTED')) p(priority) LEFT JOIN scored s ON s.priority = p.priority GROUP BY p.priority""",
    ),
    "g5_score_summary": select(
        SCORE,
        """SELECT count(*) FILTER (passed) AS eligible, count(score) AS scored,
        floor(avg(score) * 10 + 0.5) / 10 AS average_score, min(score) AS min_score, max(score) AS max_score FROM scored""",
    ),
    "g6_outcome_counts": select(
        _OUTCOMES,
        """SELECT count(*) FILTER (outcome = 'new') AS detected, count(*) FILTER (outcome <> 'unchanged') AS processed,
        count(*) FILTER (outcome = 'duplicate') AS duplicates, count(*) FILTER (outcome = 'failed') AS failures FROM outcomes""",
    ),
    "g7_extraction_histograms": select(
        EXTRACT,
        """SELECT kind, name, count(*) AS n FROM (
        SELECT 'failed' AS kind, unnest(string_split(failed_fields, ',')) AS name FROM extracted
        UNION ALL SELECT 'missing', unnest(string_split(missing_fields, ',')) FROM extracted
        UNION ALL SELECT 'note', 'engagement: markup not verified, values not read' FROM extracted)
        WHERE name <> '' GROUP BY ALL""",
    ),
    "g8_extraction_averages": select(
        EXTRACT,
        """SELECT floor(avg(confidence) * 100 + 0.5) / 100 AS average_confidence,
        floor(avg(completeness) * 100 + 0.5) / 100 AS average_completeness FROM extracted""",
    ),
    "g9_warning_counts": select(
        NORMALIZE,
        f"""SELECT warning, count(*) AS n FROM (SELECT unnest(string_split({WARNINGS}, '; ')) AS warning FROM normalized)
        WHERE warning <> '' GROUP BY warning""",
    ),
    "g10_recent_percentiles": """SELECT t.event_type, average, maximum, p50, p95 FROM (
        SELECT event_type, floor(avg(value) * 100 + 0.5) / 100 AS average, max(value) AS maximum
        FROM events WHERE value IS NOT NULL GROUP BY event_type) t JOIN (
        SELECT event_type, s[greatest(1, CAST(ceil(0.5 * len(s)) AS INT))] AS p50,
          s[greatest(1, CAST(ceil(0.95 * len(s)) AS INT))] AS p95 FROM (
          SELECT event_type, list_sort(list(value)) AS s FROM events WHERE value IS NOT NULL GROUP BY event_type)) r
        ON t.event_type = r.event_type""",
    "g11_button_counts": """SELECT count(*) FILTER (event_type IN ('click', 'purchase', 'signup')) AS found,
        count(*) FILTER (event_type = 'view') AS identity_mismatch,
        count(*) FILTER (event_type NOT IN ('click', 'purchase', 'signup', 'view')) AS not_found,
        count(*) FILTER (event_type = 'click') AS by_reference,
        count(*) FILTER (event_type IN ('purchase', 'signup')) AS by_text,
        (SELECT CASE event_type WHEN 'view' THEN 'IDENTITY_MISMATCH' ELSE 'ACTION_NOT_FOUND' END || ': user ' ||
          CAST(user_id AS STRING) FROM events WHERE event_type NOT IN ('click', 'purchase', 'signup')
          ORDER BY ts DESC, event_id DESC LIMIT 1) AS last_failure FROM events""",
    "g12_recent_samples": select(
        RAW,
        "SELECT row_id, detected_at, raw_title FROM leads_raw ORDER BY detected_at DESC, row_id DESC LIMIT 20",
    ),
    "g13_scan_summary": select(
        _OUTCOMES,
        """SELECT scan_id, count(*) FILTER (outcome = 'new') AS new_leads,
        epoch_us(max(moment)) // 1000 - epoch_us(min(moment)) // 1000 AS duration_ms FROM outcomes GROUP BY scan_id""",
    ),
    "l3_truncate": select(
        RAW,
        """SELECT row_id, CASE WHEN length(raw_title) > 20 THEN left(raw_title, 19) || '…' ELSE raw_title END AS short_title
        FROM leads_raw""",
    ),
    "l4_last_lines": """SELECT event_type, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS id
        FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 200""",
    "s7_lines_since": """SELECT event_type, ts, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS id
        FROM events QUALIFY id > 100""",
    "l5_action_lines": """SELECT event_id, CASE WHEN k IN (0, 2, 3) THEN 'INFO' WHEN k = 4 THEN 'SUCCESS' WHEN k = 5 THEN 'ERROR' ELSE 'WARN' END AS level,
        CASE k WHEN 0 THEN 'Auto-Click ON: matched leads will be contacted automatically' || CASE WHEN n > 0 THEN ' (' || n || ' queued)' ELSE '' END
          WHEN 1 THEN ['Auto-Click locked: licence not active', 'Auto-Click STOPPED by user', 'Auto-Click paused: running in another tab',
            'Auto-Click OFF'][why + 1] || CASE WHEN n > 0 THEN ' (' || n || ' cancelled)' ELSE '' END
          WHEN 2 THEN 'Contact Buyer attempt ' || attempt || ': ' || label
          ELSE 'Contact Buyer ' || ['queued', 'clicked', 'not clicked', 'will retry', 'skipped', 'cancelled'][k - 2] || ': ' || label
            || CASE WHEN k IN (5, 6, 7) AND event_id % 2 = 0 THEN ' — STALE_LEAD: ' || coalesce(event_type, '') ELSE '' END END AS message
        FROM (SELECT event_id, event_type, event_id % 9 AS k, event_id % 3 AS n, event_id % 4 AS attempt,
          CAST(event_id // 9 % 4 AS INT) AS why, 'lead of user ' || user_id AS label FROM events)""",
    "l2_update_lines": select(
        VERDICTS,
        f"""SELECT level, count(*) AS n FROM (SELECT unnest(['INFO']
          || CASE WHEN status <> previous THEN [CASE WHEN passed THEN 'SUCCESS' ELSE 'INFO' END] ELSE [] END
          || CASE WHEN passed AND priority <> before THEN ['SUCCESS'] ELSE [] END) AS level
        FROM (SELECT *, lag(status) OVER ({_SEEN}) AS previous, lag(priority) OVER ({_SEEN}) AS before FROM known)
        WHERE previous IS NOT NULL) GROUP BY level""",
    ),
    "x10_raw_measure": select(
        NORMALIZE, "SELECT row_id, any_value AS value, any_unit AS unit FROM measured"
    ),
    "x11_raw_lead_age": select(EXTRACT, "SELECT row_id, minutes FROM extracted"),
    "x12_field_states": select(
        EXTRACT,
        """SELECT row_id, title_state, country_state, age_state AS "leadAge_state", quantity_state, strength_state,
        failed_fields, warnings FROM extracted""",
    ),
    "x13_confidence": select(EXTRACT, "SELECT row_id, confidence FROM extracted"),
    "x14_completeness": select(EXTRACT, "SELECT row_id, completeness FROM extracted"),
    "a3_eligibility": select(
        VERDICTS,
        f"""SELECT k.row_id, v.status = 'MATCHED' IS TRUE AS eligible, CASE WHEN v.status IS NULL THEN 'STALE_LEAD'
        WHEN v.status <> 'MATCHED' THEN 'NOT_MATCHED' END AS code FROM known k LEFT JOIN (
        SELECT lead_id, row_id, status FROM known {_LATEST}) v
        ON v.lead_id = k.lead_id""",
    ),
}

_COUNTED = {
    "verdict": "SELECT CASE WHEN passed THEN 'matched' ELSE 'rejected' END AS name, 1 AS a FROM current_rows",
    "pass_reason": " UNION ALL ".join(
        [f"SELECT '{name}' AS name, 1 AS a FROM current_rows WHERE passed AND {ok}" for name, ok in _PASSES.items()]
        + [f"SELECT 'KEYWORD_MATCH', 1 FROM current_rows WHERE passed AND k{n} IS NOT NULL" for n in range(5)]
    ),
    "failed_group": "SELECT unnest(string_split(failed_groups, ',')) AS name, 1 AS a FROM current_rows WHERE NOT passed",
    "priority": "SELECT priority AS name, 1 AS a FROM current_rows",
    "warning": f"SELECT unnest(string_split({WARNINGS}, '; ')) AS name, 1 AS a FROM current_rows",
    "score": "SELECT 'sum' AS name, score AS a FROM current_rows UNION ALL SELECT 'n', 1 FROM current_rows WHERE score IS NOT NULL",
    "scan": "SELECT 'detected' AS name, 1 AS a FROM current_rows UNION ALL SELECT 'processed', 1 FROM known",
}
SQL["g14_running_totals"] = select(
    ",\n".join([VERDICTS, f"current_rows AS (SELECT * FROM known {_LATEST})"]),
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{counter}' AS counter, name, sum(a)::DOUBLE AS amount FROM ({rows}) GROUP BY name" for counter, rows in _COUNTED.items())
    + ") WHERE amount <> 0 AND name <> ''",
)

_FAILED = """failed AS (SELECT *, CASE WHEN number % 23 = 0 THEN 'payload: missing' WHEN number % 13 = 0 OR number % 19 = 0 THEN 'payload: not a lead'
  WHEN number % 17 = 0 THEN 'quantity: not a finite number' END AS error FROM (SELECT *, split_part(row_id, '-', 1)::BIGINT AS number FROM normalized))"""
_STEP = "CASE WHEN error LIKE 'payload%' THEN 'read' WHEN error IS NOT NULL THEN 'normalize' END AS failed_step"
SQL["n16_error_isolation"] = select(
    ",\n".join([NORMALIZE, _FAILED]),
    f"""SELECT row_id, {_STEP}, error, CASE WHEN error IS NOT NULL THEN number % 23 <> 0 END AS has_payload,
    CASE WHEN error IS NULL THEN title_normalized END AS title_normalized, CASE WHEN error IS NULL THEN quantity_value END AS quantity_value,
    CASE WHEN error IS NULL THEN country_code END AS country_code FROM failed""",
)
SQL["n16_failure_counts"] = select(
    ",\n".join([NORMALIZE, _FAILED]), f"SELECT {_STEP}, error, count(*) AS n FROM failed WHERE error IS NOT NULL GROUP BY ALL"
)

_REASON_LIST = """list_filter(CASE WHEN passed THEN [country_reason] || string_split(keyword_reasons, '; ') || [quantity_reason, contact_reason]
    ELSE [CASE WHEN NOT country_ok THEN country_reason END, CASE WHEN NOT keyword_ok THEN 'No keyword matched' END,
      CASE WHEN NOT quantity_ok THEN quantity_reason END, CASE WHEN NOT contact_ok THEN contact_reason END]
      || CASE WHEN negative_ok THEN [] ELSE string_split(negative_reasons, '; ') END END, lambda x: x IS NOT NULL)"""
_LABEL = f"coalesce({shown('raw_title')}, {shown('product_category')}, 'Untitled lead')"
_FACTS = "concat_ws(', ', 'Country: ' || nullif(country, ''), 'Quantity: ' || nullif(quantity_raw, ''))"
_CHANNELS = """concat_ws(', ', CASE WHEN mobile_available THEN 'Mobile' END, CASE WHEN whatsapp_available THEN 'WhatsApp' END,
    CASE WHEN email_available THEN 'Email' END)"""
_SCORE_TEXT = f"""'Score ' || CAST(score AS STRING) || '/100 (' || priority || '): ' || array_to_string(list_transform(list_sort(
    list_filter([{_EARNED}], lambda x: x.p < 0)), lambda x: x.t), ', ')"""
SQL["l1_processed_lines"] = select(
    ",\n".join([SCORE, EXTRACTED.replace("FROM normalized)", "FROM scored)")]),
    f"""SELECT line.level, line.message, count(*) AS n FROM (SELECT unnest(list_filter([
      struct_pack(level := 'SUCCESS', message := 'Lead detected: ' || CASE WHEN length(label) > 70 THEN left(label, 69) || '…' ELSE label END),
      struct_pack(level := 'INFO', message := nullif(facts, '')),
      struct_pack(level := 'INFO', message := CASE WHEN channels = '' THEN 'No contact channels listed' ELSE channels || ' available' END)]
    || list_transform(failures, lambda f: struct_pack(level := 'WARN', message := 'Extraction failed: ' || f))
    || [CASE WHEN len(failures) = 0 THEN struct_pack(level := 'SUCCESS', message := 'Lead processed')
        ELSE struct_pack(level := 'WARN', message := 'Lead processed with ' || len(failures) || ' warning' || CASE WHEN len(failures) > 1 THEN 's' ELSE '' END) END,
      struct_pack(level := CASE WHEN passed THEN 'SUCCESS' ELSE 'INFO' END, message := 'Filter ' || CASE WHEN passed THEN 'matched' ELSE 'rejected' END || ': ' ||
        array_to_string(list_slice(reasons, 1, 4), '; ') || CASE WHEN len(reasons) > 4 THEN '; +' || (len(reasons) - 4) || ' more' ELSE '' END),
      struct_pack(level := 'SUCCESS', message := CASE WHEN passed THEN scored_as END)], lambda x: x.message IS NOT NULL)) AS line
    FROM (SELECT *, {_LABEL} AS label, {_FACTS} AS facts, {_CHANNELS} AS channels, {_REASON_LIST} AS reasons, {_SCORE_TEXT} AS scored_as,
      list_filter(string_split(warnings, '; '), lambda w: w <> '') AS failures FROM extracted)) GROUP BY ALL""",
)

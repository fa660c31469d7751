"""SQL for DuckDB that states the expected rows of the lead queries, from the given tables."""

from __future__ import annotations

from tradesift.functions.lookups import DOSAGE_FORMS, STRENGTH_UNITS, UNITS, country_rows


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(name: str, columns: str, rows) -> str:
    lines = ", ".join("(" + ", ".join(quoted(cell) for cell in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {lines})"


LINE_ID = """CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||
  CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-' ||
  CAST(CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS STRING)"""

LEADS_RAW = f"""leads_raw AS (SELECT
  {LINE_ID} AS row_id,
  'card_' || CAST(l.l_suppkey AS STRING) AS card_id,
  CASE WHEN l.l_orderkey % 97 = 0 THEN NULL ELSE
    '  ' || p.p_name || ' ' || CAST(p.p_size AS STRING) || 'mg ' ||
    CASE p.p_type WHEN 'PROMO' THEN 'Tablets' WHEN 'ECONOMY' THEN 'Capsule'
      WHEN 'MEDIUM' THEN 'Injections' WHEN 'SMALL' THEN 'Tabletop'
      WHEN 'LARGE' THEN 'Cream' ELSE 'Medicine' END ||
    CASE l.l_orderkey % 11 WHEN 0 THEN ' for Personal Use' WHEN 1 THEN ' retailer' ELSE '' END
  END AS raw_title,
  CASE n.n_nationkey % 13 WHEN 0 THEN 'USA' WHEN 1 THEN 'U.S.A.' WHEN 2 THEN 'Canada'
    WHEN 3 THEN 'U.K.' WHEN 4 THEN 'The Netherlands' WHEN 5 THEN 'Qatar' WHEN 6 THEN 'Atlantis'
    WHEN 7 THEN 'Australia' WHEN 8 THEN 'New  Zealand' WHEN 9 THEN 'Great Britain'
    WHEN 10 THEN 'Korea' WHEN 11 THEN 'Trinidad & Tobago' ELSE NULL END AS country,
  CASE l.l_linenumber % 7 WHEN 0 THEN NULL
    WHEN 1 THEN CAST(CAST(l.l_quantity AS INT) AS STRING) || ' Strip'
    WHEN 2 THEN CAST(CAST(l.l_quantity AS INT) AS STRING) || ' Boxes'
    WHEN 3 THEN '1,0' || CAST(10 + CAST(l.l_quantity AS INT) % 90 AS STRING) || ' Pcs'
    WHEN 4 THEN '10-20 Strips'
    WHEN 5 THEN CAST(CAST(l.l_quantity AS INT) AS STRING) || ' to 60 Boxes'
    ELSE CAST(CAST(l.l_quantity AS INT) AS STRING) || ' Crates' END AS quantity_raw,
  CASE o.o_orderkey % 9 WHEN 0 THEN 'just now' WHEN 1 THEN '22 mins ago'
    WHEN 2 THEN 'an hour ago' WHEN 3 THEN '3 days ago' WHEN 4 THEN '2 months ago'
    WHEN 5 THEN 'yesterday' WHEN 6 THEN '12 Sep' WHEN 7 THEN NULL
    ELSE CAST(l.l_linenumber AS STRING) || ' weeks ago' END AS raw_lead_age,
  CASE l.l_returnflag WHEN 'A' THEN NULL WHEN 'N' THEN p.p_brand
    ELSE 'Pharmaceutical ' || p.p_brand END AS category,
  CASE WHEN l.l_linenumber % 2 = 0 THEN p.p_type ELSE NULL END AS product_category,
  CASE c.c_mktsegment WHEN 'FURNITURE' THEN NULL
    WHEN 'BUILDING' THEN 'Paracetamol Tablet, Ibuprofen Tablet'
    WHEN 'MACHINERY' THEN 'Home, Use Kit,,' ELSE 'Minoxidil Solution' END AS buys_raw,
  CASE p.p_size % 6 WHEN 0 THEN '36 IU (12 mg)' WHEN 1 THEN CAST(p.p_size AS STRING) || 'mg'
    WHEN 2 THEN '20mg + 10mg' WHEN 3 THEN '250 Mg/ml' WHEN 4 THEN 'High' ELSE NULL END
    AS strength_raw,
  CASE p.p_size % 4 WHEN 0 THEN 'TABLETS' WHEN 1 THEN 'Film Coated Tablet'
    WHEN 2 THEN 'Soft Gel' ELSE NULL END AS dosage_form,
  (l.l_tax > 0.02) AS mobile_available, (l.l_discount > 0.04) AS whatsapp_available,
  (l.l_returnflag <> 'R') AS email_available,
  o.o_orderdate AS detected_at
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN part p ON l.l_partkey = p.p_partkey)"""


def shown(column: str) -> str:
    return rf"nullif(trim(regexp_replace({column}, '\s+', ' ', 'g')), '')"


def alias(column: str) -> str:
    spelled = f"replace(replace(lower({shown(column)}), '.', ''), '&', ' and ')"
    spaced = rf"trim(regexp_replace({spelled}, '[\s_-]+', ' ', 'g'))"
    return f"nullif(regexp_replace({spaced}, '^the ', ''), '')"


COUNTRIES = values("countries", "alias_key, code, name, name_key", country_rows())
UNIT_ROWS = values("units", "spelling, unit", UNITS.items())
STRENGTH_ROWS = values("strength_units", "spelling, unit", STRENGTH_UNITS.items())
FORM_ROWS = values("forms", "spelling, form", DOSAGE_FORMS.items())

MEASURE = r"^(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?\s*(.*)$"


def measured(column: str) -> tuple[str, str]:
    """Number and unit of a cleaned text, both null when it is not a measure."""
    digits = (
        f"replace(regexp_extract({column}, '{MEASURE}', 1), ',', '') || "
        f"CASE WHEN regexp_extract({column}, '{MEASURE}', 2) = '' THEN '' "
        f"ELSE '.' || regexp_extract({column}, '{MEASURE}', 2) END"
    )
    unit = f"trim(regexp_extract({column}, '{MEASURE}', 3))"
    good = (
        f"regexp_matches({column}, '{MEASURE}') AND ({unit} = '' OR (length({unit}) <= 40 AND "
        rf"regexp_matches({unit}, '^[\pL%µ][\pL\pN%µ ./]*$')))"
    )
    return (
        f"CASE WHEN {good} THEN TRY_CAST({digits} AS DOUBLE) END",
        f"CASE WHEN {good} THEN nullif({unit}, '') END",
    )


AGE = r"^(\d+|an?|one)\s*([a-z]+)\s+ago$"
UNIT_MINUTES = """CASE
  WHEN {unit} IN ('s','sec','secs','second','seconds') THEN 1 / 60.0::DOUBLE
  WHEN {unit} IN ('m','min','mins','minute','minutes') THEN 1
  WHEN {unit} IN ('h','hr','hrs','hour','hours') THEN 60
  WHEN {unit} IN ('d','day','days') THEN 1440
  WHEN {unit} IN ('w','wk','wks','week','weeks') THEN 10080
  WHEN {unit} IN ('mo','mos','month','months') THEN 43200
  WHEN {unit} IN ('y','yr','yrs','year','years') THEN 525600 END"""
CALENDAR = "('mo','mos','month','months','y','yr','yrs','year','years')"

NUMBER = r"\d+(?:\.\d+)?"
UNIT = r"[a-zµμ%][a-zµμ%.]*(?:\s*/\s*\d*\s*[a-zµμ]+)?|%\s*[wv]/[wv]"
SIMPLE = rf"(?i)^({NUMBER})\s*({UNIT})$"
EQUIVALENT = rf"(?i)^({NUMBER})\s*({UNIT})\s*\(\s*({NUMBER})\s*({UNIT})\s*\)$"
COMBINED = rf"(?i)^({NUMBER})\s*({UNIT})\s*(\+|&|/|,|and)\s*({NUMBER})\s*({UNIT})$"


def strength_unit(text: str) -> str:
    """Canonical unit or null when unknown."""
    compact = rf"regexp_replace(lower({text}), '\s+', '', 'g')"
    below = f"split_part({compact}, '/', 2)"
    find = "(SELECT unit FROM strength_units WHERE spelling = {})".format
    letters = rf"regexp_extract({below}, '^(\d*)([a-z]+)$', 2)"
    digits = rf"regexp_extract({below}, '^(\d*)([a-z]+)$', 1)"
    ratio = f"{find(f'''split_part({compact}, '/', 1)''')} || '/' || {digits} || {find(letters)}"
    return f"coalesce({find(compact)}, {ratio})"


def compact_unit(text: str) -> str:
    return rf"regexp_replace(lower({text}), '\s+', '', 'g')"


STRENGTHS = f"""strengths AS (
  SELECT DISTINCT {shown("strength_raw")} AS s FROM leads_raw WHERE {shown("strength_raw")} IS NOT NULL),
strength_parts AS (
  SELECT s, regexp_extract(s, '{COMBINED}', 1) c1, regexp_extract(s, '{COMBINED}', 2) c2,
    regexp_extract(s, '{COMBINED}', 3) sep, regexp_extract(s, '{COMBINED}', 4) c4,
    regexp_extract(s, '{COMBINED}', 5) c5,
    regexp_extract(s, '{EQUIVALENT}', 1) e1, regexp_extract(s, '{EQUIVALENT}', 2) e2,
    regexp_extract(s, '{EQUIVALENT}', 3) e3, regexp_extract(s, '{EQUIVALENT}', 4) e4,
    regexp_extract(s, '{SIMPLE}', 1) p1, regexp_extract(s, '{SIMPLE}', 2) p2
  FROM strengths),
strength_units_read AS (
  SELECT *, {strength_unit("c2")} k2, {strength_unit("c5")} k5, {strength_unit("e2")} k_e2,
    {strength_unit("e4")} k_e4, {strength_unit("p2")} k_p2 FROM strength_parts),
strength_read AS (
  SELECT *, CASE
    WHEN c1 <> '' AND (sep <> '/' OR coalesce(k2, {compact_unit("c2")}) = coalesce(k5, {compact_unit("c5")}))
      THEN 'combined' WHEN e1 <> '' THEN 'equivalent' WHEN p1 <> '' THEN 'simple' END AS kind
  FROM strength_units_read),
strength_table AS (
  SELECT s AS strength_text,
    TRY_CAST(CASE kind WHEN 'combined' THEN c1 WHEN 'equivalent' THEN e1 WHEN 'simple' THEN p1 END AS DOUBLE) strength_value,
    CASE kind WHEN 'combined' THEN coalesce(k2, {compact_unit("c2")})
      WHEN 'equivalent' THEN coalesce(k_e2, {compact_unit("e2")})
      WHEN 'simple' THEN coalesce(k_p2, {compact_unit("p2")}) END strength_unit,
    TRY_CAST(CASE kind WHEN 'combined' THEN c4 WHEN 'equivalent' THEN e3 END AS DOUBLE) strength_secondary_value,
    CASE kind WHEN 'combined' THEN coalesce(k5, {compact_unit("c5")})
      WHEN 'equivalent' THEN coalesce(k_e4, {compact_unit("e4")}) END strength_secondary_unit,
    coalesce(kind IN ('combined', 'equivalent'), FALSE) strength_complex,
    CASE WHEN kind IS NULL THEN 'strength: unrecognized format'
      WHEN kind = 'simple' THEN CASE WHEN k_p2 IS NULL THEN 'strength: unrecognized unit' ELSE '' END
      WHEN kind = 'combined' THEN concat_ws('; ', 'strength: combination',
        CASE WHEN k2 IS NULL THEN 'strength: unrecognized unit' END,
        CASE WHEN k5 IS NULL THEN 'strength: unrecognized unit' END)
      ELSE concat_ws('; ', 'strength: complex format (value with equivalent)',
        CASE WHEN k_e2 IS NULL THEN 'strength: unrecognized unit' END,
        CASE WHEN k_e4 IS NULL THEN 'strength: unrecognized unit' END) END strength_warnings
  FROM strength_read)"""

_VALUE, _UNIT = measured("quantity_shown")
NORMALIZED = f"""texts AS (
  SELECT *, lower({shown("raw_title")}) AS title_normalized,
    {shown("country")} AS country_shown, {alias("country")} AS country_alias,
    {shown("quantity_raw")} AS quantity_shown, {shown("category")} AS category_text,
    {shown("product_category")} AS product_category_text, {alias("dosage_form")} AS form_key,
    lower({shown("raw_lead_age")}) AS age_text, {shown("strength_raw")} AS strength_text,
    list_filter(list_transform(string_split(coalesce(buys_raw, ''), ','),
      lambda x: {shown("x")}), lambda x: x IS NOT NULL) AS buyer_products
  FROM leads_raw),
measured AS (
  SELECT *, {_VALUE} AS any_value, {_UNIT} AS any_unit,
    regexp_extract(age_text, '{AGE}', 1) AS age_amount,
    regexp_extract(age_text, '{AGE}', 2) AS age_unit
  FROM texts),
singles AS (
  SELECT *, coalesce(regexp_matches(any_unit, '(?i)^(?:to|[-–—])\\s*\\d'), FALSE) AS is_range,
    CASE WHEN is_range THEN NULL ELSE any_value END AS quantity_value,
    CASE WHEN is_range THEN NULL ELSE any_unit END AS quantity_unit,
    {UNIT_MINUTES.format(unit="age_unit")} AS age_factor
  FROM measured),
normalized AS (
  SELECT s.*, coalesce(c.name, country_shown) AS country_normalized, c.code AS country_code,
    coalesce(c.name_key, country_alias) AS country_key,
    CASE WHEN country_shown IS NOT NULL AND c.code IS NULL THEN 'country: not in alias map' END AS country_warning,
    CASE WHEN quantity_unit IS NULL THEN NULL
      ELSE coalesce(u.unit, w.unit, {alias("quantity_unit")}) END AS quantity_normalized_unit,
    CASE WHEN quantity_shown IS NULL THEN NULL
      WHEN quantity_value IS NULL THEN 'quantity: not a single number with a unit'
      WHEN quantity_unit IS NULL THEN 'quantity: no unit'
      WHEN u.unit IS NOT NULL THEN NULL
      WHEN w.unit IS NOT NULL THEN 'quantity: unit has extra detail'
      ELSE 'quantity: unrecognized unit' END AS quantity_warning,
    t.* EXCLUDE (strength_text), coalesce(f.form, form_key) AS dosage_form_normalized,
    CASE WHEN form_key IS NOT NULL AND f.form IS NULL THEN 'dosageForm: unrecognized form' END AS dosage_form_warning,
    CASE WHEN buys_raw IS NOT NULL AND len(buyer_products) = 0 THEN 'buys: no products in value' END AS buys_warning,
    CASE WHEN age_text IN ('just now', 'now') THEN 0.0
      WHEN age_amount = '' THEN NULL
      WHEN age_unit IN {CALENDAR} THEN coalesce(TRY_CAST(age_amount AS DOUBLE), 1.0) * age_factor
      ELSE floor(coalesce(TRY_CAST(age_amount AS DOUBLE), 1.0) * age_factor + 0.5) END AS age_minutes,
    coalesce(age_unit IN {CALENDAR}, FALSE) AS age_approximate,
    CASE WHEN age_text IS NULL OR age_text IN ('just now', 'now') THEN NULL
      WHEN age_text IN ('today', 'yesterday') THEN 'leadAge: imprecise (needs current date)'
      WHEN age_amount = '' THEN 'leadAge: unrecognized format'
      WHEN age_unit IN {CALENDAR} THEN 'leadAge: approximate (calendar unit)'
      WHEN age_factor IS NULL THEN 'leadAge: unrecognized unit' END AS age_warning
  FROM singles s
  LEFT JOIN countries c ON c.alias_key = s.country_alias
  LEFT JOIN units u ON u.spelling = {alias("s.quantity_unit")}
  LEFT JOIN units w ON w.spelling = {alias("split_part(s.quantity_unit, ' ', 1)")}
  LEFT JOIN strength_table t ON t.strength_text = s.strength_text
  LEFT JOIN forms f ON f.spelling = s.form_key)"""

NORMALIZE = ",\n".join(
    [LEADS_RAW, COUNTRIES, UNIT_ROWS, STRENGTH_ROWS, FORM_ROWS, STRENGTHS, NORMALIZED]
)

WARNINGS = """concat_ws('; ', country_warning, quantity_warning, nullif(strength_warnings, ''),
  dosage_form_warning, buys_warning, age_warning)"""


# --- filter ---


def forms_of(word: str) -> str:
    """Regular plural forms of one word, stated as the three rules of the match."""
    found = [word, word + "s", word + "es"]
    found += [word[:-1]] if word.endswith("s") else []
    found += [word[:-2]] if word.endswith("es") else []
    found += [word[:-1] + "ies"] if word.endswith("y") else []
    found += [word[:-3] + "y"] if word.endswith("ies") else []
    return "(?:" + "|".join(dict.fromkeys(found)) + ")"


def phrase(keyword: str) -> str:
    return " (" + " ".join(forms_of(word) for word in keyword.lower().split()) + ") "


def word_line(text: str) -> str:
    return rf"' ' || array_to_string(regexp_extract_all(lower(coalesce({text}, '')), '[\pL\pN]+'), ' ') || ' '"


LINES = f"""lines AS (
  SELECT *, {word_line("title_normalized")} AS w_title,
    {word_line("product_category_text")} AS w_product, {word_line("category_text")} AS w_category,
    coalesce(array_to_string(list_transform(buyer_products, lambda x: {word_line("x")}), '|'), '') AS w_buys
  FROM normalized)"""
FIELD_LINES = {
    "title": "w_title",
    "productCategory": "w_product",
    "category": "w_category",
    "buyerProducts": "w_buys",
}


def hit_field(keyword: str, fields) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({FIELD_LINES[name]}, '{phrase(keyword)}') THEN '{name}'" for name in fields
    )
    return f"CASE {cases} END"


def hit_text(keyword: str, fields) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({FIELD_LINES[name]}, '{phrase(keyword)}') "
        f"THEN regexp_extract({FIELD_LINES[name]}, '{phrase(keyword)}', 1)"
        for name in fields
    )
    return f"CASE {cases} END"


WANTED = ["Medicine", "Tablet", "Capsule", "Injection", "Pharmaceutical"]
WANTED_FIELDS = ["title", "productCategory", "category", "buyerProducts"]
UNWANTED = ["Retail", "Personal Use", "Home Use"]
UNWANTED_FIELDS = ["title", "productCategory", "category"]
_K = {f"k{n}": word for n, word in enumerate(WANTED)}
_N = {f"n{n}": word for n, word in enumerate(UNWANTED)}
HITS = "hits AS (SELECT *, " + ", ".join(
    [f"{hit_field(word, WANTED_FIELDS)} AS {name}" for name, word in _K.items()]
    + [f"{hit_field(word, UNWANTED_FIELDS)} AS {name}" for name, word in _N.items()]
) + " FROM lines)"


def number(column: str) -> str:
    return (
        f"CASE WHEN {column} = floor({column}) THEN CAST(CAST({column} AS BIGINT) AS STRING) "
        f"ELSE CAST({column} AS STRING) END"
    )


_KEYWORD_MESSAGES = ", ".join(
    f"CASE WHEN {name} IS NOT NULL THEN 'Keyword matched: {word} (' || {name} || ')' END"
    for name, word in _K.items()
)
_NEGATIVE_MESSAGES = ", ".join(
    f"CASE WHEN {name} IS NOT NULL THEN 'Excluded keyword detected: {word} (' || {name} || ')' END"
    for name, word in _N.items()
)
_MATCHED = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN '{w}' END" for n, w in _K.items())
_DETECTED = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN '{w}' END" for n, w in _N.items())

EVALUATED = f"""groups AS (
  SELECT *, coalesce(country_code IN ('CA', 'US', 'GB', 'AU', 'NZ'), FALSE) AS country_ok,
    coalesce({", ".join(_K)}) IS NOT NULL AS keyword_ok,
    coalesce({", ".join(_N)}) IS NULL AS negative_ok,
    coalesce(quantity_value >= 20, FALSE) AS quantity_ok,
    (mobile_available OR whatsapp_available OR email_available) AS contact_ok
  FROM hits),
evaluated AS (
  SELECT *, country_ok AND keyword_ok AND quantity_ok AND contact_ok AND negative_ok AS passed,
    CASE WHEN passed THEN 'MATCHED' ELSE 'REJECTED' END AS status,
    CASE WHEN country_normalized IS NULL THEN 'Country unavailable'
      WHEN country_ok THEN 'Country matched: ' || country_normalized
      ELSE 'Country not allowed: ' || country_normalized END AS country_reason,
    concat_ws('; ', {_KEYWORD_MESSAGES}, CASE WHEN NOT keyword_ok THEN 'No keyword matched' END) AS keyword_reasons,
    CASE WHEN quantity_value IS NULL AND quantity_raw IS NULL THEN 'Quantity unavailable'
      WHEN quantity_value IS NULL THEN 'Quantity not a single number: ' || quantity_raw
      WHEN quantity_value < 20 THEN 'Quantity ' || {number("quantity_value")} || ' < minimum 20'
      ELSE concat_ws(' ', 'Quantity', {number("quantity_value")}, quantity_unit, '≥ 20') END AS quantity_reason,
    CASE WHEN contact_ok THEN 'Contact: ' || concat_ws(', ', CASE WHEN mobile_available THEN 'Mobile' END,
        CASE WHEN whatsapp_available THEN 'WhatsApp' END, CASE WHEN email_available THEN 'Email' END) || ' available'
      ELSE 'Contact requirement failed: none of Mobile, WhatsApp, Email available' END AS contact_reason,
    concat_ws('; ', {_NEGATIVE_MESSAGES}, CASE WHEN negative_ok THEN 'No excluded keywords' END) AS negative_reasons,
    concat_ws(',', {_MATCHED}) AS matched_keywords, concat_ws(',', {_DETECTED}) AS negative_keywords,
    concat_ws(',', CASE WHEN NOT country_ok THEN 'countries' END, CASE WHEN NOT keyword_ok THEN 'keywords' END,
      CASE WHEN NOT quantity_ok THEN 'quantity' END, CASE WHEN NOT contact_ok THEN 'contact' END,
      CASE WHEN NOT negative_ok THEN 'negativeKeywords' END) AS failed_groups
  FROM groups)"""

EVALUATE = ",\n".join([NORMALIZE, LINES, HITS, EVALUATED])

# --- score ---

SHORT = {
    "country": "country", "quantity": "quantity", "mobile": "mobile", "whatsapp": "WhatsApp",
    "email": "email", "keyword": "keyword", "category": "category",
    "buyers": "buyer products", "age": "lead age",
}
WEIGHTS = {
    "country": 25, "quantity": 20, "mobile": 10, "whatsapp": 15, "email": 10, "keyword": 8,
    "category": 5, "buyers": 3, "age": 4,
}
FRACTIONS = {
    "country": "CASE WHEN country_ok THEN 1 ELSE 0 END",
    "quantity": "coalesce(least(greatest(quantity_value, 0) / 100.0::DOUBLE, 1), 0)",
    "mobile": "CAST(mobile_available AS INT)",
    "whatsapp": "CAST(whatsapp_available AS INT)",
    "email": "CAST(email_available AS INT)",
    "keyword": "CASE WHEN keyword_ok THEN 1 ELSE 0 END",
    "category": "CASE WHEN coalesce(category_text, product_category_text) IS NULL THEN 0 ELSE 1 END",
    "buyers": "CASE WHEN len(buyer_products) > 0 THEN 1 ELSE 0 END",
    "age": """CASE WHEN age_minutes IS NULL OR age_approximate THEN 0 WHEN age_minutes <= 15 THEN 1
      WHEN age_minutes <= 60 THEN 0.75 WHEN age_minutes <= 180 THEN 0.5
      WHEN age_minutes <= 1440 THEN 0.25 ELSE 0 END""",
}
_POINTS = ", ".join(
    f"CAST(floor({WEIGHTS[name]} * CAST({fraction} AS DOUBLE) * 100 + 0.5) AS BIGINT) AS h_{name}"
    for name, fraction in FRACTIONS.items()
)
SCORED = f"""points AS (SELECT *, {_POINTS} FROM evaluated),
scored AS (
  SELECT *, {" + ".join(f"h_{name}" for name in WEIGHTS)} AS hundredths,
    CASE WHEN passed THEN CAST(floor(hundredths / 100.0::DOUBLE + 0.5) AS INT) END AS score,
    CASE WHEN NOT passed THEN 'REJECTED' WHEN score >= 90 THEN 'CRITICAL' WHEN score >= 75 THEN 'HIGH'
      WHEN score >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS priority
  FROM points)"""
SCORE = ",\n".join([EVALUATE, SCORED])


def select(ctes: str, body: str) -> str:
    return f"WITH {ctes}\n{body}"

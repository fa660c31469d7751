"""Expected rows of the licence, action, page and card queries."""

from oracle.leads import LEADS_RAW, LINE_ID, NORMALIZE, quoted, select, shown
from tradesift.operators.licences import STATUS_MESSAGES
from tradesift.plans.licence_queries import NOW_MS, PEPPER

TABLES = f"""customers AS (SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@example.org' AS email,
  c_mktsegment AS company FROM customer),
licences AS (
  SELECT o_orderkey AS id, o_custkey AS customer_id,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Pro' ELSE 'Standard' END AS plan,
    CASE WHEN o_orderkey % 17 = 0 THEN 'REVOKED' WHEN o_orderkey % 13 = 0 THEN 'SUSPENDED'
         WHEN o_orderkey % 7 = 0 THEN 'DISABLED' ELSE 'ACTIVE' END AS status,
    CAST(o_orderdate AS DATE) + CAST(CASE o_orderkey % 4 WHEN 0 THEN 30 WHEN 1 THEN 90
         WHEN 2 THEN 365 ELSE 3650 END AS INT) AS expires_on,
    CAST(1 + o_orderkey % 3 AS INT) AS max_devices, o_orderdate AS created_at,
    CASE WHEN status = 'ACTIVE' AND CAST(expires_on AS DATE) <= DATE '2000-01-01' THEN 'EXPIRED' ELSE status END AS effective_status
  FROM orders),
bindings AS (
  SELECT {LINE_ID} AS id, l_orderkey AS licence_id,
    CASE l_linestatus WHEN 'O' THEN 'ACTIVE' ELSE 'RELEASED' END AS status, l_shipdate AS last_seen_at
  FROM lineitem),
audit AS (
  SELECT event_id AS id, ts AS moment, user_id AS customer_id,
    CASE event_type WHEN 'signup' THEN 'LICENCE_CREATED' WHEN 'purchase' THEN 'LICENCE_EXTENDED'
      WHEN 'error' THEN 'ACTIVATION_REFUSED' WHEN 'click' THEN 'LICENCE_ACTIVATED' ELSE 'ADMIN_LOGIN' END AS action,
    CASE event_type WHEN 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS result
  FROM events),
counted AS (SELECT licence_id, count(*) AS devices, count(*) FILTER (status = 'ACTIVE') AS active_devices,
  max(last_seen_at) AS last_validation_at FROM bindings GROUP BY licence_id),
rows AS (SELECT l.*, c.name AS customer, c.email, c.company, coalesce(d.active_devices, 0) AS active_devices
  FROM licences l LEFT JOIN customers c ON c.id = l.customer_id LEFT JOIN counted d ON d.licence_id = l.id)"""


def message(status: str) -> str:
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in STATUS_MESSAGES.items())
    return f"CASE {status} {cases} END"


def licence(body: str) -> str:
    return select(TABLES, body)


_KEY = PEPPER.encode().ljust(64, b"\0")
_INNER = bytes(b ^ 0x36 for b in _KEY).hex()
_OUTER = bytes(b ^ 0x5C for b in _KEY).hex()
_CODE = r"regexp_replace(upper(trim(code)), '\s+', '', 'g')"
_MATCHES = """matches AS (SELECT 'm-' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS match_event_id,
  event_id AS row_id, user_id, ts AS moment FROM events WHERE event_type NOT IN ('signup', 'error')),
switches AS (SELECT user_id, ts AS changed_at, max(CASE WHEN event_type = 'signup' THEN 'ON'
  WHEN event_id % 2 = 0 THEN 'LOCKED' ELSE 'OFF' END) AS state FROM events WHERE event_type IN ('signup', 'error') GROUP BY ALL),
states AS (SELECT m.row_id, coalesce(s.state, 'ON') AS state FROM matches m ASOF LEFT JOIN switches s
  ON m.user_id = s.user_id AND m.moment >= s.changed_at)"""
_ATTEMPTS = """attempts AS (SELECT l_orderkey AS action_id, l_linenumber AS attempt,
  [NULL, 'STALE_LEAD', 'STALE_LEAD', 'ACTION_NOT_FOUND', 'CLICK_FAILED'][1 + max(l_partkey) % 5] AS code,
  min(l_shipdate) AS moment FROM lineitem GROUP BY ALL),
judged AS (SELECT *, CASE WHEN code IS NULL THEN 'SUCCESS'
  WHEN code IN ('STALE_LEAD', 'ACTION_NOT_FOUND') AND attempt <= 2 THEN 'RETRYING' ELSE 'FAILED' END AS status FROM attempts),
actions AS (SELECT action_id, arg_max(status, attempt) AS status, max(attempt) AS attempts,
  (SELECT j.code FROM judged j WHERE j.action_id = g.action_id ORDER BY attempt DESC LIMIT 1) AS error_code,
  coalesce(min(attempt) FILTER (status <> 'RETRYING') < max(attempt), FALSE) AS illegal,
  min(moment) AS started_at, max(moment) AS completed_at FROM judged g GROUP BY action_id)"""
_SIGNALS = """0.25 * (raw_title IS NOT NULL)::INT + 0.2 * (country IS NOT NULL)::INT + 0.15 * (quantity_raw IS NOT NULL)::INT
  + 0.15 * (buys_raw IS NOT NULL)::INT + 0.1 * ({category})::INT + 0.05 * ({contact})::INT"""
# an age that does not read like a relative time is taken for the country when it stands first there
_RELATIVE = "coalesce(raw_lead_age NOT IN ('an hour ago', '12 Sep'), TRUE)"


def card(number: str, country: str, age_sure: str, buys_sure: str) -> str:
    weight = f"""0.25 * (raw_title IS NOT NULL)::INT + 0.2 * ({country} IS NOT NULL)::INT
      + 0.15 * (quantity_raw IS NOT NULL)::INT + 0.15 * (buys_raw IS NOT NULL)::INT
      + 0.1 * (coalesce(category, product_category) IS NOT NULL)::INT
      + 0.05 * (mobile_available OR whatsapp_available OR email_available)::INT"""
    both = "category IS NOT NULL AND product_category IS NOT NULL"
    return f"""SELECT row_id AS page_id, {number} AS card_no, {shown("raw_title")} AS raw_title, {shown(country)} AS country,
      CASE WHEN {_RELATIVE} THEN raw_lead_age END AS raw_lead_age,
      CASE WHEN {both} AND category <> product_category THEN category ELSE coalesce(category, product_category) END AS category,
      CASE WHEN {both} AND category <> product_category THEN product_category END AS product_category,
      quantity_raw, strength_raw, dosage_form, buys_raw, mobile_available, whatsapp_available, email_available,
      CASE WHEN raw_lead_age IS NULL OR NOT {_RELATIVE} THEN 0.0 ELSE {age_sure} END::DOUBLE AS "sure_leadAge",
      {buys_sure}::DOUBLE AS sure_buys FROM leads_raw WHERE {weight} >= 0.5"""


_LIMITED = f"""hits AS (SELECT CAST(user_id AS STRING) AS key, epoch_us(ts) // 1000 AS at_ms, count(*) AS hits FROM events GROUP BY ALL),
starts AS (SELECT key, min(at_ms) AS at_ms FROM hits GROUP BY key
  UNION ALL SELECT key, at_ms FROM (SELECT s.key, (SELECT min(h.at_ms) FROM hits h WHERE h.key = s.key AND h.at_ms >= s.at_ms + 21600000) AS at_ms FROM starts s)
  WHERE at_ms IS NOT NULL),
placed AS (SELECT h.*, s.at_ms AS start FROM hits h ASOF JOIN starts s ON h.key = s.key AND h.at_ms >= s.at_ms),
used AS (SELECT *, coalesce(sum(hits) OVER (PARTITION BY key, start ORDER BY at_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM placed),
limited AS (SELECT key, at_ms, hits, least(hits, greatest(0, 2 - used))::BIGINT AS allowed, (hits - least(hits, greatest(0, 2 - used)))::BIGINT AS refused FROM used)"""


SQL = {
    "b21_request_limit": f"WITH RECURSIVE {_LIMITED} SELECT * FROM limited",
    "b21_stream_request_limit": f"WITH RECURSIVE {_LIMITED} SELECT key, sum(allowed)::BIGINT AS allowed FROM limited GROUP BY key",
    "b1_effective_status": licence("SELECT id, effective_status FROM licences"),
    "b2_status_message": licence(f"SELECT id, {message('effective_status')} AS message FROM licences"),
    "b3_licence_rows": licence(
        "SELECT id, customer_id, plan, status, effective_status, customer, email, company, active_devices FROM rows"
    ),
    "b4_licence_search": licence(
        """SELECT id, customer, effective_status FROM rows WHERE effective_status = 'EXPIRED' AND
        (lower(CAST(id AS STRING)) LIKE '%build%' OR lower(plan) LIKE '%build%' OR lower(customer) LIKE '%build%'
         OR lower(email) LIKE '%build%' OR lower(company) LIKE '%build%')"""
    ),
    "b5_customer_search": licence(
        """SELECT c.id AS customer_id, name, email, company, coalesce(n, 0) AS licence_count, newest.id AS licence_id,
        newest.plan AS licence_plan, newest.effective_status AS licence_status, coalesce(d.active, 0) AS device_count
        FROM customers c LEFT JOIN (SELECT customer_id, count(*) AS n, bool_or(CAST(id AS STRING) LIKE '%12%') AS hit,
          arg_max({'id': id, 'plan': plan, 'effective_status': effective_status}, (created_at, id)) AS newest
          FROM licences GROUP BY customer_id) l ON l.customer_id = c.id
        LEFT JOIN (SELECT customer_id, sum(active_devices) AS active FROM rows GROUP BY customer_id) d ON d.customer_id = c.id
        WHERE lower(name) LIKE '%12%' OR email LIKE '%12%' OR lower(company) LIKE '%12%' OR hit"""
    ),
    "b6_device_search": licence(
        """SELECT b.id, licence_id, b.status, left(sha256(CAST(licence_id AS STRING)), 10) || '…' AS device, c.name AS customer
        FROM bindings b LEFT JOIN licences l ON l.id = b.licence_id LEFT JOIN customers c ON c.id = l.customer_id
        WHERE b.status = 'ACTIVE' AND (lower(c.name) LIKE '%00%' OR CAST(licence_id AS STRING) LIKE '%00%'
          OR left(sha256(CAST(licence_id AS STRING)), 10) LIKE '%00%')"""
    ),
    "b7_licence_details": licence(
        """SELECT l.id, effective_status, last_validation_at, coalesce(devices, 0) AS devices,
        coalesce(active_devices, 0) AS active_devices FROM licences l LEFT JOIN counted d ON d.licence_id = l.id"""
    ),
    "b7_recent_audit": licence(
        """SELECT customer_id, id, action FROM audit
        QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY moment DESC, id DESC) <= 50"""
    ),
    "b8_statistics": licence(
        "SELECT count(*) AS total, "
        + ", ".join(
            f"count(*) FILTER (effective_status = '{s}') AS {s.lower()}"
            for s in ("ACTIVE", "EXPIRED", "DISABLED", "SUSPENDED", "REVOKED")
        )
        + """, count(*) FILTER (effective_status = 'ACTIVE' AND date_diff('day', DATE '2000-01-01', CAST(expires_on AS DATE)) <= 7)
        AS expiring_soon, (SELECT count(*) FROM customers) AS customers,
        (SELECT count(*) FROM bindings WHERE status = 'ACTIVE') AS active_devices FROM licences"""
    ),
    "b9_expiring": licence(
        """SELECT id, CAST(expires_on AS DATE) AS expires_on FROM licences WHERE status = 'ACTIVE'
        AND abs(date_diff('day', DATE '2000-01-01', CAST(expires_on AS DATE))) <= 7 ORDER BY expires_on, id LIMIT 10"""
    ),
    "b10_audit_search": licence(
        """SELECT a.id, customer_id, c.name AS customer, action, result FROM audit a LEFT JOIN customers c ON c.id = customer_id
        WHERE action = 'LICENCE_EXTENDED'"""
    ),
    "b11_paging": licence(
        """SELECT id, action, total, page, 30 AS page_size FROM (SELECT *, count(*) OVER () AS total,
        CAST(greatest(1, ceil(count(*) OVER () / 30.0)) AS INT) AS page,
        row_number() OVER (ORDER BY moment DESC, id DESC) AS n FROM audit) WHERE n > (page - 1) * 30"""
    ),
    "b12_customer_validation": """SELECT c_custkey, name, email, company, phone, CASE WHEN name = '' THEN 'Customer name is required.'
        WHEN email NOT LIKE '%@%' THEN 'A valid email is required.'
        WHEN phone = 'call me' THEN 'Phone may contain digits, spaces and + ( ) - . only.' END AS refused FROM (
        SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE trim(c_name) || ' Ltd' END AS name,
          lower(CASE WHEN c_custkey % 7 = 0 THEN c_name ELSE c_name || '@example.org' END) AS email,
          nullif(c_mktsegment, '') AS company,
          CASE WHEN c_custkey % 5 = 0 THEN 'call me' ELSE '+91 (22) ' || CAST(c_custkey AS STRING) END AS phone FROM customer)""",
    "b13_code_hash": f"""SELECT o_orderkey, regexp_matches({_CODE}, '^LIC-[A-Z0-9]{{4}}-[A-Z0-9]{{4}}-[A-Z0-9]{{4}}$') AS valid_code,
        sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode({_CODE})))) AS code_hash,
        right({_CODE}, 4) AS code_hint FROM (SELECT o_orderkey, concat_ws('-', CASE WHEN o_orderkey % 9 = 0 THEN 'XIC' ELSE ' lic' END,
          substr(d, 1, 4), lower(substr(d, 5, 4)), substr(d, 9, 4) || '  ') AS code
        FROM (SELECT o_orderkey, upper(left(md5(CAST(o_orderkey AS STRING)), 12)) AS d FROM orders))""",
    "b14_licence_creation": licence(
        f"""SELECT k AS o_orderkey, plan, refused, CASE WHEN refused IS NULL THEN coalesce(ends, {NOW_MS} + days * 86400000) END
        AS expires_at_ms FROM (SELECT *, CASE WHEN c.id IS NULL THEN 'Unknown customer.'
          WHEN coalesce(devices, 1) NOT BETWEEN 1 AND 20 THEN 'Max devices must be 1–20.'
          WHEN ends <= {NOW_MS} THEN 'Expiry date must be after the start date and in the future.'
          WHEN ends IS NULL AND days NOT BETWEEN 1 AND 3650 THEN 'Duration must be 1–3650 days (or give an expiry date).' END AS refused
        FROM (SELECT o_orderkey AS k, CASE WHEN k % 13 = 0 THEN o_custkey + 1000000000 ELSE o_custkey END AS owner,
            CASE WHEN k % 4 = 0 THEN 'Standard' ELSE 'Pro Plus' END AS plan, k % 5000 AS days,
            CASE WHEN k % 6 = 0 THEN NULL ELSE k % 25 END AS devices,
            CASE WHEN k % 3 = 0 THEN {NOW_MS} + (k % 7 - 3) * 86400000 END AS ends FROM orders) r
        LEFT JOIN customers c ON c.id = r.owner)"""
    ),
    "b17_unknown_codes": """SELECT o_orderkey AS request_id, CASE WHEN unknown THEN 404 END AS http_status,
        CASE WHEN unknown THEN 'ACTIVATION_REFUSED' END AS audit_action, CASE WHEN unknown THEN 'FAILURE' END AS audit_result,
        CASE WHEN unknown THEN 'unknown code' END AS detail FROM (SELECT *, o_orderkey % 7 = 0 OR o_custkey NOT IN (
        SELECT c_custkey FROM customer) AS unknown FROM orders)""",
    "b18_validation": licence(
        f"""SELECT request_id, CASE WHEN licence_id % 7 = 0 THEN 400 WHEN NOT bound THEN 401
          WHEN effective_status = 'ACTIVE' THEN 200 ELSE 403 END AS http_status,
        CASE WHEN licence_id % 7 = 0 THEN NULL WHEN NOT bound THEN 'UNREGISTERED' ELSE effective_status END AS client_status,
        {message("client_status")} AS message
        FROM (SELECT b.id AS request_id, licence_id, effective_status,
          b.status = 'ACTIVE' AND licence_id % 5 <> 0 AND l.id IS NOT NULL AS bound
        FROM bindings b LEFT JOIN licences l ON l.id = b.licence_id)"""
    ),
    "b20_change_feed": licence(
        f"""SELECT l.id AS change_id, licence_id, b.id AS binding_id,
        CASE WHEN b.status = 'ACTIVE' THEN effective_status ELSE 'UNREGISTERED' END AS client_status,
        {message("client_status")} AS message FROM licences l JOIN bindings b ON b.licence_id = l.id"""
    ),
    "b23_push_messages": """SELECT k AS c_custkey, kind, CASE WHEN kind = 'LICENCE_STATUS' THEN 'ACTIVE' END AS status,
        CASE WHEN kind = 'AUTH_FAILED' THEN CASE WHEN k % 4 = 0 THEN 'unknown' ELSE 'late' END END AS reason
        FROM (SELECT c_custkey AS k, CASE WHEN k % 11 = 0 THEN NULL
          WHEN k % 5 = 0 AND k % 3 = 0 AND k % 2 = 0 THEN 'LICENCE_STATUS'
          WHEN k % 5 = 1 THEN 'AUTH_OK' WHEN k % 5 = 2 THEN 'AUTH_FAILED' WHEN k % 5 = 3 THEN 'PONG' END AS kind FROM customer)""",
    "a8_action_validation": """SELECT c_custkey AS owner, c_custkey % 9 <> 0 AND c_custkey % 4 <> 0
        AND c_custkey % 1000 + 400 >= 500 AND c_custkey % 8 <= 5 AS valid FROM customer""",
    "s4_stored_profile": """SELECT c_custkey AS owner, NOT (valid AND c_mktsegment IN ('BUILDING', 'MACHINERY')) AS from_defaults,
        NOT (valid AND c_mktsegment IN ('BUILDING', 'MACHINERY')) AS is_default
        FROM (SELECT *, c_custkey % 9 <> 0 AND c_custkey % 4 <> 0 AND c_custkey % 1000 + 400 >= 500 AND c_custkey % 8 <= 5
        AS valid FROM customer)""",
    "s5_record_store": licence(
        """SELECT customer_id AS id, created_at AS changed_at, id AS change_no, status FROM licences
        QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY created_at DESC, id DESC) = 1"""
    ),
    "s1_page_gate": select(
        LEADS_RAW,
        r"""SELECT CAST(page_id AS STRING) AS page_id, regexp_matches(url, '^https://leads\.example\.com/') AS supported_url,
        regexp_matches(url, '^https://leads\.example\.com/') AND contains(html, 'BuyLdC_') AS active FROM pages
        UNION ALL SELECT row_id, TRUE, TRUE FROM leads_raw""",
    ),
    "x1_extract_cards": select(
        LEADS_RAW,
        card("0", f"CASE WHEN {_RELATIVE} THEN country ELSE raw_lead_age END", "1.0", "1.0")
        + " UNION ALL "
        + card("1", "country", "0.8", "CASE WHEN buys_raw IS NULL THEN 1.0 ELSE 0.9 END"),
    ),
    "x1_nested_cards": select(
        LEADS_RAW,
        f"""SELECT page_id, 0 AS card_no, CASE WHEN cut THEN 'card is cut off' END AS failure,
        CASE WHEN NOT cut THEN {shown("raw_title")} END AS raw_title, CASE WHEN NOT cut THEN {shown("country")} END AS country,
        CASE WHEN NOT cut AND {_RELATIVE} THEN raw_lead_age END AS raw_lead_age, CASE WHEN NOT cut THEN quantity_raw END AS quantity_raw,
        CASE WHEN NOT cut THEN buys_raw END AS buys_raw
        FROM (SELECT row_id AS page_id, raw_title, country, raw_lead_age, quantity_raw, buys_raw, number % 11 = 0 AS cut
          FROM (SELECT *, split_part(row_id, '-', 1)::BIGINT AS number FROM leads_raw)
          UNION SELECT row_id, raw_title, 'Canada', raw_lead_age, quantity_raw, buys_raw, number % 11 = 0
          FROM (SELECT *, split_part(row_id, '-', 1)::BIGINT AS number FROM leads_raw) WHERE number % 5 = 0)
        WHERE 0.25 * (raw_title IS NOT NULL)::INT + 0.2 * (country IS NOT NULL)::INT + 0.15 * (quantity_raw IS NOT NULL)::INT
          + 0.15 * (buys_raw IS NOT NULL)::INT >= 0.5""",
    ),
    "s2_page_scan": select(
        LEADS_RAW,
        "SELECT page_id, card_no, raw_title FROM ("
        + card("0", f"CASE WHEN {_RELATIVE} THEN country ELSE raw_lead_age END", "1.0", "1.0")
        + " UNION ALL "
        + card("1", "country", "0.8", "1.0")
        + ")",
    ),
    "x2_card_confidence": select(
        LEADS_RAW,
        f"""SELECT row_id, round({_SIGNALS.format(category="category IS NOT NULL", contact="mobile_available")}, 3)::DOUBLE
        AS card_confidence FROM leads_raw WHERE card_confidence >= 0.5""",
    ),
    "x3_first_hit": select(
        LEADS_RAW,
        """SELECT row_id, coalesce(product_category, category, buys_raw) AS text, CASE WHEN product_category IS NOT NULL THEN 1.0
        WHEN category IS NOT NULL THEN 0.9 WHEN buys_raw IS NOT NULL THEN 0.6 END::DOUBLE AS confidence FROM leads_raw""",
    ),
    "x4_strip_noise": select(
        LEADS_RAW, f"SELECT row_id, coalesce({shown('country')}, '') AS country_text FROM leads_raw"
    ),
    "x5_labeled_fields": select(
        LEADS_RAW,
        """SELECT row_id, CASE WHEN coalesce(quantity_raw, dosage_form) IS NULL THEN 'failed' ELSE 'found' END AS quantity_state,
        coalesce(quantity_raw, dosage_form) AS quantity_value,
        CASE WHEN strength_raw IS NULL THEN 'failed' ELSE 'found' END AS strength_state, strength_raw AS strength_value,
        CASE WHEN buys_raw IS NULL THEN 'failed' ELSE 'found' END AS buys_state, buys_raw AS buys_value,
        'missing' AS "dosageForm_state", NULL AS "dosageForm_value" FROM leads_raw""",
    ),
    "x6_breadcrumbs": select(
        LEADS_RAW,
        """SELECT row_id, array_to_string(c, '>') AS crumbs, CASE WHEN len(c) >= 2 THEN c[-2] ELSE c[1] END AS category,
        CASE WHEN len(c) >= 2 THEN c[-1] END AS product_category FROM (SELECT row_id,
          list_filter([category, dosage_form, product_category], lambda x: x IS NOT NULL) AS c FROM leads_raw)""",
    ),
    "x7_split_list": select(
        NORMALIZE, "SELECT row_id, array_to_string(buyer_products, '|') AS items FROM normalized"
    ),
    "x8_contact": select(
        LEADS_RAW,
        """SELECT row_id, mobile_available AS mobile, NOT mobile_available AND whatsapp_available AS whatsapp,
        NOT mobile_available AND email_available AS email, CASE WHEN mobile_available THEN 'marker'
        WHEN whatsapp_available OR email_available THEN 'text' ELSE 'none' END AS source FROM leads_raw""",
    ),
    "x9_engagement": select(
        LEADS_RAW,
        r"""SELECT row_id, CASE WHEN mobile_available THEN TRY_CAST(replace(regexp_extract(coalesce(quantity_raw, ''),
          '^(\d[\d,]*)', 1), ',', '') AS BIGINT) END AS requirements, CASE WHEN mobile_available THEN 3 END AS calls,
        CASE WHEN mobile_available THEN 1126 END AS replies, mobile_available AS verified,
        CASE WHEN mobile_available THEN 'found' ELSE 'missing' END AS state FROM leads_raw""",
    ),
    "x15_button_check": select(
        LEADS_RAW,
        f"""SELECT row_id, ok, code, reason FROM (SELECT *, length(raw_title) AS z, lower({shown("raw_title")}) AS want,
          CASE WHEN z % 7 = 0 THEN 'expected one lead in the card, found 2'
            WHEN want IS NOT NULL AND z % 5 = 0 AND lower({shown("country")}) IS DISTINCT FROM want THEN 'the card now shows a different lead'
            WHEN coalesce(z % 3, 2) = 2 THEN 'no Contact Buyer button in the card'
            WHEN NOT mobile_available THEN 'button is disabled' END AS reason,
          reason IS NULL AS ok, CASE WHEN reason IS NULL THEN CASE WHEN z % 3 = 1 THEN 'FOUND_REFERENCE' ELSE 'FOUND_TEXT' END
            WHEN reason LIKE 'expected%' OR reason LIKE 'the card%' THEN 'IDENTITY_MISMATCH' ELSE 'ACTION_NOT_FOUND' END AS code
        FROM leads_raw)""",
    ),
    "a1_one_action_per_event": select(
        _MATCHES, "SELECT match_event_id, arg_min(row_id, (moment, row_id)) AS row_id FROM matches GROUP BY match_event_id"
    ),
    "a2_state_at_event": select(_MATCHES, "SELECT row_id, state FROM states"),
    "a4_action_status": select(_ATTEMPTS, "SELECT action_id, status, error_code, attempts, illegal FROM actions"),
    "a5_cancelled": select(
        _MATCHES,
        """SELECT row_id, CASE WHEN state = 'ON' THEN 'QUEUED' ELSE 'CANCELLED' END AS final_status, CASE state
        WHEN 'LOCKED' THEN 'LICENCE_INACTIVE' WHEN 'OFF' THEN 'AUTOMATION_DISABLED' END AS error_code FROM states""",
    ),
    "a6_spacing": """SELECT action_id, gap_ms FROM (SELECT event_id AS action_id, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER
        (PARTITION BY user_id ORDER BY ts, event_id) AS gap_ms FROM events) WHERE gap_ms < 21600000""",
    "a7_snapshot": select(
        _ATTEMPTS,
        """SELECT count(*) FILTER (status = 'SUCCESS') AS clicked, count(*) AS events,
        count(*) FILTER (status = 'RETRYING') AS queue_length, (SELECT error_code FROM actions WHERE status = 'FAILED'
          ORDER BY completed_at DESC, action_id DESC LIMIT 1) AS last_error FROM actions""",
    ),
    "a7_history": select(
        _ATTEMPTS,
        "SELECT action_id, status, started_at FROM actions ORDER BY started_at DESC, action_id DESC LIMIT 20",
    ),
}

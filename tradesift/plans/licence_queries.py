"""Queries over licences, devices, audit, actions, pages and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradesift.functions import parsing as P
from tradesift.functions import text as X
from tradesift.operators import actions, cards, licences, normalize, replay, request_limits
from tradesift.plans import lead_queries, profiles
from tradesift.sources import pages, tables

NOW = "2000-01-01"
NOW_MS = 946_684_800_000


def now():
    return F.lit(NOW).cast("date")


def _tables(spark, folder):
    return (
        tables.licences(spark, folder),
        tables.customers(spark, folder),
        tables.device_bindings(spark, folder),
    )


def _rows(spark, folder) -> DataFrame:
    return licences.licence_rows(*_tables(spark, folder), now())


def b1_effective_status(spark, folder):
    rows = tables.licences(spark, folder)
    return rows.select("id", licences.effective_status(now()).alias("effective_status"))


def b2_status_message(spark, folder):
    status = licences.effective_status(now())
    return tables.licences(spark, folder).select("id", licences.status_message(status).alias("message"))


def b3_licence_rows(spark, folder):
    return _rows(spark, folder).select(
        "id", "customer_id", "plan", "status", "effective_status", "customer", "email", "company",
        "active_devices",
    )


def b4_licence_search(spark, folder):
    found = licences.search_licences(_rows(spark, folder), "EXPIRED", "  BUILD ")
    return found.select("id", "customer", "effective_status")


def b5_customer_search(spark, folder):
    lics, people, devices = _tables(spark, folder)
    found = licences.search_customers(people, lics, devices, now(), "12")
    return found.drop("last_seen_at")


def _hashed_bindings(spark, folder) -> DataFrame:
    rows = tables.device_bindings(spark, folder)
    return rows.withColumn("device_id_hash", F.sha2(F.col("licence_id").cast("string"), 256))


def b6_device_search(spark, folder):
    lics, people, _ = _tables(spark, folder)
    found = licences.search_devices(_hashed_bindings(spark, folder), lics, people, "ACTIVE", "00")
    return found.select("id", "licence_id", "status", "device", "customer")


def b7_licence_details(spark, folder):
    lics, _, devices = _tables(spark, folder)
    rows = licences.licence_details(lics, devices, now())
    return rows.select("id", "effective_status", "last_validation_at", "devices", "active_devices")


def b7_recent_audit(spark, folder):
    return licences.recent_audit(tables.audit_log(spark, folder), "customer_id").select(
        "customer_id", "id", "action"
    )


def b8_statistics(spark, folder):
    return licences.statistics(*_tables(spark, folder), now())


def b9_expiring(spark, folder):
    return licences.expiring(tables.licences(spark, folder), now()).select("id", "expires_on")


def b10_audit_search(spark, folder):
    found = licences.search_audit(
        tables.audit_log(spark, folder), tables.customers(spark, folder), action="LICENCE_EXTENDED"
    )
    return found.select("id", "customer_id", "customer", "action", "result")


def b11_paging(spark, folder):
    rows = tables.audit_log(spark, folder).select("id", "at", "action")
    page = licences.paginate(rows, ["at", "id"], page=10**9, page_size=30)
    return page.select("id", "action", "total", "page", "page_size")


def b12_customer_validation(spark, folder):
    k = F.col("c_custkey")
    requests = tables.read_table(spark, folder, "customer").select(
        "c_custkey",
        F.when(k % 11 == 0, "   ").otherwise(F.concat(F.lit("  "), "c_name", F.lit("  Ltd"))).alias("name"),
        F.when(k % 7 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("@Example.org"))).alias("email"),
        F.col("c_mktsegment").alias("company"),
        F.when(k % 5 == 0, "call me").otherwise(F.concat(F.lit("+91 (22) "), k.cast("string"))).alias("phone"),
    )
    return licences.validate_customers(requests)


PEPPER = "pepper for tests"


def b13_code_hash(spark, folder):
    digits = F.upper(F.left(F.md5(F.col("o_orderkey").cast("string")), F.lit(12)))
    part = lambda start: F.substring(digits, start, 4)
    prefix = F.when(F.col("o_orderkey") % 9 == 0, "XIC").otherwise(" lic")
    code = F.concat_ws("-", prefix, part(1), F.lower(part(5)), F.concat(part(9), F.lit("  ")))
    codes = tables.read_table(spark, folder, "orders").select("o_orderkey", code.alias("code"))
    return licences.with_code_hash(codes, PEPPER)


def b14_licence_creation(spark, folder):
    k = F.col("o_orderkey")
    requests = tables.read_table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(k % 13 == 0, F.col("o_custkey") + 1_000_000_000).otherwise(F.col("o_custkey")).alias("customer_id"),
        F.when(k % 4 == 0, "  ").otherwise("Pro  Plus").alias("plan"),
        (k % 5000).cast("int").alias("days"),
        F.when(k % 6 == 0, None).otherwise((k % 25).cast("int")).alias("max_devices"),
        F.when(k % 3 == 0, F.lit(NOW_MS) + (k % 7 - 3) * 86_400_000).alias("expires_ms"),
        F.lit(None).cast("bigint").alias("starts_ms"),
    )
    checked = licences.validate_licence_requests(requests, tables.customers(spark, folder), NOW_MS)
    return checked.select("o_orderkey", "plan", "refused", "expires_at_ms")


def _millis(name: str):
    return F.unix_millis(F.col(name).cast("timestamp"))


def licence_commands(spark, folder) -> DataFrame:
    """Commands on licences, derived from order lines."""
    names = F.array(
        *[
            F.lit(name)
            for name in (
                "activate", "extend", "activate", "suspend", "reactivate", "reset-device", "release",
                "disable",
            )
        ]
    )
    lines = tables.read_table(spark, folder, "lineitem")
    starts = tables.licences(spark, folder).select(
        F.col("id").alias("licence_id"),
        "status",
        _millis("expires_on").alias("start_expires_ms"),
        "max_devices",
    )
    part = F.col("l_partkey")
    commands = lines.select(
        F.col("l_orderkey").alias("licence_id"),
        (F.col("l_linenumber") + part * 10).alias("seq"),
        _millis("l_shipdate").alias("at_ms"),
        F.when(part % 17 == 0, "revoke").otherwise(F.get(names, F.col("l_linenumber") % 8)).alias("command"),
        F.concat(F.lit("device-"), (part % 3).cast("string")).alias("device"),
        F.when(part % 5 == 0, 7).otherwise(30).alias("days"),
        F.lit(None).cast("bigint").alias("until_ms"),
        F.lit("1.0").alias("version"),
    )
    return commands.join(starts, "licence_id")


def b15_command_replay(spark, folder):
    events = replay.replay_licences(licence_commands(spark, folder))
    admin = list(replay.COMMAND_AUDIT)
    return events.filter(F.col("command").isin(admin))


def b16_extension(spark, folder):
    return replay.replay_licences(licence_commands(spark, folder)).filter("command = 'extend'")


def b17_activation(spark, folder):
    return replay.replay_licences(licence_commands(spark, folder)).filter("command = 'activate'")


def b19_device_reset(spark, folder):
    return replay.replay_licences(licence_commands(spark, folder)).filter("command = 'release'")


def b17_unknown_codes(spark, folder):
    orders = tables.read_table(spark, folder, "orders")
    code = F.when(F.col("o_orderkey") % 7 == 0, F.concat("o_custkey", F.lit("?"))).otherwise(F.col("o_custkey").cast("string"))
    requests = orders.select(F.col("o_orderkey").alias("request_id"), F.md5(code).alias("code_hash"))
    known = tables.customers(spark, folder).select(F.md5(F.col("id").cast("string")).alias("code_hash"))
    refused = replay.refuse_unknown_codes(requests, known)
    return requests.select("request_id").join(refused, "request_id", "left")


def b18_validation(spark, folder):
    rows = tables.device_bindings(spark, folder)
    owner = F.concat(F.lit("device-"), F.col("licence_id").cast("string"))
    token = F.concat(F.lit("token-of-binding-"), "id")
    bindings = rows.select(
        "id", "licence_id", "status",
        F.sha2(token, 256).alias("token_hash"), F.sha2(owner, 256).alias("device_id_hash"),
    )
    other = F.col("licence_id") % 5 == 0
    device = F.when(other, "device-of-somebody").otherwise(owner)
    requests = rows.select(
        F.col("id").alias("request_id"),
        F.when(F.col("licence_id") % 7 == 0, "short").otherwise(token).alias("token"),
        device.alias("device_id"),
        F.sha2(device, 256).alias("device_hash"),
    )
    return licences.validate_tokens(requests, bindings, tables.licences(spark, folder), now())


def b20_change_feed(spark, folder):
    changes = tables.licences(spark, folder).select(F.col("id").alias("change_id"), F.col("id").alias("licence_id"))
    return licences.change_answers(
        changes, tables.device_bindings(spark, folder), tables.licences(spark, folder), now()
    )


def b21_request_limit(spark, folder):
    requests = tables.read_table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("key"), _millis("ts").alias("at_ms")
    )
    return request_limits.limit_requests(requests, limit=2, length_ms=6 * 3_600_000)


def b23_push_messages(spark, folder):
    k = F.col("c_custkey")
    text = F.format_string(
        '{"type":"%s","reason":%s,"licence":{"status":"%s","expiresAt":%s,"serverTime":%s,"plan":"Pro",'
        '"customer":null,"codeHint":null,"message":"m"}}%s',
        F.get(F.array(*map(F.lit, ("LICENCE_STATUS", "AUTH_OK", "AUTH_FAILED", "PONG", "OTHER"))), (k % 5).cast("int")),
        F.when(k % 4 == 0, "7").otherwise('"late"'),
        F.when(k % 3 == 0, "ACTIVE").otherwise("PENDING"),
        F.when(k % 2 == 0, "null").otherwise('"soon"'),
        k.cast("string"),
        F.when(k % 11 == 0, "}").otherwise(""),
    )
    messages = tables.read_table(spark, folder, "customer").select("c_custkey", text.alias("message"))
    return licences.read_push_messages(messages).drop("message")


# --- stores ---


def action_profiles(spark, folder) -> DataFrame:
    k = F.col("c_custkey")
    text = F.format_string(
        '{"version":%s,"autoClickEnabled":true,"delayBetweenActionsMs":%s,"maxRetries":%s}',
        F.when(k % 9 == 0, "1").otherwise("2"),
        F.when(k % 4 == 0, "750.5").otherwise((k % 1000 + 400).cast("string")),
        (k % 8).cast("string"),
    )
    return tables.read_table(spark, folder, "customer").select(k.alias("owner"), text.alias("profile"))


def a8_action_validation(spark, folder):
    return profiles.with_validity(action_profiles(spark, folder), "action").select("owner", "valid")


def s4_stored_profile(spark, folder):
    people = tables.read_table(spark, folder, "customer").select(F.col("c_custkey").alias("owner"))
    segments = tables.read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("owner"), "c_mktsegment"
    )
    stored = action_profiles(spark, folder).join(segments, "owner")
    current = stored.filter("c_mktsegment = 'BUILDING'").drop("c_mktsegment")
    legacy = stored.filter("c_mktsegment IN ('BUILDING', 'MACHINERY')").drop("c_mktsegment")
    loaded = profiles.stored_profile(people, current, legacy, "action", "default")
    return loaded.select("owner", "from_defaults", (F.col("profile") == "default").alias("is_default"))


def s5_record_store(spark, folder):
    changes = tables.licences(spark, folder).select(
        F.col("customer_id").alias("id"), F.col("created_at").alias("changed_at"),
        F.col("id").alias("change_no"), "status",
    )
    return licences.latest_records(changes)


# --- pages and cards ---


def all_pages(spark, folder, by_id: bool = False) -> DataFrame:
    """The stored pages and the lead pages; ``by_id``: snapshots of one page in one partition, without moving lead pages again."""
    stored = tables.read_table(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "html"
    )
    if by_id:
        stored = stored.repartition(4 * spark.sparkContext.defaultParallelism, "page_id")
    return stored.unionByName(pages.lead_pages(tables.leads_raw(spark, folder)))


def s1_page_gate(spark, folder):
    gated = pages.gated_pages(all_pages(spark, folder))
    return gated.select("page_id", "supported_url", "active")


def x1_extract_cards(spark, folder):
    leads = tables.leads_raw(spark, folder)
    read = cards.read_cards(cards.with_card_confidence(pages.extract_cards(pages.lead_pages(leads))))
    return read.select(
        "page_id", "card_no", "raw_title", "country", "raw_lead_age", "category",
        "product_category", "quantity_raw", "strength_raw", "dosage_form", "buys_raw",
        "mobile_available", "whatsapp_available", "email_available", "sure_leadAge", "sure_buys",
    )


def x1_nested_cards(spark, folder):
    """Cards of pages with deep nesting, several snapshots and copies; a card that breaks off is a failure row."""
    found = pages.extract_cards(pages.nested_pages(tables.leads_raw(spark, folder)))
    read = cards.read_cards(cards.with_card_confidence(found, keep_failures=True))
    texts = ["raw_title", "country", "raw_lead_age", "quantity_raw", "buys_raw"]
    whole = F.col("failure").isNull()
    return read.select("page_id", "card_no", "failure", *[F.when(whole, F.col(name)).alias(name) for name in texts])


def s2_page_scan(spark, folder):
    found = cards.with_card_confidence(pages.scan_pages(all_pages(spark, folder)))
    return cards.read_cards(found).select("page_id", "card_no", "raw_title")


def _signals():
    present = {
        "title": F.col("raw_title"), "country": F.col("country"), "quantity": F.col("quantity_raw"),
        "buyer": F.col("buys_raw"), "category": F.col("category"),
    }
    named = [F.when(value.isNotNull(), F.lit(name)) for name, value in present.items()]
    return F.array_compact(F.array(*named, F.when(F.col("mobile_available"), F.lit("contact"))))


def x2_card_confidence(spark, folder):
    leads = tables.leads_raw(spark, folder).withColumn("signals", _signals())
    return cards.with_card_confidence(leads).select("row_id", "card_confidence")


def _hit(strategy: int, text: str, confidence: float):
    return F.when(
        F.col(text).isNotNull(),
        F.struct(
            F.lit(strategy).alias("strategy"), F.lit(0).alias("position"),
            F.col(text).alias("text"), F.lit(confidence).alias("confidence"),
        ),
    )


def x3_first_hit(spark, folder):
    hits = F.array_compact(
        F.array(_hit(2, "buys_raw", 0.6), _hit(0, "product_category", 1.0), _hit(1, "category", 0.9))
    )
    leads = tables.leads_raw(spark, folder).withColumn("hit", cards.first_hit(hits))
    return leads.select("row_id", F.col("hit.text").alias("text"), F.col("hit.confidence").alias("confidence"))


def x4_strip_noise(spark, folder):
    leads = tables.leads_raw(spark, folder)
    noisy = F.concat(F.col("country"), F.lit(" Click here to view BuyLeads from "), F.col("country"))
    return leads.select("row_id", cards.strip_noise(noisy).alias("country_text"))


def _label_rows():
    def row(label: str, value: str, inline: bool):
        text = F.concat(F.lit(f"{label}: "), F.coalesce(F.col(value), F.lit("")))
        pair = F.struct(F.lit(label.lower()).alias("label"), F.col(value).alias("value"))
        pairs = F.filter(F.array(pair), lambda p: F.lit(not inline))
        return F.struct(pairs.alias("pairs"), F.trim(text).alias("text"))

    return F.array(
        row("Qty", "quantity_raw", False), row("Strength", "strength_raw", False),
        row("Buys", "buys_raw", True), row("Quantity", "dosage_form", False),
    )


def x5_labeled_fields(spark, folder):
    leads = tables.leads_raw(spark, folder).withColumn("rows", _label_rows())
    leads = cards.add_labels(leads)
    fields = ["quantity", "strength", "buys", "dosageForm"]
    leads = leads.withColumns({f"_{name}": cards.labeled_value(name) for name in fields})
    columns = []
    for name in fields:
        columns += [F.col(f"_{name}.state").alias(f"{name}_state"), F.col(f"_{name}.value").alias(f"{name}_value")]
    return leads.select("row_id", *columns)


def x6_breadcrumbs(spark, folder):
    leads = tables.leads_raw(spark, folder)
    crumbs = F.array("category", "category", "dosage_form", "product_category", "product_category")
    leads = leads.withColumn("trail", cards.breadcrumb_trail(crumbs))
    return leads.select(
        "row_id", F.array_join("trail.crumbs", ">").alias("crumbs"),
        F.col("trail.category").alias("category"), F.col("trail.product_category").alias("product_category"),
    )


def x7_split_list(spark, folder):
    leads = tables.leads_raw(spark, folder)
    return leads.select("row_id", F.array_join(X.split_list(F.col("buys_raw")), "|").alias("items"))


def x8_contact(spark, folder):
    leads = tables.leads_raw(spark, folder)
    marker = lambda flag, text: F.when(F.col(flag), F.lit(text))
    markers = F.array_compact(F.array(marker("mobile_available", "Mobile  Number Available")))
    leaves = F.array_compact(
        F.array(
            marker("whatsapp_available", "Whats App available"),
            marker("email_available", "Email Available"),
            F.col("raw_title"),
        )
    )
    leads = leads.withColumn("contact", cards.contact_availability(markers, leaves))
    return leads.select("row_id", "contact.mobile", "contact.whatsapp", "contact.email", "contact.source")


def x9_engagement(spark, folder):
    leads = tables.leads_raw(spark, folder)
    text = F.when(
        F.col("mobile_available"),
        F.concat_ws(" ", F.lit("Requirements:"), F.col("quantity_raw"), F.lit("Call 3 Replies: 1,126")),
    )
    leads = leads.withColumn("e", cards.engagement_counts(text))
    return leads.select("row_id", "e.requirements", "e.calls", "e.replies", "e.verified", "e.state")


def x10_raw_measure(spark, folder):
    leads = tables.leads_raw(spark, folder)
    leads = leads.withColumn("cleaned", X.collapse_spaces(F.col("quantity_raw")))
    return P.add_measure(leads, "cleaned", "m").select(
        "row_id", F.col("m_value").alias("value"), F.col("m_unit").alias("unit")
    )


def x11_raw_lead_age(spark, folder):
    leads = tables.leads_raw(spark, folder)
    return leads.select("row_id", P.parse_lead_age_minutes(F.col("raw_lead_age")).alias("minutes"))


def _extracted(spark, folder) -> DataFrame:
    leads = normalize.with_optional_columns(tables.leads_raw(spark, folder))
    return cards.states_of_raw_leads(leads)


def x12_field_states(spark, folder):
    return _extracted(spark, folder).select(
        "row_id", *[F.col(f"state_{name}").alias(f"{name}_state") for name in ("title", "country", "leadAge", "quantity", "strength")],
        F.array_join("failed_fields", ",").alias("failed_fields"),
        F.array_join("extraction_warnings", "; ").alias("warnings"),
    )


def x13_confidence(spark, folder):
    return _extracted(spark, folder).select("row_id", "confidence")


def x14_completeness(spark, folder):
    return _extracted(spark, folder).select("row_id", "completeness")


def x15_button_check(spark, folder):
    size = F.length("raw_title")
    titles = F.when(size % 7 == 0, F.array("raw_title", "raw_title")).when(
        size % 5 == 0, F.array("country")
    )
    button = lambda strategy, disabled: F.struct(
        F.lit(strategy).alias("strategy"), F.lit("Contact Buyer").alias("text"), disabled.alias("disabled")
    )
    off = ~F.col("mobile_available")
    buttons = F.when(size % 3 == 0, F.array(button(1, off))).when(
        size % 3 == 1, F.array(button(0, off), button(1, off))
    )
    none = F.array().cast("array<struct<strategy:int,text:string,disabled:boolean>>")
    leads = tables.leads_raw(spark, folder).withColumns(
        {
            "titles": titles.otherwise(F.array("raw_title")),
            "buttons": buttons.otherwise(none),
        }
    )
    leads = leads.withColumn("check", cards.button_check())
    return leads.select("row_id", "check.ok", "check.code", "check.reason")


# --- actions ---


def _match_events(spark, folder) -> DataFrame:
    events = tables.read_table(spark, folder, "events").filter("event_type NOT IN ('signup', 'error')")
    return events.select(
        F.concat(F.lit("m-"), F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string")).alias("match_event_id"),
        F.col("event_id").alias("row_id"), "user_id", F.col("ts").alias("at"),
    )


def _switches(spark, folder) -> DataFrame:
    events = tables.read_table(spark, folder, "events").filter("event_type IN ('signup', 'error')")
    kind = F.when(F.col("event_type") == "signup", "ON").when(F.col("event_id") % 2 == 0, "LOCKED")
    return (
        events.select("user_id", F.col("ts").alias("changed_at"), kind.otherwise("OFF").alias("state"))
        .groupBy("user_id", "changed_at")
        .agg(F.max("state").alias("state"))
    )


def a1_one_action_per_event(spark, folder):
    return actions.one_action_per_event(_match_events(spark, folder)).select("match_event_id", "row_id")


def a2_state_at_event(spark, folder):
    events = actions.with_state_at(_match_events(spark, folder), _switches(spark, folder), ["user_id"])
    return events.select("row_id", "state")


def a3_eligibility(spark, folder):
    narrow = lead_queries.judged(spark, folder).select("lead_id", "row_id", "detected_at", "status")
    current = lead_queries.verdicts.current_verdicts(narrow)
    events = narrow.select("lead_id", "row_id")
    checked = actions.check_events(events, current, F.lit(True))
    return checked.select("row_id", "eligible", "code")


def _attempts(spark, folder) -> DataFrame:
    part = F.max("l_partkey")
    codes = F.array(F.lit(None), *map(F.lit, ("STALE_LEAD", "STALE_LEAD", "ACTION_NOT_FOUND", "CLICK_FAILED")))
    lines = tables.read_table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber")
    rows = lines.agg(part.alias("part"), F.min("l_shipdate").alias("at"))
    return rows.select(
        F.col("l_orderkey").alias("action_id"), F.col("l_linenumber").alias("attempt"),
        F.get(codes, (F.col("part") % 5).cast("int")).alias("code"), "at",
    )


def a4_action_status(spark, folder):
    rows = actions.action_status(_attempts(spark, folder), max_retries=2)
    return rows.select("action_id", "status", "error_code", "attempts", "illegal")


def a5_cancelled(spark, folder):
    queued = _match_events(spark, folder).withColumnRenamed("at", "start_at")
    rows = actions.cancelled_actions(queued, _switches(spark, folder), ["user_id"])
    return rows.select("row_id", "final_status", "error_code")


def a6_spacing(spark, folder):
    events = tables.read_table(spark, folder, "events").select(
        "user_id", F.col("event_id").alias("action_id"),
        F.col("ts").alias("started_at"), F.col("ts").alias("completed_at"),
    )
    rows = actions.spacing_violations(events, ["user_id"], 6 * 3_600_000)
    return rows.select("action_id", "gap_ms")


def a7_snapshot(spark, folder):
    return actions.snapshot(actions.action_status(_attempts(spark, folder), max_retries=2))


def a7_history(spark, folder):
    rows = actions.history(actions.action_status(_attempts(spark, folder), max_retries=2))
    return rows.select("action_id", "status", "started_at")


QUERIES = {
    name: function
    for name, function in list(globals().items())
    if name[:1] in "bsxa" and name[1:2].isdigit()
}

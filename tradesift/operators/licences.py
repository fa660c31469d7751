"""Licence tables: status, searches, details, statistics, audit, requests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradesift.session import checkpointed
from tradesift.functions.hashing import hmac_sha256
from tradesift.functions.text import collapse_spaces
from tradesift.operators.ordered import latest_per_key, newest_of_key
from tradesift.plans.profiles import _is_absent, _is_type, _number, _text, parse_document

# Statuses, messages, limits and patterns of the licence side.
STATUS_MESSAGES = {
    "ACTIVE": "Licence active.",
    "EXPIRED": "Licence expired. Renew it to continue.",
    "DISABLED": "Licence disabled by the administrator.",
    "SUSPENDED": "Licence suspended. Contact support.",
    "REVOKED": "Licence revoked.",
    "UNREGISTERED": "This browser is not activated. Enter your licence code.",
}
EXPIRING_SOON_DAYS = 7
DEFAULT_PAGE = 25
RECENT_AUDIT = 50
EXPIRING_LIST = 10
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PHONE_PATTERN = r"^[0-9+()\-.\s]{6,30}$"
CODE_PATTERN = r"^LIC-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{4}$"
DEVICE_PATTERN = r"^[A-Za-z0-9-]{8,64}$"
VERSION_PATTERN = r"^[0-9A-Za-z.+-]{1,20}$"
ACTION_NAME_PATTERN = r"^[A-Z_]{3,40}$"
MAX_DEVICES, MAX_DAYS = 20, 3650
SERVER_STATUSES = ["ACTIVE", "EXPIRED", "DISABLED", "SUSPENDED", "REVOKED", "UNREGISTERED"]


def effective_status(now: Column, status: str = "status", expires: str = "expires_on") -> Column:
    """A stored decision wins; an active licence past its expiry is expired."""
    expired = (F.col(status) == "ACTIVE") & (F.col(expires) <= now)
    return F.when(expired, "EXPIRED").otherwise(F.col(status))


def status_message(status: Column) -> Column:
    message = F
    for name, text in STATUS_MESSAGES.items():
        message = message.when(status == name, text)
    return message.otherwise(None)


def active_devices(bindings: DataFrame, key: str) -> DataFrame:
    return bindings.groupBy(key).agg(F.count_if(F.col("status") == "ACTIVE").alias("active_devices"))


def licence_rows(licences: DataFrame, customers: DataFrame, bindings: DataFrame, now: Column):
    """Licence, customer and number of active devices; no code hash."""
    people = customers.select(
        F.col("id").alias("customer_id"), F.col("name").alias("customer"), "email", "company"
    )
    devices = active_devices(bindings, "licence_id").withColumnRenamed("licence_id", "id")
    rows = licences.drop("code_hash").withColumn("effective_status", effective_status(now))
    joined = rows.join(people, "customer_id", "left").join(devices, "id", "left")
    return joined.withColumn("active_devices", F.coalesce("active_devices", F.lit(0)))


def cleaned_query(query: str | None) -> str:
    return " ".join((query or "").split()).lower()


def _contains_any(columns: list[str], query: str) -> Column:
    found = F.lit(not query)
    for name in columns:
        found = found | F.lower(F.coalesce(F.col(name).cast("string"), F.lit(""))).contains(query)
    return found


def search_licences(rows: DataFrame, status: str | None = None, query: str | None = None):
    """Effective status and text filters over the licence rows."""
    if status and status != "ALL":
        rows = rows.filter(F.col("effective_status") == status)
    searched = [c for c in ("id", "code_hint", "plan", "customer", "email", "company") if c in rows.columns]
    return rows.filter(_contains_any(searched, cleaned_query(query)))


def search_customers(
    customers: DataFrame, licences: DataFrame, bindings: DataFrame, now: Column, query: str | None = None
) -> DataFrame:
    """Customers with licence count, newest licence, active devices and last activity."""
    query = cleaned_query(query)
    newest = F.struct("created_at", "id")
    own = licences.withColumn("effective_status", effective_status(now))
    hint = [c for c in ("id", "code_hint") if c in licences.columns]
    matched = F.max(_contains_any(hint, query).cast("int"))
    seen = F.max("last_seen_at") if "last_seen_at" in licences.columns else F.lit(None)
    summary = own.groupBy("customer_id").agg(
        F.count("*").alias("licence_count"),
        F.max_by(F.struct("id", "plan", "effective_status"), newest).alias("_newest"),
        matched.alias("_licence_matches"),
        seen.alias("last_seen_at"),
    )
    owners = licences.select(F.col("id").alias("licence_id"), "customer_id")
    active = bindings.filter(F.col("status") == "ACTIVE").groupBy("licence_id").agg(F.count("*").alias("n"))
    devices = (
        active.join(owners, "licence_id").groupBy("customer_id").agg(F.sum("n").alias("device_count"))
    )
    rows = customers.withColumnRenamed("id", "customer_id")
    rows = rows.join(summary, "customer_id", "left").join(devices, "customer_id", "left")
    by_name = _contains_any(["name", "email", "company"], query)
    by_licence = F.coalesce(F.col("_licence_matches"), F.lit(0)) == 1
    return rows.filter(by_name | by_licence).select(
        "customer_id", "name", "email", "company",
        F.coalesce("licence_count", F.lit(0)).alias("licence_count"),
        F.col("_newest.id").alias("licence_id"),
        F.col("_newest.plan").alias("licence_plan"),
        F.col("_newest.effective_status").alias("licence_status"),
        F.coalesce("device_count", F.lit(0)).alias("device_count"),
        "last_seen_at",
    )


def mask_hash(value: Column) -> Column:
    return F.concat(F.left(value, F.lit(10)), F.lit("…"))


def search_devices(
    bindings: DataFrame, licences: DataFrame, customers: DataFrame,
    status: str | None = None, query: str | None = None,
) -> DataFrame:
    if status in ("ACTIVE", "RELEASED"):
        bindings = bindings.filter(F.col("status") == status)
    owners = licences.select(F.col("id").alias("licence_id"), "customer_id", "plan")
    names = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer"))
    rows = bindings.withColumn("device", mask_hash(F.col("device_id_hash"))).drop("device_id_hash", "token_hash")
    rows = rows.join(owners, "licence_id", "left").join(names, "customer_id", "left")
    return rows.filter(_contains_any(["customer", "licence_id", "device"], cleaned_query(query)))


def recent_audit(audit: DataFrame, key: str, limit: int = RECENT_AUDIT) -> DataFrame:
    """The newest audit rows of every key."""
    return newest_of_key(audit, [key], [F.desc("at"), F.desc("id")], limit)


def licence_details(licences: DataFrame, bindings: DataFrame, now: Column) -> DataFrame:
    """Licence with effective status, last validation and its devices counted by state."""
    seen = bindings.groupBy(F.col("licence_id").alias("id")).agg(
        F.max("last_seen_at").alias("last_validation_at"),
        F.count("*").alias("devices"),
        F.count_if(F.col("status") == "ACTIVE").alias("active_devices"),
    )
    rows = licences.withColumn("effective_status", effective_status(now)).join(seen, "id", "left")
    return rows.withColumns(
        {name: F.coalesce(name, F.lit(0)) for name in ("devices", "active_devices")}
    )


def statistics(licences: DataFrame, customers: DataFrame, bindings: DataFrame, now: Column) -> DataFrame:
    """One row of totals: each table is reduced to one row before they meet."""
    status = F.col("effective_status")
    soon = (status == "ACTIVE") & (F.datediff("expires_on", now) <= EXPIRING_SOON_DAYS)
    totals = licences.withColumn("effective_status", effective_status(now)).agg(
        F.count("*").alias("total"),
        *[
            F.count_if(status == name).alias(name.lower())
            for name in ("ACTIVE", "EXPIRED", "DISABLED", "SUSPENDED", "REVOKED")
        ],
        F.count_if(soon).alias("expiring_soon"),
    )
    people = customers.agg(F.count("*").alias("customers"))
    devices = bindings.agg(F.count_if(F.col("status") == "ACTIVE").alias("active_devices"))
    one = lambda rows: rows.withColumn("_one", F.lit(1))
    return one(totals).join(one(people), "_one").join(one(devices), "_one").drop("_one")


def expiring(rows: DataFrame, now: Column, limit: int = EXPIRING_LIST) -> DataFrame:
    """Stored active licences within seven days of expiry on either side, nearest expiry first."""
    near = F.abs(F.datediff("expires_on", now)) <= EXPIRING_SOON_DAYS
    return rows.filter((F.col("status") == "ACTIVE") & near).orderBy("expires_on", "id").limit(limit)


def search_audit(
    audit: DataFrame, customers: DataFrame, customer_id=None, action: str | None = None, licence_id=None
) -> DataFrame:
    """Filtered audit rows with customer names; an action that is no action name is ignored."""
    if customer_id is not None:
        audit = audit.filter(F.col("customer_id") == customer_id)
    if licence_id is not None:
        audit = audit.filter(F.col("licence_id") == licence_id)
    if action and re.match(ACTION_NAME_PATTERN, action):
        audit = audit.filter(F.col("action") == action)
    names = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer"))
    return audit.join(names, "customer_id", "left")


def paginate(
    rows: DataFrame, order: list[str], page: int = 1, page_size: int = DEFAULT_PAGE, max_page_size: int | None = None
) -> DataFrame:
    """One page in descending order of ``order``, a total order, with total, page and page_size; the page is kept in range.

    Rows are cut into ranges of the order. Only the counts of the ranges are ranked; then the ranges that the
    page lies in are sorted. No task and no driver holds the rows before the page.
    """
    as_int = lambda value, default: value if isinstance(value, int) else default
    size = max(1, as_int(page_size, DEFAULT_PAGE))
    size = min(size, max_page_size) if max_page_size else size
    ranged = rows.repartitionByRange(*[F.desc(name) for name in order]).withColumn("_range", F.spark_partition_id())
    ranged = checkpointed(ranged)
    # each range is numbered on its own; what stands before it is a sum over the small table of counts
    within = Window.partitionBy("_range").orderBy(*[F.desc(name) for name in order])
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), F.sum("_n").over(everything).alias("total")
    )
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / size))
    first = (F.least(pages, F.lit(max(1, as_int(page, 1)))) - 1) * size
    wanted = starts.withColumns({"_first": first}).join(counts, "_range")
    wanted = wanted.filter((F.col("_start") < F.col("_first") + size) & (F.col("_start") + F.col("_n") > F.col("_first")))
    numbered = ranged.join(wanted.drop("_n"), "_range").withColumn("_place", F.col("_start") + F.row_number().over(within) - 1)
    items = numbered.filter((F.col("_place") >= F.col("_first")) & (F.col("_place") < F.col("_first") + size))
    page_number = (F.col("_first") / size).cast("int") + 1
    return items.select(*rows.columns, "total", page_number.alias("page"), F.lit(size).alias("page_size"))


#: Longest accepted texts; longer ones are refused, never cut.
TEXT_LIMITS = {"name": 120, "email": 200, "company": 160, "phone": 30, "plan": 60}


def _cleaned(name: str) -> Column:
    return F.coalesce(collapse_spaces(F.col(name)), F.lit(""))


def _too_long(name: str) -> Column:
    return F.length(name) > TEXT_LIMITS[name]


def validate_customers(requests: DataFrame) -> DataFrame:
    """Cleaned fields and the first reason for refusal, null when valid."""
    rows = requests.withColumns(
        {
            "name": _cleaned("name"),
            "email": F.lower(_cleaned("email")),
            "company": _cleaned("company"),
            "phone": _cleaned("phone"),
        }
    )
    blank = lambda name: F.when(F.col(name) != "", F.col(name))
    refused = (
        F.when(F.col("name") == "", "Customer name is required.")
        .when(_too_long("name"), "Customer name is too long.")
        .when(_too_long("email"), "Email is too long.")
        .when(_too_long("company"), "Company is too long.")
        .when(~F.col("email").rlike(EMAIL_PATTERN), "A valid email is required.")
        .when(
            (F.col("phone") != "") & ~F.col("phone").rlike(PHONE_PATTERN),
            "Phone may contain digits, spaces and + ( ) - . only.",
        )
    )
    return rows.withColumns({"company": blank("company"), "phone": blank("phone"), "refused": refused})


def clean_code(code: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(code)), r"\s+", "")


def with_code_hash(codes: DataFrame, pepper: str, code: str = "code") -> DataFrame:
    """Adds valid_code, code_hash and code_hint; the code itself is not kept."""
    cleaned = codes.withColumn("_code", clean_code(F.col(code)))
    return cleaned.withColumns(
        {
            "valid_code": F.col("_code").rlike(CODE_PATTERN),
            "code_hash": hmac_sha256(F.col("_code"), pepper),
            "code_hint": F.right("_code", F.lit(4)),
        }
    ).drop("_code", code)


def validate_licence_requests(requests: DataFrame, customers: DataFrame, now_ms: int) -> DataFrame:
    """Requests with expiry in ms and the first reason for refusal, null when accepted."""
    known = customers.select(F.col("id").alias("customer_id"), F.lit(True).alias("_known"))
    rows = requests.join(known, "customer_id", "left")
    start = F.coalesce("starts_ms", F.lit(now_ms))
    devices = F.coalesce("max_devices", F.lit(1))
    refused = (
        F.when(F.col("_known").isNull(), "Unknown customer.")
        .when(~devices.between(1, MAX_DEVICES), "Max devices must be 1–20.")
        .when(
            F.col("expires_ms").isNotNull()
            & (F.col("expires_ms") <= F.greatest(F.lit(now_ms), start)),
            "Expiry date must be after the start date and in the future.",
        )
        .when(
            F.col("expires_ms").isNull()
            & ~F.coalesce(F.col("days").between(1, MAX_DAYS), F.lit(False)),
            "Duration must be 1–3650 days (or give an expiry date).",
        )
    )
    expires = F.coalesce(F.col("expires_ms"), start + F.col("days").cast("bigint") * 86_400_000)
    refused = F.coalesce(refused, F.when(_too_long("plan"), "Plan is too long."))
    plan = F.coalesce(F.nullif(_cleaned("plan"), F.lit("")), F.lit("Standard"))
    return rows.withColumn("plan", plan).withColumns(
        {"refused": refused, "expires_at_ms": F.when(refused.isNull(), expires)}
    ).drop("_known")


def validate_tokens(
    requests: DataFrame, bindings: DataFrame, licences: DataFrame, now: Column
) -> DataFrame:
    """HTTP status and client status of validation requests ``(request_id, token, device_id, device_hash)``.

    An unknown, released or foreign binding is UNREGISTERED.
    """
    readable = F.length("token").between(20, 100) & F.col("device_id").rlike(DEVICE_PATTERN)
    rows = requests.withColumns(
        {"readable": F.coalesce(readable, F.lit(False)), "token_hash": F.sha2("token", 256)}
    )
    bound = bindings.filter(F.col("status") == "ACTIVE").select(
        "token_hash", F.col("device_id_hash").alias("_device"), "licence_id"
    )
    states = licences.select(
        F.col("id").alias("licence_id"), effective_status(now).alias("_status")
    )
    # the states join the few bindings first: requests without a binding never meet a null key
    held = bound.join(states, "licence_id")
    rows = rows.join(held, "token_hash", "left")
    mine = F.coalesce(F.col("_device") == F.col("device_hash"), F.lit(False)) & F.col("_status").isNotNull()
    status = F.when(~F.col("readable"), None).when(~mine, "UNREGISTERED").otherwise(F.col("_status"))
    http = F.when(~F.col("readable"), 400).when(~mine, 401).when(F.col("_status") == "ACTIVE", 200)
    return rows.select(
        "request_id",
        http.otherwise(403).alias("http_status"),
        status.alias("client_status"),
        status_message(status).alias("message"),
    )


def change_answers(
    changes: DataFrame, bindings: DataFrame, licences: DataFrame, now: Column
) -> DataFrame:
    """One answer per subscribed device of every changed licence; changes may be a stream."""
    devices = bindings.select(
        "licence_id", F.col("id").alias("binding_id"), F.col("status").alias("binding_status")
    )
    states = licences.select(
        F.col("id").alias("licence_id"), effective_status(now).alias("_status")
    )
    rows = changes.join(devices, "licence_id").join(states, "licence_id")
    status = F.when(F.col("binding_status") == "ACTIVE", F.col("_status")).otherwise("UNREGISTERED")
    return rows.select(
        "change_id", "licence_id", "binding_id",
        status.alias("client_status"), status_message(status).alias("message"),
    )


def latest_records(changes: DataFrame, key: str = "id", order: tuple[str, ...] = ("changed_at", "change_no")):
    """Store contents after a table of change rows: the last change of every key wins."""
    return latest_per_key(changes, [key], list(order))


def valid_server_answer(document: Column, root: str = "$") -> Column:
    """True for an answer that can be used; unknown statuses and wrong types are refused."""
    at = lambda name: f"{root}.{name}"
    present = lambda name: F.try_variant_get(document, at(name), "variant").isNotNull()
    null_or = lambda name, kind: present(name) & (
        _is_absent(document, at(name)) | _is_type(document, at(name), kind)
    )
    optional_text = lambda name: ~present(name) | _is_type(document, at(name), "STRING")
    numbers = "BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT"
    token = _text(document, at("token"))
    checks = [
        _text(document, at("status")).isin(SERVER_STATUSES),
        null_or("expiresAt", numbers),
        _number(document, at("serverTime")).isNotNull(),
        null_or("plan", "STRING"), null_or("customer", "STRING"), null_or("codeHint", "STRING"),
        optional_text("token") & F.coalesce(F.length(token) >= 20, F.lit(True)),
        optional_text("message"),
    ]
    result = F.lit(True)
    for check in checks:
        result = result & F.coalesce(check, F.lit(False))
    return result


def read_push_messages(messages: DataFrame, text: str = "message") -> DataFrame:
    """Adds kind (null when refused), status and reason of push messages."""
    rows = messages.withColumn("_document", parse_document(F.col(text)))
    document = F.col("_document")
    kind = _text(document, "$.type")
    good = kind.isin("AUTH_OK", "AUTH_FAILED", "PONG") | (
        (kind == "LICENCE_STATUS") & valid_server_answer(document, "$.licence")
    )
    kept = F.when(F.coalesce(good, F.lit(False)), kind)
    return rows.withColumns(
        {
            "kind": kept,
            "status": F.when(kept == "LICENCE_STATUS", _text(document, "$.licence.status")),
            "reason": F.when(
                kept == "AUTH_FAILED", F.coalesce(_text(document, "$.reason"), F.lit("unknown"))
            ),
        }
    ).drop("_document")

"""The given parquet tables and the lead and licence tables derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def _cents() -> Column:
    return F.round(F.col("l_extendedprice") * 100).cast("bigint")


def _line_id(cents: Column) -> Column:
    return F.concat_ws(
        "-", _text("l_orderkey"), _text("l_linenumber"), _text("l_partkey"), _text("l_suppkey"), cents.cast("string")
    )


def _choice(value: Column, options: dict, otherwise: Column | str | None = None) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    cases = F
    for key, result in options.items():
        cases = cases.when(value == F.lit(key), as_column(result))
    return cases.otherwise(as_column(otherwise))


def leads_raw(spark: SparkSession, folder: str) -> DataFrame:
    """One row per rendering of a lead card, derived from order lines."""
    read = lambda name, *columns: read_table(spark, folder, name).select(*columns)
    # lines are the largest table: they meet the orders once, with all that hangs on them, and carry only what is read of a line
    lines = read(
        "lineitem",
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag",
        _cents().alias("_cents"),
        F.col("l_quantity").cast("int").alias("_amount"),
        (F.col("l_tax") > 0.02).alias("mobile_available"),
        (F.col("l_discount") > 0.04).alias("whatsapp_available"),
    )
    orders = (
        read("orders", "o_orderkey", "o_custkey", "o_orderdate")
        .join(read("customer", "c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read("nation", "n_nationkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_orderdate", "n_nationkey", "c_mktsegment")
    )
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        read("part", "p_partkey", "p_name", "p_size", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
    )
    amount = F.col("_amount")
    amount_text = amount.cast("string")
    order, line, size = F.col("l_orderkey"), F.col("l_linenumber"), F.col("p_size")
    form = _choice(
        F.col("p_type"),
        {
            "PROMO": "Tablets", "ECONOMY": "Capsule", "MEDIUM": "Injections",
            "SMALL": "Tabletop", "LARGE": "Cream",
        },
        "Medicine",
    )
    title = F.concat(
        F.lit("  "), F.col("p_name"), F.lit(" "), _text("p_size"), F.lit("mg "), form,
        _choice(order % 11, {0: " for Personal Use", 1: " retailer"}, ""),
    )
    country = _choice(
        F.col("n_nationkey") % 13,
        {
            0: "USA", 1: "U.S.A.", 2: "Canada", 3: "U.K.", 4: "The Netherlands", 5: "Qatar",
            6: "Atlantis", 7: "Australia", 8: "New  Zealand", 9: "Great Britain", 10: "Korea",
            11: "Trinidad & Tobago",
        },
    )
    quantity = _choice(
        line % 7,
        {
            0: None,
            1: F.concat(amount_text, F.lit(" Strip")),
            2: F.concat(amount_text, F.lit(" Boxes")),
            3: F.concat(F.lit("1,0"), (F.lit(10) + amount % 90).cast("string"), F.lit(" Pcs")),
            4: "10-20 Strips",
            5: F.concat(amount_text, F.lit(" to 60 Boxes")),
        },
        F.concat(amount_text, F.lit(" Crates")),
    )
    age = _choice(
        F.col("o_orderkey") % 9,
        {
            0: "just now", 1: "22 mins ago", 2: "an hour ago", 3: "3 days ago", 4: "2 months ago",
            5: "yesterday", 6: "12 Sep", 7: None,
        },
        F.concat(line.cast("string"), F.lit(" weeks ago")),
    )
    return rows.select(
        _line_id(F.col("_cents")).alias("row_id"),
        F.concat(F.lit("card_"), _text("l_suppkey")).alias("card_id"),
        F.when(order % 97 != 0, title).alias("raw_title"),
        country.alias("country"),
        quantity.alias("quantity_raw"),
        age.alias("raw_lead_age"),
        _choice(
            F.col("l_returnflag"),
            {"A": None, "N": F.col("p_brand")},
            F.concat(F.lit("Pharmaceutical "), F.col("p_brand")),
        ).alias("category"),
        F.when(line % 2 == 0, F.col("p_type")).alias("product_category"),
        _choice(
            F.col("c_mktsegment"),
            {
                "FURNITURE": None,
                "BUILDING": "Paracetamol Tablet, Ibuprofen Tablet",
                "MACHINERY": "Home, Use Kit,,",
            },
            "Minoxidil Solution",
        ).alias("buys_raw"),
        _choice(
            size % 6,
            {
                0: "36 IU (12 mg)", 1: F.concat(_text("p_size"), F.lit("mg")), 2: "20mg + 10mg",
                3: "250 Mg/ml", 4: "High",
            },
        ).alias("strength_raw"),
        _choice(size % 4, {0: "TABLETS", 1: "Film Coated Tablet", 2: "Soft Gel"}).alias("dosage_form"),
        "mobile_available",
        "whatsapp_available",
        (F.col("l_returnflag") != "R").alias("email_available"),
        F.col("o_orderdate").alias("detected_at"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
        F.col("c_mktsegment").alias("company"),
    )


def licences(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    days = _choice(key % 4, {0: 30, 1: 90, 2: 365}, F.lit(3650)).cast("int")
    return read_table(spark, folder, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Pro").otherwise("Standard").alias("plan"),
        F.when(key % 17 == 0, "REVOKED")
        .when(key % 13 == 0, "SUSPENDED")
        .when(key % 7 == 0, "DISABLED")
        .otherwise("ACTIVE")
        .alias("status"),
        F.col("o_orderdate").alias("starts_at"),
        F.date_add(F.col("o_orderdate").cast("date"), days).alias("expires_on"),
        (1 + key % 3).cast("int").alias("max_devices"),
        F.col("o_orderdate").alias("created_at"),
    )


def device_bindings(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "lineitem").select(
        _line_id(_cents()).alias("id"),
        F.col("l_orderkey").alias("licence_id"),
        F.when(F.col("l_linestatus") == "O", "ACTIVE").otherwise("RELEASED").alias("status"),
        F.col("l_shipdate").alias("last_seen_at"),
    )


def audit_log(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("at"),
        F.col("user_id").alias("customer_id"),
        _choice(
            F.col("event_type"),
            {
                "signup": "LICENCE_CREATED",
                "purchase": "LICENCE_EXTENDED",
                "error": "ACTIVATION_REFUSED",
                "click": "LICENCE_ACTIVATED",
            },
            "ADMIN_LOGIN",
        ).alias("action"),
        F.when(F.col("event_type") == "error", "FAILURE").otherwise("SUCCESS").alias("result"),
    )

"""Stable identity of a lead across renderings.

Input rows are renderings: ``session_id``, ``card_id``, ``detected_at``, ``row_id`` and the raw
lead columns. Order is (detected_at, row_id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradesift.functions.hashing import cyrb53
from tradesift.functions import text as X
from tradesift.operators.normalize import (
    ITEM_SEPARATOR,
    NFKC_PREFIX,
    composed,
    drop_prepared,
    is_clean_list,
    prepare_texts,
    with_optional_columns,
)
from tradesift.operators.ordered import first_per_key, with_last_marked
from tradesift.operators.resolution import CONFLICT_KEYS, CONFLICTS, resolve
from tradesift.session import kept, scratch

# Separator and key order of the identity rules, and what stands for a card without identity.
FIELD_SEPARATOR = chr(0x241F)
INFO_KEYS = [
    "country", "quantity", "category", "productCategory", "buys", "strength", "dosageForm",
    "quantityPerStrip", "mobile", "whatsapp", "email", "requirements", "calls", "replies",
]
IDENTITY_COLUMNS = {
    "country": "country",
    "quantity": "quantity_raw",
    "category": "category",
    "productCategory": "product_category",
    "strength": "strength_raw",
    "dosageForm": "dosage_form",
    "quantityPerStrip": "quantity_per_strip_raw",
}
ORDER = ["detected_at", "row_id"]
FAILURES = ("failed", "unidentified")
#: Renderings that are resolved at a time, in whole sessions: it bounds the disk that the steps in between take.
GROUP_ROWS = 6_000_000


def with_identity(renderings: DataFrame, keep_prepared: bool = False) -> DataFrame:
    """Adds title_key, canonical_key, cross_card_key and the info map; keys null without identity."""
    rows = with_optional_columns(renderings)
    rows = prepare_texts(rows, ["raw_title", *IDENTITY_COLUMNS.values(), "buys"])
    compared = {"_title": "raw_title", **{f"_{name}": column for name, column in IDENTITY_COLUMNS.items()}}
    rows = X.add_collapsed(rows, {out: f"{NFKC_PREFIX}{column}" for out, column in compared.items()})
    joined = composed("buys")
    items = F.transform(
        F.split(joined, ITEM_SEPARATOR), lambda item: F.lower(F.coalesce(X.collapse_spaces(item), F.lit("")))
    )
    listed = F.when(is_clean_list(joined), F.replace(F.lower(joined), F.lit(ITEM_SEPARATOR), F.lit("|"))).otherwise(F.array_join(items, "|"))
    rows = rows.withColumns({**{out: F.lower(out) for out in compared}, "_buys_line": listed})
    buys = F.when(F.size("buys") > 0, F.col("_buys_line"))
    parts = {
        "t": F.col("_title"),
        "c": F.col("_country"),
        "q": F.col("_quantity"),
        "p": F.col("_productCategory"),
        "b": buys,
    }
    canonical = F.concat_ws(
        FIELD_SEPARATOR,
        *[F.concat(F.lit(f"{key}="), F.coalesce(part, F.lit(""))) for key, part in parts.items()],
    )
    title_key = F.coalesce("_title", "_productCategory")
    flag = lambda name: F.when(F.col(f"{name}_available"), "yes")
    count = lambda name: F.when(F.col("verified"), F.col(name).cast("string"))
    info = {name: F.col(f"_{name}") for name in IDENTITY_COLUMNS}
    info |= {"buys": F.nullif(buys, F.lit(""))}
    info |= {name: flag(name) for name in ("mobile", "whatsapp", "email")}
    info |= {name: count(name) for name in ("requirements", "calls", "replies")}
    entries = [F.struct(F.lit(key).alias("key"), info[key].alias("value")) for key in INFO_KEYS]
    rows = rows.withColumns(
        {
            "title_key": title_key,
            "canonical_key": F.when(title_key.isNotNull(), canonical),
            "cross_card_key": F.concat(
                title_key, F.lit(FIELD_SEPARATOR), F.coalesce("_country", F.lit(""))
            ),
            "info": F.map_from_entries(
                F.filter(F.array(*entries), lambda entry: entry.value.isNotNull())
            ),
        }
    )
    rows = rows.drop("_title", "_buys_line", *[f"_{name}" for name in IDENTITY_COLUMNS])
    return rows if keep_prepared else drop_prepared(rows)


def with_fingerprint(renderings: DataFrame) -> DataFrame:
    """Adds the hash of the identity; must follow a shuffle, see ``prepare_texts``."""
    return renderings.withColumn("fingerprint", F.concat(F.lit("fp_"), cyrb53(F.col("canonical_key"))))


def lead_id_of(fingerprint: Column) -> Column:
    return F.concat(F.lit("lead_"), F.substring(fingerprint, 4, 14))


def distinct_fingerprints(renderings: DataFrame) -> DataFrame:
    """Every identity once, with its fingerprint and first lead id."""
    keys = with_identity(renderings).select("canonical_key").filter("canonical_key IS NOT NULL")
    return with_fingerprint(keys.distinct()).withColumn("lead_id", lead_id_of(F.col("fingerprint")))


def exact_duplicates(renderings: DataFrame, key: str = "canonical_key") -> DataFrame:
    """First rendering of every identity within a session."""
    identified = renderings.filter(F.col(key).isNotNull())
    return first_per_key(identified, ["session_id", key], ORDER)


def with_signature(renderings: DataFrame, key: str = "canonical_key") -> DataFrame:
    """What a card shows: identity and information, or a failure marker; ``has_failed`` says so without the hash."""
    content = F.concat_ws(
        FIELD_SEPARATOR, F.col(key), F.to_json("info", {"ignoreNullFields": "true"})
    )
    failed = F.coalesce(F.col("failed"), F.lit(False)) if "failed" in renderings.columns else F.lit(False)
    # text that is no identity at all is told by what it is made of
    nameless = F.col("title_key").isNull() if key == "canonical_key" and "title_key" in renderings.columns else F.col(key).isNull()
    signature = F.when(failed, "failed").when(nameless, "unidentified").otherwise(F.sha2(content, 256))
    return renderings.withColumns({"signature": signature, "has_failed": failed | nameless})


def with_card_history(renderings: DataFrame, key: str = "canonical_key", keep: list[str] | None = None) -> DataFrame:
    """Adds ``unchanged`` (the card shows what it showed before) and ``linked_event``/``linked_row_id``, the card's last
    rendering that was identified and changed, if it has the same title key. ``event`` numbers the renderings.

    Only ``keep`` of the columns goes on (all, if not given); signatures and title keys are compared by 128-bit hashes.
    """
    shown = F.when(F.col("signature").isin(*FAILURES), F.col("signature")).otherwise(F.md5("signature"))
    rows = with_signature(renderings, key).select(
        *dict.fromkeys(["session_id", "card_id", *ORDER, *(renderings.columns if keep is None else keep)]),
        F.unhex(F.md5("title_key")).alias("_title_hash"), shown.alias("signature"), F.monotonically_increasing_id().alias("event"),
    )
    return _with_links(rows, F.col("signature").isin(*FAILURES))


def _with_links(rows: DataFrame, failed: Column, stored: bool = False) -> DataFrame:
    unchanged = F.coalesce(F.col("signature") == F.col("previous_signature"), F.lit(False))
    rows = with_last_marked(
        rows,
        ["session_id", "card_id"],
        [*ORDER, "event"],
        {"previous_signature": "signature"},
        ~unchanged & ~failed,
        {"_title": "_title_hash", "_event": "event", "_row_id": "row_id"},
        stored=stored,
    )
    linked = F.col("_title") == F.col("_title_hash")
    added = {"unchanged": unchanged, "linked_event": F.when(linked, F.col("_event")), "linked_row_id": F.when(linked, F.col("_row_id"))}
    return rows.withColumns(added).drop("_title", "_title_hash", "_event", "_row_id", "previous_signature")


def split_failures(renderings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(identified, failed) renderings; a later good rendering of the card is identified again."""
    failed = F.col("has_failed") if "has_failed" in renderings.columns else F.col("signature").isin(*FAILURES)
    return renderings.filter(~failed), renderings.filter(failed)


def _seen(stored: DataFrame) -> DataFrame:
    """Narrow rows with their card history: hashes for keys that are only compared, and the values that two cards of a lead share."""
    half = lambda text: F.unhex(F.md5(text))
    hashed = stored.withColumn("fingerprint", F.conv(cyrb53(F.col("canonical_key")), 16, 10).cast("long"))
    key = F.concat("session_id", F.lit(FIELD_SEPARATOR), "cross_card_key")
    rows = hashed.select(
        "session_id", "card_id", *ORDER, "event", "failed", "signature", half("title_key").alias("_title_hash"), half(key).alias("key"),
        "fingerprint", *[F.col(f"v_{name}").alias(c) for name, c in zip(CONFLICT_KEYS, CONFLICTS, strict=True)],
    )
    return _with_links(rows, F.col("failed"), stored=True).drop("linked_row_id", "signature")


def _outcomes(stored: DataFrame) -> DataFrame:
    seen = kept(_seen(stored))
    values = stored.select("event", *[f"v_{name}" for name in INFO_KEYS])
    resolved = resolve(seen.where("NOT failed AND NOT unchanged"), values, INFO_KEYS)
    hexadecimal = F.lpad(F.lower(F.hex("founder")), 14, "0")
    rows = seen.select("event", "session_id", "card_id", "row_id", "failed").join(resolved, "event", "left")
    outcome = F.coalesce("outcome", F.when(F.col("failed"), "failed").otherwise("unchanged"))
    return rows.select("session_id", "card_id", "row_id", F.concat(F.lit("lead_"), hexadecimal).alias("lead_id"), outcome.alias("outcome"), "revealed")


def scan_outcomes(renderings: DataFrame) -> DataFrame:
    """Outcome of every rendering: new, updated, duplicate, unchanged or failed, with the lead of the first three.

    Renderings are kept once. Nothing crosses a session, so groups of sessions are resolved one after the other, and what
    one of them left behind is gone before the next one starts.
    """
    spark = renderings.sparkSession
    shown = with_signature(with_identity(renderings)).select(
        "session_id", "card_id", *ORDER, "title_key", "canonical_key", "cross_card_key", F.col("has_failed").alias("failed"),
        F.unhex(F.md5("signature")).alias("signature"), *[F.col("info").getItem(name).alias(f"v_{name}") for name in INFO_KEYS],
        F.monotonically_increasing_id().alias("event"),
    )
    results = []
    with scratch(spark):
        stored = kept(shown)
        groups = max(1, -(-stored.count() // GROUP_ROWS))
        group = F.pmod(F.coalesce(F.xxhash64("session_id"), F.lit(0)), F.lit(groups))
        for number in range(groups):
            with scratch(spark):
                part = stored.where(group == number) if groups > 1 else stored
                results.append(kept(_outcomes(part), out=2))
    return reduce(DataFrame.unionByName, results)

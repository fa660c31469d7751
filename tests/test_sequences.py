"""Ordered sequences: registry, licences, request windows, client state; batch against plain replay."""

import datetime as dt
import random
import uuid

from pyspark.sql import functions as F

from tradesift.functions.hashing import _hash_texts, hmac_sha256
from tradesift.operators import cards, identity, ordered, replay, request_limits
from tradesift.sources import pages
from tradesift.streaming import jobs


def test_published_hash_value():
    assert _hash_texts(["hello", None]) == ["106f3a63cd7226", None]


def test_keyed_hash(spark):
    import hashlib
    import hmac

    got = spark.range(1).select(hmac_sha256(F.lit("KEY-A"), "key")).first()[0]
    assert got == hmac.new(b"key", b"KEY-A", hashlib.sha256).hexdigest()


RENDERING = (
    "session_id string, card_id string, row_id string, detected_at timestamp_ntz, raw_title string, country string, "
    "quantity_raw string, category string, product_category string, buys_raw string, "
    "mobile_available boolean, whatsapp_available boolean, email_available boolean"
)


def rendering(number, card, title="Tablets", country="USA", quantity="10 Strip", category=None, mobile=False):
    at = dt.datetime(2026, 1, 1) + dt.timedelta(hours=number)
    return ("s", card, f"{number:03d}", at, title, country, quantity, category, None, None, mobile, False, False)


def test_registry_sequence(spark):
    rows = [
        rendering(1, "a"),
        rendering(2, "a"),  # nothing changed
        rendering(3, "a", quantity="20 Strip"),  # the card finished rendering
        rendering(4, "b", quantity="20 Strip"),  # a copy
        rendering(5, "c", quantity="99 Strip"),  # other quantity: another lead
        rendering(6, "d", title=None),  # no identity
        rendering(30, "d"),  # first fingerprint again, two days later
        rendering(60, "c", quantity="99 Strip", mobile=True),
    ]
    frame = spark.createDataFrame(rows, RENDERING).repartition(4)
    got = {r.row_id: r for r in identity.scan_outcomes(frame).collect()}
    assert [got[key].outcome for key in sorted(got)] == [
        "new", "unchanged", "updated", "duplicate", "new", "failed", "updated", "updated",
    ]
    assert got["001"].lead_id == got["003"].lead_id == got["004"].lead_id == got["030"].lead_id
    assert got["005"].lead_id == got["060"].lead_id != got["001"].lead_id


def test_previous_row_crosses_chunks(spark):
    random.seed(1)
    start = dt.datetime(2026, 1, 1)
    rows = [("hot", start + dt.timedelta(minutes=random.randrange(10_000)), n, str(n)) for n in range(400)]
    frame = spark.createDataFrame(rows, "k string, at timestamp_ntz, n int, v string")
    got = ordered.with_previous(frame, ["k"], ["at", "n"], {"before": "v"}).collect()
    expected, last = {}, None
    for _, _, _, value in sorted(rows, key=lambda row: (row[1], row[2])):
        expected[value], last = last, value
    assert {r.v: r.before for r in got} == expected


def command(seq, name, device=None, days=None, at=None):
    at = seq * 1000 if at is None else at
    return (1, seq, at, name, device, days, None, "1.0", "ACTIVE", 10_000_000, 1)


COMMANDS = (
    "licence_id long, seq long, at_ms long, command string, device string, days int, until_ms long, "
    "version string, status string, start_expires_ms long, max_devices int"
)


def test_licence_life(spark):
    rows = [
        command(1, "activate", "d1"), command(2, "activate", "d2"), command(3, "suspend"),
        command(4, "activate", "d1"), command(5, "reactivate"), command(6, "release", "d1"),
        command(7, "release", "d1"), command(8, "activate", "d2"), command(9, "extend", days=30),
        command(10, "extend", days=31), command(11, "revoke"), command(12, "reactivate"), command(13, "reset-device"),
    ]
    got = replay.replay_licences(spark.createDataFrame(rows, COMMANDS)).orderBy("seq").collect()
    assert [r.http_status for r in got] == [200, 409, 200, 403, 200, 200, 409, 200, 200, 400, 200, 409, 200]
    assert got[1].detail == "device limit 1/1" and got[10].detail == "1 device(s) released"
    assert got[8].expires_ms == 10_000_000 + 30 * replay.DAY_MS and got[11].audit_result == "FAILURE"


def test_request_window_against_brute_force(spark):
    random.seed(2)
    hits = [("k", random.randrange(2000)) for _ in range(300)]
    got = request_limits.limit_requests(spark.createDataFrame(hits, "key string, at_ms long"), 3, 100).collect()
    allowed, ends, count = {}, None, 0
    for _, at in sorted(hits):
        if ends is None or ends <= at:
            ends, count = at + 100, 0
        count += 1
        allowed[at] = allowed.get(at, 0) + (count <= 3)
    assert {r.at_ms: r.allowed for r in got} == allowed


def test_stream_replay_equals_batch(spark, tmp_path):
    rows = [command(n, name, "d1") for n, name in enumerate(["activate", "suspend", "activate", "reactivate", "revoke"], 1)]
    for number, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, COMMANDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events = jobs.stateful_replay(stream, ["licence_id"], ["at_ms", "seq"], replay.Licence, replay.LICENCE_EVENTS)
    query = jobs.run_available(events, lambda b, i: jobs.write_batch(b, i, str(tmp_path / "out")), f"licences-{uuid.uuid4().hex}")
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").select("http_status", "new_status").collect()
    batch = replay.replay_licences(spark.createDataFrame(rows, COMMANDS)).orderBy("seq")
    assert got == batch.select("http_status", "new_status").collect()


CARD = (
    '<article><div class="BuyLdC_Gtc1"><div class="BuyLdC_brd"><span class="SLC_fwb BuyLdC_m6"> {title} </span></div>'
    '<div class="BuyLdC_time_loc"><div class="MrLdsB_m1"><strong class="SLC_f14">22 mins ago</strong></div>'
    '<div><strong>Canada<span>Click here to view BuyLeads from Canada</span></strong></div></div></div>'
    '<ul id="breadcrum_pmcat_div"><li><span title="Pharma">x</span><span title="Tablets">y</span></li></ul>'
    '<ul><li class="BuyLdC_isqdet"><span>Quantity per Strip</span><small>:</small><strong>10 Capsules</strong></li>'
    '<li class="BuyLdC_isqdet"><span>Quantity</span><small>:</small><strong>1,000 Pieces</strong></li>'
    '<li class="BuyLdC_isqByrDtls"><p><span>Buys</span>:<b>A, B</b></p></li></ul><p class="tooltip_vfr">WhatsApp Available</p></article>'
)


def test_cards_of_a_page(spark):
    html = "<html><body><section>" + CARD.format(title="One") + CARD.format(title="Two") + "</section></body></html>"
    page = ("p", "https://leads.example.com/x", html)
    frame = spark.createDataFrame([page, page, ("q", "https://example.org/", html)], "page_id string, url string, html string")
    got = cards.read_cards(pages.scan_pages(frame)).orderBy("card_no").collect()
    assert [(r.raw_title, r.country, r.lead_age_minutes) for r in got] == [("One", "Canada", 22.0), ("Two", "Canada", 22.0)]
    first = got[0]
    assert (first.quantity_raw, first.quantity_per_strip_raw, first.buys) == ("1,000 Pieces", "10 Capsules", ["A", "B"])
    assert (first.category, first.product_category, first.whatsapp_available) == ("Pharma", "Tablets", True)
    assert first.confidence == 1.0 and first.failed_fields == []

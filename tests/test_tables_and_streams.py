"""Profiles as rows, isolated failures, running counters and request windows on awkward rows."""

import datetime as dt
import json
import random
import uuid

from pyspark.sql import functions as F

from tradesift.operators import filtering, isolation, profile_table, request_limits
from tradesift.operators.normalize import normalize_leads
from tradesift.plans.profiles import DEFAULT_FILTER
from tradesift.streaming import counters, jobs

LEAD = (
    "row_id string, seller_id long, raw_title string, country string, quantity_raw string, raw_lead_age string, category string, "
    "product_category string, buys_raw string, strength_raw string, dosage_form string, mobile_available boolean, "
    "whatsapp_available boolean, email_available boolean"
)


def lead(row_id, seller, title, country="Canada", quantity="50 Strip", buys=None, mobile=True):
    return (row_id, seller, title, country, quantity, None, None, None, buys, None, None, mobile, False, False)


def profile(**changes):
    return {**json.loads(json.dumps(DEFAULT_FILTER)), **changes}


def test_profiles_of_a_seller_equal_one_by_one(spark):
    rows = [
        lead("a", 1, "Red boxes of medicine"), lead("a", 1, "Red boxes of medicine"), lead("b", 1, "boxed red", "Peru", None), lead("c", 1, None),
        lead("d", 2, "Tablets for personal use"), lead("e", 2, "capsule", buys="red box, other"), lead("f", None, "medicine"), lead("g", 3, "medicine", mobile=None),
    ]
    words = lambda mode, *values: {"enabled": True, "mode": mode, "values": [{"value": v, "enabled": True} for v in values], "fields": ["title", "buyerProducts"]}
    table = {
        "p1": (1, profile(keywords=words("ALL", "red box", "medicines"))),
        "p2": (1, profile(keywords=words("ANY", "box", "!!"), logic={"mode": "OR"})),
        "p3": (2, profile(keywords=words("ANY", "red boxes"), quantity={"enabled": False, "min": None, "max": None})),
        "p4": (2, profile(enabled=False)),
        "p5": (2, profile(countries={"enabled": True, "mode": "ALL", "values": [{"value": "CA", "enabled": True}, {"value": "Atlantis", "enabled": False}]})),
    }
    leads = normalize_leads(spark.createDataFrame(rows, LEAD))
    texts = [(name, seller, json.dumps(p)) for name, (seller, p) in table.items()] + [("bad", 1, "{"), ("none", 3, None)]
    got = profile_table.evaluate_profile_table(leads, spark.createDataFrame(texts, "profile_id string, seller_id long, profile string"), ["row_id"])
    got = sorted((r.profile_id, r.row_id, r.passed, ",".join(r.failed_groups)) for r in got.collect())
    wanted = []
    for name, (seller, p) in [*table.items(), ("bad", (1, DEFAULT_FILTER)), ("none", (3, DEFAULT_FILTER))]:
        rows = filtering.evaluate_filter(leads.where(F.col("seller_id") == seller), p).select("row_id", "passed", "failed_groups").collect()
        wanted += [(name, r.row_id, r.passed, ",".join(r.failed_groups)) for r in rows]
    assert got == sorted(wanted)


def test_failed_leads_keep_their_payload(spark, tmp_path):
    good = json.dumps({"raw_title": "Tablets", "quantity_raw": "5 Strip", "mobile_available": True})
    texts = {1: good, 2: good[:9], 3: None, 4: '{"quantity_raw": "%s Box"}' % ("9" * 400), 5: '{"mobile_available": "perhaps"}', 6: "{}", 7: "[]"}
    rows = isolation.normalize_payloads(spark.createDataFrame(list(texts.items()), "row_id long, payload string"))
    got = {r.row_id: r for r in rows.collect()}
    assert {k: r.failed_step for k, r in got.items()} == {1: None, 2: "read", 3: "read", 4: "normalize", 5: "read", 6: None, 7: "read"}
    assert all(got[k].payload == texts[k] for k in texts) and got[1].quantity_value == 5 and got[4].quantity_raw is not None
    assert got[5].raw_title is None and got[2].title_normalized is None
    isolation.write_isolated(rows.select("row_id", "payload", "failed_step", "error"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/failed=true")).count() == 5
    assert {(r.failed_step, r.n) for r in isolation.failure_counts(rows).collect()} == {("read", 1), ("read", 3), ("normalize", 1)}


def test_counters_over_three_batches(spark, tmp_path):
    draw, at = random.Random(3), dt.datetime(2026, 1, 1)
    schema = "lead_id string, detected_at timestamp_ntz, row_id string, passed boolean, failed_groups array<string>, priority string, score int, failed_fields array<string>, confidence double, normalization_warnings array<string>"
    rows = []
    for k in range(60):
        ok = draw.random() < 0.5
        rows.append((
            f"l{draw.randrange(9)}", at + dt.timedelta(minutes=draw.randrange(20)), f"{k:02d}", ok, [] if ok else draw.sample(["a", "b"], draw.randint(0, 2)),
            draw.choice(["HIGH", "LOW", None]), 50 + k if ok else None, draw.sample(["x", "y"], 1), draw.choice([0.5, None]), ["w"] * draw.randint(0, 2),
        ))
    table = spark.createDataFrame(rows, schema)
    for part in range(3):
        amounts = F.to_json(counters.contributions(table)).alias("amounts")
        table.where(F.col("row_id").cast("int") % 3 == part).select("lead_id", "detected_at", "row_id", amounts).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("lead_id string, detected_at timestamp_ntz, row_id string, amounts string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    counters.running_totals(stream, f"{tmp_path}/out", f"counters-{uuid.uuid4().hex}").awaitTermination()
    got = {(r.counter, r.name): r.amount for r in counters.totals(spark.read.parquet(f"{tmp_path}/out")).collect()}
    newest = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        newest[r[0]] = r
    wanted = {("scan", "processed"): 60, ("scan", "detected"): len(newest)}
    for _, _, _, ok, groups, priority, score, fields, sure, warnings in newest.values():
        names = [("verdict", "matched" if ok else "rejected"), *(("failed_group", g) for g in groups), *(("failed_field", f) for f in fields)]
        names += [("warning", w) for w in warnings] + ([("priority", priority)] if priority else [])
        amounts = [(n, 1) for n in names] + [((c, "sum"), v) for c, v in (("score", score), ("confidence", sure)) if v is not None]
        amounts += [((c, "n"), 1) for c, v in (("score", score), ("confidence", sure)) if v is not None]
        for name, amount in amounts:
            wanted[name] = wanted.get(name, 0) + amount
    assert got == wanted


def test_counters_share_states(spark, tmp_path):
    """Many leads, few states: a later evaluation takes back the earlier one, also within a batch and without a time."""
    at, schema = dt.datetime(2026, 1, 1), "lead_id string, detected_at timestamp_ntz, row_id string, amounts string"
    amounts = [json.dumps([{"counter": "verdict", "name": name, "amount": 1.0}]) for name in ("matched", "rejected")]
    first = [(f"l{k}", at, "a", amounts[0]) for k in range(500)] + [("l1", at, "b", amounts[1]), (None, at, "a", amounts[0]), ("untimed", None, "a", amounts[0])]
    second = [(f"l{k}", at - dt.timedelta(1), "c", amounts[1]) for k in range(2, 100)] + [("l3", at, "d", amounts[1]), ("untimed", at, "a", amounts[1]), ("untimed", None, "z", amounts[0])]
    for part in (first, second):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = counters.running_totals(stream, f"{tmp_path}/out", f"counters-{uuid.uuid4().hex}", buckets=8)
    query.awaitTermination()
    got = {(r.counter, r.name): r.amount for r in counters.totals(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert got == {("verdict", "matched"): 499, ("verdict", "rejected"): 3, ("scan", "detected"): 502, ("scan", "processed"): 604}
    assert query.lastProgress.stateOperators[0].numRowsTotal <= 8


def test_request_windows_of_awkward_keys(spark):
    draw = random.Random(6)
    hits = [("hot", draw.randrange(3000)) for _ in range(200)] + [(None, 5), (None, 6), (None, 500), ("one", 7)] + [("same", 9)] * 5
    got = request_limits.limit_requests(spark.createDataFrame(hits, "key string, at_ms long"), 2, 100).collect()
    wanted = {}
    for key in {k for k, _ in hits}:
        ends, used = None, 0
        for at in sorted(t for k, t in hits if k == key):
            if ends is None or at >= ends:
                ends, used = at + 100, 0
            used += 1
            allowed, refused = wanted.get((key, at), (0, 0))
            wanted[key, at] = (allowed + (used <= 2), refused + (used > 2))
    assert {(r.key, r.at_ms): (r.allowed, r.refused) for r in got} == wanted
    assert request_limits.limit_requests(spark.createDataFrame([], "key string, at_ms long"), 2, 100).collect() == []


def test_arriving_pages_keep_their_partitions(spark, tmp_path):
    """Every partition writes a file of its own, and the files are dealt to the wanted number of batches."""
    rows = spark.range(100).repartition(10)
    assert jobs.write_arriving(rows, str(tmp_path / "in"), batches=3) == 4
    stored = spark.read.parquet(str(tmp_path / "in"))
    assert len(stored.inputFiles()) == 10 and stored.count() == 100
    assert jobs.write_arriving(rows.where("id < 0"), str(tmp_path / "none")) == 1


def test_profiles_do_not_travel_with_pairs(spark):
    """What joins the keyword hits has neither the profile nor the lines of the lead."""
    leads = normalize_leads(spark.createDataFrame([lead("a", 1, "Red boxes of medicine")], LEAD))
    texts = spark.createDataFrame([("p1", 1, json.dumps(DEFAULT_FILTER))], "profile_id string, seller_id long, profile string")
    node = profile_table.evaluate_profile_table(leads, texts, ["row_id"])._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join" or "profile_id" not in node.condition().toString():
        node = node.children().apply(0)
    output = node.children().apply(0).output()
    names = {output.apply(k).name() for k in range(output.size())}
    assert "profile_id" in names and names.isdisjoint({"p", "countries", "_words_title", "country_normalized"})


def test_profiles_do_not_pass_the_driver(spark):
    """No join with what grows with the profiles is a broadcast, however small they look."""
    leads = normalize_leads(spark.createDataFrame([lead("a", 1, "Red boxes of medicine")], LEAD))
    texts = spark.createDataFrame([("p1", 1, json.dumps(DEFAULT_FILTER))], "profile_id string, seller_id long, profile string")
    plan = profile_table.evaluate_profile_table(leads, texts, ["row_id"])._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.split("\n") if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert not [line for line in sent if "seller_id" in line or "profile_id" in line]
    assert plan.count("SortMergeJoin") >= 3

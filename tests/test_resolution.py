"""Resolution by links and rounds against the registry replayed by a recursive query, on crowded sessions."""

import datetime as dt
import os
import random
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import lead_sql
from tradesift import session
from tradesift.operators import identity, ordered

SCHEMA = (
    "session_id string, card_id string, row_id string, detected_at timestamp_ntz, raw_title string, country string, quantity_raw string, "
    "category string, product_category string, buys_raw string, strength_raw string, dosage_form string, "
    "mobile_available boolean, whatsapp_available boolean, email_available boolean"
)
NAMES = [column.split()[0] for column in SCHEMA.split(", ")]
RAW = """raw AS (SELECT *, CASE WHEN buys_raw IS NULL THEN [] ELSE [buys_raw] END AS buyer_products FROM renderings)"""


def crowded(seed, n, cards, titles, rare):
    """Renderings of few leads on few cards: many share title and country, many have gaps, some change on their card."""
    draw = random.Random(seed)
    some = lambda *options: draw.choice([None, *options]) if draw.random() < rare else options[0]
    rows = []
    for k in range(n):
        at = dt.datetime(2026, 1, 1) + dt.timedelta(minutes=k // 2)
        rows.append((
            "s2026-01", f"c{draw.randrange(cards)}", f"{k:05d}", at, draw.choice([f"t{x}" for x in range(titles)] + [None] * (k % 9 == 0)),
            some("usa", "peru"), some("5 strip", "7 strip", "9 box"), some("x", "y"), some("p1", "p2"), some("b1", "b2", "b3"),
            some("5mg"), some("gel"), draw.random() < 0.3, False, False,
        ))
    return rows


def replayed(rows):
    con = duckdb.connect()
    con.register("renderings", pd.DataFrame(rows, columns=NAMES).astype({"detected_at": "datetime64[us]"}))
    ctes = ",\n".join([RAW, lead_sql.IDENTITY.format(source="raw"), lead_sql._REGISTRY])
    return sorted(con.execute(f"WITH RECURSIVE {ctes} SELECT row_id, lead_id, outcome, revealed FROM resolved r JOIN fingerprints f ON f.canonical_key = r.lead").fetchall())


@pytest.mark.parametrize("seed, n, cards, titles, rare", [(1, 36, 5, 2, 0.9), (4, 30, 200, 1, 1.0)])
def test_rounds_equal_the_replay(spark, seed, n, cards, titles, rare):
    rows = crowded(seed, n, cards, titles, rare)
    got = identity.scan_outcomes(spark.createDataFrame(rows, SCHEMA)).where("lead_id IS NOT NULL").collect()
    assert sorted((r.row_id, r.lead_id, r.outcome, ",".join(r.revealed)) for r in got) == replayed(rows)


def test_no_renderings(spark):
    assert identity.scan_outcomes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_keys_too_large_for_one_sort(spark, monkeypatch):
    """Keys that are cut into ranges give what the replay gives, as those do that are sorted at once."""
    monkeypatch.setattr(ordered, "LARGE_KEY", 8)
    rows = crowded(2, 24, 1, 2, 0.9)
    got = identity.scan_outcomes(spark.createDataFrame(rows, SCHEMA)).where("lead_id IS NOT NULL").collect()
    assert sorted((r.row_id, r.lead_id, r.outcome, ",".join(r.revealed)) for r in got) == replayed(rows)


def test_card_history_carries_only_what_is_asked_for(spark, monkeypatch):
    """Rows that are ordered are kept without the texts of identity, and once while no key is large."""
    stored = []
    monkeypatch.setattr(ordered, "kept", lambda rows: stored.append(rows.columns) or session.kept(rows))
    rows = spark.createDataFrame(crowded(3, 20, 2, 2, 0.5), SCHEMA)
    found = identity.with_card_history(identity.with_identity(rows), keep=["row_id"])
    assert {"canonical_key", "info", "title_key", "raw_title"}.isdisjoint(found.columns)
    assert len(stored) == 1 and {"canonical_key", "info", "title_key", "raw_title"}.isdisjoint(stored[0])
    assert found.count() == 20


def test_groups_of_sessions_leave_nothing_behind(spark, monkeypatch, tmp_path):
    """Sessions resolved in several groups give what the replay of each gives, and only the results stay on disk."""
    monkeypatch.setattr(identity, "GROUP_ROWS", 13)
    kept_in = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(f"s{at}", *row[1:2], f"{at}{row[2]}", *row[3:]) for at, seed in enumerate((5, 6)) for row in crowded(seed, 12, 3, 2, 0.9)]
    got = identity.scan_outcomes(spark.createDataFrame([*rows, (None, *rows[0][1:])], SCHEMA))
    results = {name.split("/")[-2] for name in got.inputFiles()}
    left = {path.name for path in tmp_path.rglob("kept-*")}
    got = got.where("lead_id IS NOT NULL AND session_id IS NOT NULL").collect()
    if kept_in:
        spark.sparkContext._jsc.sc().setCheckpointDir(kept_in.rsplit("/", 1)[0])
    assert left == results and len(results) > 1
    assert sorted((r.row_id, r.lead_id, r.outcome, ",".join(r.revealed)) for r in got) == replayed(rows)


def test_shuffle_files_go_when_rows_are_kept(spark):
    """The shuffles of kept rows are dropped with the write, and the setting is as before."""
    spark.conf.unset(session._CLEANUP)
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    rows = session.kept(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.max("id").alias("m")))
    assert tracker.shuffleStatuses().size() <= before and spark.conf.get(session._CLEANUP) == "false"
    assert rows.count() == 10


def test_failures_need_no_hash(spark):
    """Rows without identity are told by their title, so the hash is not made for the others."""
    rows = spark.createDataFrame(crowded(3, 20, 2, 2, 0.5), SCHEMA)
    _, failed = identity.split_failures(identity.with_signature(identity.with_identity(rows)))
    assert {r.signature for r in failed.collect()} == {"unidentified"}
    filters = [line for line in failed._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Filter" in line]
    assert filters and not any("sha2" in line for line in filters)

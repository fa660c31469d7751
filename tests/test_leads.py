"""Golden rows for normalization, filter and score, with the Unicode cases the SQL check cannot hold."""

import unicodedata

from pyspark.sql import functions as F

from tradesift.functions import parsing as P
from tradesift.functions import text as X
from tradesift.operators import filtering, normalize, scoring
from tradesift.plans.profiles import DEFAULT_FILTER, DEFAULT_SCORING, word_forms

LEAD = (
    "row_id string, raw_title string, country string, quantity_raw string, raw_lead_age string, "
    "category string, product_category string, buys_raw string, strength_raw string, "
    "dosage_form string, mobile_available boolean, whatsapp_available boolean, email_available boolean"
)


def lead(row_id="1", title="Propranolol Tablets", country="USA", quantity="30 Strip", age="22 mins ago",
         strength=None, form=None, mobile=False, whatsapp=True, email=True):
    return (row_id, title, country, quantity, age, None, None, None, strength, form, mobile, whatsapp, email)


def test_text_forms(spark):
    nbsp, zero, joiner = chr(0xA0), chr(0x200B), chr(0x200D)
    rows = spark.createDataFrame(
        [(f"  A{nbsp}{nbsp}B ",), (f"x{zero}y",), (f"x{joiner}y",), (chr(0xFF21),), ("   ",), (None,)], "t string"
    )
    got = rows.select(X.display_text(F.col("t")), X.identity_text(F.col("t"))).collect()
    assert [row[0] for row in got] == ["A B", "x y", "xy", "A", None, None]
    assert [row[1] for row in got] == ["a b", f"x{zero}y", f"x{joiner}y", "a", None, None]


def test_alias_keys_drop_accents(spark):
    rows = spark.createDataFrame(
        [("The  Netherlands",), ("Côte d'Ivoire",), ("Trinidad & Tobago",), ("U.S.A.",), ("Türkiye",)], "country string"
    )
    got = normalize.with_country(rows).select("country", "country_code").collect()
    assert {row[0]: row[1] for row in got} == {
        "The  Netherlands": "NL", "Côte d'Ivoire": "CI", "Trinidad & Tobago": "TT", "U.S.A.": "US", "Türkiye": "TR",
    }


def test_measures(spark):
    cases = {
        "2 Boxes": (2.0, "Boxes", "box"), "1,000 Pieces": (1000.0, "Pieces", "piece"),
        "2.5 Kg": (2.5, "Kg", "kg"), "10-20 Strips": (None, None, None), "10 to 20 Boxes": (None, None, None),
        "1,00 Pieces": (None, None, None), "100": (100.0, None, None),
        "5 Strips of 10 Tablets": (5.0, "Strips of 10 Tablets", "strip"), "7 Crates": (7.0, "Crates", "crates"),
    }
    rows = spark.createDataFrame([(text,) for text in cases], "q string")
    got = normalize.with_measure(rows, "quantity", "q", "m").collect()
    assert {r.q: (r.m_value, r.m_unit, r.m_normalized_unit) for r in got} == cases


def test_strengths(spark):
    cases = {
        "20MG": (20.0, "mg", None, None, False), "250 Mg/ml": (250.0, "mg/ml", None, None, False),
        "10 mg/5 ml": (10.0, "mg/5ml", None, None, False), "40% w/w": (40.0, "% w/w", None, None, False),
        "36 IU (12 mg)": (36.0, "iu", 12.0, "mg", True), "20mg + 10mg": (20.0, "mg", 10.0, "mg", True),
        "20mg/10mg": (20.0, "mg", 10.0, "mg", True), "High": (None, None, None, None, False),
        "5 " + chr(0xB5) + "g": (5.0, "mcg", None, None, False),
    }
    rows = spark.createDataFrame([(text,) for text in cases], "strength_raw string")
    got = normalize.with_strength(rows).collect()
    assert {
        r.strength_raw: (r.strength_value, r.strength_unit, r.strength_secondary_value, r.strength_secondary_unit, r.strength_complex)
        for r in got
    } == cases


def test_lead_ages(spark):
    cases = {"just now": 0.0, "an hour ago": 60.0, "30 secs ago": 1.0, "2 months ago": 86400.0, "yesterday": None, "12 Sep": None}
    rows = spark.createDataFrame([(text,) for text in cases], "raw_lead_age string")
    got = normalize.with_lead_age(rows).collect()
    assert {r.raw_lead_age: r.age_minutes for r in got} == cases


def test_plural_forms_go_both_ways():
    assert {"tablets", "tabletes", "tablet"} <= set(word_forms("tablet"))
    assert "remedy" in word_forms("remedies") and "remedies" in word_forms("remedy")
    assert "tabletop" not in word_forms("tablet")


def test_default_profile_and_score(spark):
    leads = [
        lead("match", quantity="50 Strip", age=None),
        lead("few", quantity="10 Strip"),
        lead("abroad", country="Qatar"),
        lead("excluded", title="Tablets for Personal Use"),
        lead("word", title="Tabletop"),
        lead("phrase", title="Tablets for personal user"),
    ]
    rows = normalize.normalize_leads(spark.createDataFrame(leads, LEAD))
    got = scoring.score_leads(filtering.evaluate_filter(rows, DEFAULT_FILTER), DEFAULT_SCORING)
    got = {r.row_id: r for r in got.collect()}
    assert {k: r.status for k, r in got.items()} == {
        "match": "MATCHED", "few": "REJECTED", "abroad": "REJECTED", "excluded": "REJECTED",
        "word": "REJECTED", "phrase": "MATCHED",
    }
    best = got["match"]
    assert (best.score, best.priority, len(best.score_reasons)) == (68, "MEDIUM", 9)
    assert got["few"].score is None and got["few"].failed_groups == ["quantity"]


def test_late_filter_keeps_one_computation(spark):
    rows = normalize.normalize_leads(spark.createDataFrame([lead()], LEAD))
    plan = filtering.evaluate_filter(rows, DEFAULT_FILTER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_a_score_needs_no_reasons(spark):
    """Score and priority read verdicts; the texts of reasons are made only where they are asked for."""
    rows = normalize.normalize_leads(spark.createDataFrame([lead()], LEAD))
    got = scoring.score_leads(filtering.evaluate_filter(rows, DEFAULT_FILTER), DEFAULT_SCORING).select("row_id", "score", "priority")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "COUNTRY_MISMATCH" not in plan and "regexp_extract(_words" not in plan


def test_texts_go_to_python_together(spark):
    rows = normalize.normalize_leads(spark.createDataFrame([lead()], LEAD))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1 and plan.split("ArrowEvalPython [")[1].split("]")[0].count("_nfkc") <= 2


def test_lists_and_word_lines_of_any_text(spark):
    texts = [None, "", " , ", "a,b", "  a  b ,, c\t", ",x", "x , ", "Ünit  A, b", "café , ", "a|b,!!,c-d"]
    lists = {
        None: [], "": [], " , ": [], "a,b": ["a", "b"], "  a  b ,, c\t": ["a b", "c"], ",x": ["x"], "x , ": ["x"],
        "Ünit  A, b": ["Ünit A", "b"], "café , ": ["café"], "a|b,!!,c-d": ["a|b", "!!", "c-d"],
    }
    rows = spark.createDataFrame([(text,) for text in texts], "buys_raw string")
    rows = normalize.with_buyer_products(normalize.with_optional_columns(rows))
    rows = rows.withColumns({name: F.lit(None).cast("string") for name in ("title_normalized", "product_category_text", "category_text")})
    got = filtering.add_word_lines(rows).collect()
    composed = lambda item: unicodedata.normalize("NFC", item)
    assert {r.buys_raw: [composed(item) for item in r.buyer_products] for r in got} == lists
    lines = {r.buys_raw: r._words_buyer_products for r in got}
    assert lines["a|b,!!,c-d"] == " a b |  | c d " and lines[""] == ""


def test_ascii_rows_are_empty_lists_for_python(spark):
    """Null lists made the work of a batch grow with the square of its rows."""
    rows = spark.createDataFrame([("a", "b"), ("ﬁ", "b"), (None, "Ａ"), (None, None), ("", None)], "s string, t string")
    texts, given = {"x": F.col("s"), "y": F.col("t")}, []
    X._together(texts, lambda lists: given.append(lists) or lists)
    assert [r[0] for r in rows.select(given[0]).collect()] == [[], ["ﬁ", "b"], [None, "Ａ"], [], []]
    assert [tuple(r) for r in rows.select(*X.nfkc_together(texts).values()).collect()] == [("a", "b"), ("fi", "b"), (None, "A"), (None, None), ("", None)]
    plain = rows.select(*X.nfkc_without_accents_together(texts).values()).collect()
    assert [tuple(r) for r in plain] == [("a", "b"), ("fi", "b"), (None, "A"), (None, None), ("", None)]


def test_ascii_text_is_cleaned_like_any_other(spark):
    """Every kind of blank in every place, alone and doubled, as in text that has a letter beyond ASCII."""
    blanks = [" ", "  ", "\t", "\n", "\x0b", "\f", "\r", "\r\n", " \t"]
    texts = ["", "a", "a b", *blanks, *[f"{x}a" for x in blanks], *[f"a{x}" for x in blanks], *[f"a{x}b" for x in blanks]]
    rows = spark.createDataFrame([(text,) for text in texts] + [(None,)], "t string")
    got = rows.select("t", X.display_text(F.col("t")).alias("shown"), X.collapse_spaces(F.col("t")).alias("collapsed")).collect()
    for row in got:
        wanted = " ".join(row.t.split()) or None if row.t is not None else None
        assert (row.shown, row.collapsed) == (wanted, wanted)
    plan = rows.select(X.display_text(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan.upper()


def test_texts_without_a_number_are_not_cast(spark):
    """An empty number never reaches the cast, which would raise an error inside for every such text."""
    texts = ["5 Strip", "1,000.5 Box", "about five", "", "10-20 Strips", "7", None]
    rows = P.add_measure(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "m")
    got = {r.t: r.m_value for r in rows.collect()}
    assert got == {"5 Strip": 5, "1,000.5 Box": 1000.5, "about five": None, "": None, "10-20 Strips": None, "7": 7, None: None}
    casts = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().split("\n") if " as double" in line]
    assert casts and all("cast(CASE WHEN" in line for line in casts)

"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from rows import DOC_SCHEMA, awkward_rows, docs, words
from tradesift.llm import decontamination, embedding_dedup, language_id, line_dedup, lm_scoring, near_dedup, packing, secret_scan
from tradesift.llm import substring_dedup, token_counts

IDS = [r[0] for r in awkward_rows()]


@pytest.fixture(scope="module")
def awkward(spark):
    return docs(spark, awkward_rows()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    long_item = " ".join(words(1, 30_000).split()[100:130])
    rows = [(1, long_item), (1, long_item), (2, None), (3, ""), (None, long_item), (4, "日本語")]
    return spark.createDataFrame(rows, "item_id long, text string")


def sorted_ids(rows):
    return sorted((r.doc_id for r in rows), key=lambda i: (i is None, i))


ONE_ROW_EACH = {
    "language_id": lambda d, items: language_id.identify(d, language_id.fit(d)),
    "decontamination": lambda d, items: decontamination.digest(decontamination.find_hits(d, items)),
    "token_counts": lambda d, items: token_counts.token_counts(d),
    "lm_scoring": lambda d, items: lm_scoring.score(d, learn=F.col("doc_id") % 2 == 1, block_bytes=1 << 16),
    "line_dedup": lambda d, items: line_dedup.line_report(d),
    "substring_dedup": lambda d, items: substring_dedup.remove_repeats(d),
    "near_dedup": lambda d, items: near_dedup.near_duplicates(d, 80),
}


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_one_row_for_each_row(name, awkward, empty, items):
    rows = ONE_ROW_EACH[name](awkward, items).collect()
    assert sorted_ids(rows) == sorted(IDS, key=lambda i: (i is None, i))
    assert ONE_ROW_EACH[name](empty, items).collect() == []


def test_language_of_awkward_texts(awkward):
    got = {r.doc_id: r for r in language_id.identify(awkward, language_id.fit(awkward)).collect() if r.doc_id}
    assert [got[i].lang_pred for i in (3, 4, 5, 6)] == ["und"] * 4 and got[3].score == 0
    assert got[7].lang_pred != "und" and 0 <= got[7].score <= 1
    assert {r.lang_pred for r in language_id.identify(awkward, None).collect()} == {"und"}


def test_items_without_words_or_rows(spark, awkward, items):
    none = decontamination.digest(decontamination.find_hits(awkward, items.where("false"))).collect()
    assert all(r.n_hit == 0 and not r.contaminated for r in none)
    got = {r.doc_id: r for r in decontamination.digest(decontamination.find_hits(awkward, items)).collect() if r.doc_id}
    assert (got[7].n_hit, got[7].n_items, got[10].n_hit, got[3].n_words) == (30, 1, 1, 0)


def test_many_automata_give_each_row_its_own_hits(spark, monkeypatch):
    first, second = words(700, 30), words(701, 30)
    items = spark.createDataFrame([(1, first), (2, second), (3, words(702, 30))], "item_id long, text string")
    rows = [*awkward_rows(), (1, f"x {first} y"), (1, f"{second} z"), (None, first), (None, f"{first} {second}")]
    one = sorted(decontamination.find_hits(docs(spark, rows), items).collect(), key=str)
    monkeypatch.setattr(decontamination, "AUTOMATON_WORDS", 30)
    assert len(decontamination.automata(items, "item_id", "text", decontamination.WINDOW)) == 3
    many = sorted(decontamination.find_hits(docs(spark, rows), items).collect(), key=str)
    assert many == one and len(many) == len(rows)
    hit = [(r.doc_id, r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in many if r.spans]
    wanted = [(1, 32, [(1, 31)], ["1"]), (1, 31, [(0, 30)], ["2"]), (None, 30, [(0, 30)], ["1"]), (None, 60, [(0, 60)], ["1", "2"])]
    assert sorted(hit, key=str) == sorted(wanted, key=str)


def test_token_counts_of_empty_texts(awkward):
    got = {r.doc_id: r for r in token_counts.token_counts(awkward).collect() if r.doc_id}
    assert [(got[i].n_bytes, got[i].n_tokens, got[i].over_limit) for i in (3, 4)] == [(0, 0, False)] * 2
    assert got[7].over_limit and 0 < got[7].fit_chars < len(words(1, 30_000))


def test_scores_of_empty_texts_and_without_training(awkward):
    got = {r.doc_id: r for r in lm_scoring.score(awkward, learn=F.lit(False)).collect() if r.doc_id}
    assert got[3].n_tokens == 1 and got[3].train_tokens == 0 and got[7].base_score == 0 and got[7].score == 0


def test_packing_keeps_documents_without_words(awkward, empty):
    rows = packing.pack(awkward).collect()
    without = [r for r in rows if r.doc_id in (3, 4, 5)]
    assert len(without) == 3 and all(r.bin_id is None and r.n_tokens == 0 for r in without)
    assert sum(r.n_tokens for r in rows if r.doc_id == 7) == 30_001
    assert sum(1 for r in rows if r.doc_id == 1) == 2
    assert packing.pack(empty).collect() == []


def test_lines_of_awkward_texts(awkward):
    got = {r.doc_id: r for r in line_dedup.line_report(awkward).collect() if r.doc_id}
    assert got[3].n_lines == 0 and got[4].n_lines == 1 and got[11].removed == [1, 2, 3]
    assert got[1].n_removed == 0 and got[2].removed == [0]


def test_near_copies_of_awkward_texts(awkward):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(awkward, 80).collect() if r.doc_id}
    assert [got[i].component_id for i in (1, 2, 3, 4, 5, 8)] == [1, 1, 3, 4, 5, 7]
    assert got[3].n_shingles == 0 and got[6].n_shingles == 1


def test_secrets_of_awkward_texts(awkward, empty):
    rows = secret_scan.scan(awkward, path_col="source").collect()
    assert {r.doc_id for r in rows} == {9} and not rows[0].is_secret
    assert secret_scan.scan(empty).collect() == []


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    values = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0], [2.0, 0.0], [2.0, 0.0], [0.0, 1.0], [1.0]]
    rows = [*[(i, v, 0, "x") for i, v in enumerate(values)], (None, [1.0, 0.0], 0, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, keys string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(table).collect()}
    assert got == {**{i: (0, i) for i in (0, 1, 2, 3, 4, 5, 9, 10)}, 6: (2, 6), 7: (2, 6), 8: (2, 6), None: (0, None)}
    assert embedding_dedup.near_duplicates(table.where("false")).collect() == []


def test_stages(spark, awkward, empty, items, tmp_path):
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (awkward, empty):
        current = start
        for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
            after = stage(spark, current, str(tmp_path))
            folder = f"{tmp_path}/{name}-{start is awkward}"
            after.write.parquet(folder)
            if number < len(corpus_pipeline.STAGES) - 1:
                assert after.columns == current.columns
            current = spark.read.parquet(folder)
        assert (current.count() > 0) == (start is awkward)

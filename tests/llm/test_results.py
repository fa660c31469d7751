"""The operators against brute force, exact round trips or held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from rows import docs, words
from tradesift.llm import decontamination, embedding_dedup, language_id, line_dedup, lm_scoring, near_dedup, packing, secret_scan
from tradesift.llm import substring_dedup, token_counts
from tradesift.llm.common import components, read_table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return read_table(spark, SMALL, "documents").cache()


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def changed(text: str, draw: random.Random, edits: int) -> str:
    out = list(text)
    for _ in range(edits):
        at = draw.randrange(len(out) + 1)
        out[at : at + draw.randint(0, 1)] = draw.choice("abé🙂")
    return "".join(out)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def smallest_reachable(ids, links):
    near = {i: {i} for i in ids}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for i in sorted(ids):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in out:
                out[k] = i
                todo += near[k]
    return out


def test_components_match_a_search(spark):
    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 600)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    ends = {v for link in links if link[0] != link[1] for v in link}
    assert got == {v: c for v, c in smallest_reachable({v for link in links for v in link}, links).items() if v in ends}


def test_language_held_out(spark, documents):
    held_out = zlib.crc32
    rows = language_id.op1_language_id(spark, SMALL).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (held_out(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in unseen) >= 0.95 * len(unseen)


def test_windows_hold_every_byte():
    draw = np.random.default_rng(1)
    given = [draw.integers(97, 122, n).astype(np.uint8).tobytes() for n in (1, 255, 256, 257, 5000)]
    windows, sizes, owner = language_id.cut_windows(given)
    for k, text in enumerate(given):
        assert b"".join(w[:n].tobytes() for w, n, o in zip(windows, sizes, owner, strict=True) if o == k) == text


def test_vectors_against_all_pairs(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(40, 24))
    vectors = np.concatenate([c + draw.normal(size=(20, 24)) * draw.uniform(0.05, 0.35) for c in centres])
    vectors[7] = vectors[3] * 2.0
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = np.argwhere(np.triu(unit @ unit.T >= 0.95, 1))
    count = Counter(near.ravel().tolist())
    part = smallest_reachable(range(len(vectors)), near.tolist())
    table = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, miss=1e-6).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (count[i], part[i]) for i in range(len(vectors))}


def test_code_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(6)
    first = draw.normal(size=(1, 64))
    other = draw.normal(size=(1, 64))
    first /= np.linalg.norm(first)
    other /= np.linalg.norm(other)
    guesses = []
    for seed in range(300):
        turned = embedding_dedup.rotations(64, 64, seed)
        bits, factors = embedding_dedup.encode(first, turned)
        guesses.append(embedding_dedup.estimate(bits, factors, other @ turned.T)[0, 0])
    true = (first @ other.T)[0, 0]
    assert abs(np.mean(guesses) - true) < 4 * np.std(guesses) / math.sqrt(300)
    close = first + draw.normal(size=(1, 64)) * 0.035
    close /= np.linalg.norm(close)
    assert (first @ close.T)[0, 0] >= 0.95
    for seed in range(100):
        turned = embedding_dedup.rotations(64, 64, seed)
        bits, factors = embedding_dedup.encode(first, turned)
        assert embedding_dedup.estimate(bits, factors, close @ turned.T)[0, 0] >= 0.95 - embedding_dedup.margin(factors, 64, 0.95)[0]


def brute_hits(words_, items, window):
    hit, ids = set(), set()
    for item, own in items:
        n = min(window, len(own))
        for k in range(len(own) - n + 1 if n else 0):
            for at in range(len(words_) - n + 1):
                if words_[at : at + n] == own[k : k + n]:
                    hit.update(range(at, at + n))
                    ids.add(item)
    return hit, ids


@pytest.mark.parametrize("part_words", [decontamination.AUTOMATON_WORDS, 40])
def test_items_against_brute_force(spark, monkeypatch, part_words):
    monkeypatch.setattr(decontamination, "AUTOMATON_WORDS", part_words)
    draw = random.Random(8)
    word = lambda: draw.choice("abc")
    items = [(i, " ".join(word() for _ in range(draw.randint(1, 25)) if i % 3 or _ > 15)) for i in range(8)]
    rows = [(i, " ".join(word() for _ in range(draw.randint(0, 400)))) for i in range(30)]
    own = [(str(i), decontamination.words_of(t.encode())) for i, t in items]
    hits = decontamination.find_hits(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), window=6)
    got = {r.doc_id: r for r in decontamination.digest(hits).collect()}
    for i, text in rows:
        hit, ids = brute_hits(decontamination.words_of(text.encode()), own, 6)
        assert (got[i].n_hit, got[i].n_items) == (len(hit), len(ids)), i
        assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_cleaned_texts_hold_no_item(spark):
    item = words(90, 30)
    clean = words(91, 80)
    rows = [(1, clean), (2, f"{clean}. {item.upper()}, {clean}"), (3, item)]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontamination.decontaminate(docs(spark, rows), items).collect()}
    assert got.keys() == {1, 2} and got[1] == clean and item.upper() not in got[2] and got[2].count(clean) == 2


def test_token_counts_at_every_prefix():
    from tokenizers import Tokenizer

    path = token_counts.default_tokenizer()
    library, counter = Tokenizer.from_file(path), token_counts.PrefixCounter(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'", "é", "日本語", "<|endoftext|>", "<|end", "\x1c", "\xa0", "1", "23", ".", "!!", "🙂", " ing", "ſ"]
    draw = random.Random(3)
    for _ in range(400):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 12)))
        wanted = [count(text[:k]) for k in range(len(text) + 1)]
        assert counter.prefix_counts(text) == wanted, text
        budget = draw.randint(0, 9)
        assert counter.longest_prefix(text, budget) == max(k for k, n in enumerate(wanted) if n <= budget), (text, budget)


def test_token_counts_of_documents(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_counts.default_tokenizer())
    for r in token_counts.op4_token_counts(spark, SMALL).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


@pytest.mark.parametrize("order", [2, 3])
def test_scores_against_counts(documents, texts, order):
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    got = {r.doc_id: r for r in lm_scoring.score(documents, learn, order=order, block_bytes=1 << 16).collect()}
    token = {i: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None] for i, t in texts.items()}
    grams = Counter()
    for i, own in token.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            padded = [None] * (order - 1) + own
            for n in range(1, order + 1):
                grams.update(tuple(padded[k - n + 1 : k + 1]) for k in range(order - 1, len(padded)))
    total = sum(c for g, c in grams.items() if len(g) == 1)
    types = sum(len(g) == 1 for g in grams)
    for i, own in token.items():
        padded = [None] * order + own
        base = model = 0.0
        for k in range(order, len(padded)):
            p = (grams[(padded[k],)] + 1) / (total + types + 1)
            base += math.log10(p)
            for n in range(2, order + 1):
                history = grams[tuple(padded[k - n + 1 : k])]
                if history:
                    p = lm_scoring.WEIGHT * grams[tuple(padded[k - n + 1 : k + 1])] / history + (1 - lm_scoring.WEIGHT) * p
            model += math.log10(p)
        r = got[i]
        assert (r.n_tokens, r.train_tokens, r.n_known) == (len(own), total, sum(grams[(w,)] > 0 for w in own))
        assert abs(r.base_score - base) < 1e-6 and abs(r.score - model) < 1e-6


def brute_fit(lengths, sizes, bin_cost, opening):
    bins, left = [], sum(lengths)
    where = []
    for n in lengths:
        fitting = [(room - sum(own), k) for k, (room, own) in enumerate(bins) if room - sum(own) >= n]
        if fitting:
            least = min(f[0] for f in fitting)
            k = next(k for room, k in fitting if room == least)
        else:
            room = (opening if opening and opening >= n else None) or (
                min((s for s in sizes if s >= n), key=lambda s: ((s + bin_cost) / min(s, left), s)) if opening is None else min(s for s in sizes if s >= n)
            )
            k = len(bins)
            bins.append((room, []))
        bins[k][1].append(n)
        where.append(k)
        left -= n
    return sum(min(s for s in sizes if s >= sum(own)) + bin_cost for _, own in bins)


def test_packing_against_brute_force(spark):
    draw = random.Random(2)
    for _ in range(40):
        lengths = sorted((draw.randint(1, 64) for _ in range(draw.randint(1, 60))), reverse=True)
        best = min(brute_fit(lengths, (16, 32, 64), 3, opening) for opening in (None, 16, 32, 64))
        bins, _, sizes, held = packing.pack_lengths(lengths, (16, 32, 64), 3)
        cost = sum({b: s + 3 for b, s in zip(bins, sizes, strict=True)}.values())
        assert cost == best and all(h <= s for h, s in zip(held, sizes, strict=True))
    rows = [(i, words(i, draw.randint(0, 300))) for i in range(200)]
    packed = packing.pack(docs(spark, rows), (16, 32, 64), shard_tokens=2000).collect()
    total = Counter()
    for r in packed:
        total[r.doc_id] += r.n_tokens
    assert total == Counter({i: len(t.split()) + 1 if t else 0 for i, t in rows})
    for number in {r.bin_id for r in packed if r.bin_id is not None}:
        own = sorted((r for r in packed if r.bin_id == number), key=lambda r: r.bin_start)
        assert [r.bin_start for r in own] == [sum(q.n_tokens for q in own[:k]) for k in range(len(own))]
        assert sum(r.n_tokens for r in own) == own[0].bin_tokens <= own[0].bin_capacity
        assert own[0].bin_capacity == min(c for c in (16, 32, 64) if c >= own[0].bin_tokens)


def brute_lines(rows, edits, least):
    first, removed = {}, {}
    for i, text in sorted(rows):
        for k, line in enumerate(text.split("\n")):
            if len(line) >= least:
                if line in first:
                    removed.setdefault(i, set()).add(k)
                else:
                    first[line] = (i, k)
    for line, at in first.items():
        if any(other < at and abs(len(own) - len(line)) <= edits and distance(own, line) <= edits for own, other in first.items()):
            removed.setdefault(at[0], set()).add(at[1])
    return removed


@pytest.mark.parametrize(("edits", "hot"), [(2, 32), (2, 1), (1, 2), (3, 32)])
def test_lines_against_brute_force(spark, monkeypatch, edits, hot):
    monkeypatch.setattr(line_dedup, "ARRAY", hot)
    draw = random.Random(edits)
    base = [words(100 + k, 5, "abcé🙂") for k in range(6)]
    rows = [(i, "\n".join(changed(draw.choice(base), draw, draw.randint(0, 4)) for _ in range(draw.randint(1, 5)))) for i in range(40)]
    got = {r.doc_id: set(r.removed) for r in line_dedup.line_report(docs(spark, rows), edits, 12).collect() if r.removed}
    assert got == brute_lines(rows, edits, 12)
    left = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs(spark, rows), edits, 12).collect()}
    for i, text in rows:
        kept = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in got.get(i, ()))
        assert left.get(i, "").strip() == kept.strip()


def test_band_of_bits_is_the_edit_distance(spark):
    draw = random.Random(9)
    pairs = []
    for _ in range(1500):
        a = "".join(draw.choice("abé🙂") for _ in range(draw.randint(0, 14)))
        pairs.append((a, changed(a, draw, draw.randint(0, 4))))
    table = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 3, 4):
        told = line_dedup.edit_distance_within(F.col("a"), F.col("b"), edits)
        assert table.where(told != (F.levenshtein("a", "b") <= edits)).count() == 0


def brute_repeats(texts):
    seen, out = set(), {}
    for i, text in sorted(texts.items()):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(data[p : p + 100])
        spans = sum(1 for k in range(len(data)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(data), sum(gone), spans, bytes(x for x, g in zip(data, gone, strict=True) if not g))
    return out


def test_suffix_arrays():
    draw = random.Random(1)
    for _ in range(500):
        symbols = [draw.randint(1, draw.choice([1, 2, 3, 5])) for _ in range(draw.randint(1, 60))]
        assert substring_dedup.suffix_array(symbols) == sorted(range(len(symbols)), key=lambda k: symbols[k:])


@pytest.mark.parametrize("piece", [substring_dedup.PIECE, 300])
def test_substrings_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(substring_dedup, "PIECE", piece)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 1 << 14)
    draw = random.Random(piece)
    base = [words(200 + k, 60, "abcdeé") for k in range(8)]
    texts = {k: changed(draw.choice(base) + draw.choice(base), draw, draw.randint(0, 6))[draw.randint(0, 200) :] for k in range(80)}
    texts |= {200: None, 201: "", 202: "a" * 500, 203: "ab" * 400, 204: base[0][:99], 205: base[1][50:150], 206: f"x{base[1][50:150]}y"}
    got = substring_dedup.remove_repeats(docs(spark, list(texts.items()))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == brute_repeats(texts)


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    """Different texts of one id and of no id lose what occurs earlier, in the order of id and hash of the text."""
    base = [words(230 + k, 90) for k in range(4)]
    rows = [(1, base[0] + base[1]), (1, base[1] + base[2]), (2, base[2][:300] + base[0]), (None, base[3]), (None, base[3][50:] + base[0]), (None, None), (3, base[3] + "x")]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    wanted = brute_repeats(dict(enumerate(text for _, text in order)))
    got = substring_dedup.remove_repeats(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == sorted(
        ((order[k][0], *row) for k, row in wanted.items()), key=str
    )


def test_windows_of_large_groups_share_their_numbers(monkeypatch):
    draw = random.Random(4)
    pick = lambda n: [draw.choice([1, 1, 1, 2]) for _ in range(n)]
    for length in (4, 7):
        # whole and cut strings; cores that are alone, and one that most strings have
        strings = [
            np.array([*pick(draw.choice([length - 1, length - 1, 2])), draw.choice([1000, 1000, 1000, 1001, 1002]), *pick(draw.choice([length - 1, length - 1, 3]))])
            for _ in range(300)
        ]
        whole = substring_dedup._numbered(strings, length)
        for most in (300, 40, 1):
            monkeypatch.setattr(substring_dedup, "SORT_SYMBOLS", most)
            names: dict[tuple, set] = {}
            for s, numbers, wanted in zip(strings, substring_dedup._numbered(strings, length), whole, strict=True):
                assert ((numbers >= 0) == (wanted >= 0)).all() and (numbers >= 0).sum() == max(0, len(s) - length + 1)
                for k in np.flatnonzero(numbers >= 0).tolist():
                    names.setdefault(tuple(s[k : k + length].tolist()), set()).add(int(numbers[k]))
            assert all(len(n) == 1 for n in names.values()) and len(set.union(*names.values())) == len(names)
        monkeypatch.undo()


@pytest.mark.parametrize("cut", [True, False])
def test_passages_in_many_surroundings(spark, monkeypatch, cut):
    monkeypatch.setattr(substring_dedup, "SORT_SYMBOLS", 300)
    draw = random.Random(21)
    passage, sides = words(300, 12)[:70], [words(310 + k, 40) for k in range(6)]
    texts = {}
    for k in range(90):
        left, right = changed(draw.choice(sides), draw, draw.randint(0, 3)), changed(draw.choice(sides), draw, draw.randint(0, 3))
        # with and without ends of texts within reach of the passage
        near = draw.randint(20, 60) if cut else 120
        texts[k] = left[-near:] + passage + right[: draw.randint(30, 60) if cut else 120]
    got = substring_dedup.remove_repeats(docs(spark, list(texts.items()))).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got} == brute_repeats(texts)


def test_substrings_of_documents(spark, texts):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.op8_substring_dedup(spark, SMALL).collect()}
    assert got == {i: (*r[:3], hashlib.sha256(r[3]).hexdigest()) for i, r in brute_repeats(texts).items()}


def shingle_set(text):
    own = (text or "").encode().lower().split()
    return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def brute_components(rows, percent):
    sets = {i: shingle_set(t) for i, t in rows}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return smallest_reachable(sets, links)


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 7])
def test_near_copies_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    draw = random.Random(block)
    rows = []
    for i in range(160):
        own = words(i // 20, 150).split()
        for _ in range(draw.choice([0, 0, 1, 2, 3, 5])):
            own[draw.randrange(len(own))] = "other" + str(draw.randrange(1000))
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs(spark, rows), 85).collect()}
    wanted = brute_components(rows, 85)
    # a link is missed with a chance below 1 in 10,000; the draws are fixed
    assert got == wanted


def test_sketches_merge_and_estimate():
    draw = np.random.default_rng(2)
    values = draw.integers(0, 1 << 63, 3000, np.uint64)
    first, second = np.unique(values[:2000]), np.unique(values[500:])
    merged = near_dedup.merge(near_dedup.sketch(first), near_dedup.sketch(second))
    assert (merged == near_dedup.sketch(np.unique(values))).all()
    a, b = near_dedup.sketch(first), near_dedup.sketch(second)
    best, _ = near_dedup.joint_similarity(*(np.array([x], float) for x in ((a > b).sum(), (a < b).sum(), len(first), len(second))), 0.85)
    assert abs(best[0] - 0.5) < 0.2


def test_secrets_are_told_from_words_and_numbers(spark):
    draw = random.Random(12)
    key = lambda: "".join(draw.choice("0123456789abcdef") for _ in range(40))
    rows, planted = [], set()
    for i in range(300):
        text = words(i, 30)
        if i % 3 == 0:
            secret = key()
            planted.add((i, secret))
            text += f' token = "{secret}" ' + words(i + 1000, 5)
        if i % 3 == 1:
            text += " " + "".join(draw.choice("abcdefgh") for _ in range(20)) + f" {draw.randrange(10**15, 10**16)} " + words(i, 4)
        rows.append((i, text))
    found = secret_scan.scan(docs(spark, rows), path_col="source").collect()
    assert {(r.doc_id, r.candidate) for r in found if r.is_secret} == planted
    assert len(found) == 300
    pattern = re.compile(secret_scan._RUN % secret_scan.MIN_CHARS)
    assert sorted((r.doc_id, r.finding, r.candidate) for r in found) == sorted((i, k, m) for i, t in rows for k, m in enumerate(pattern.findall(t)))


def test_surroundings_of_secrets_are_those_of_the_whole_text(spark):
    key = "0123456789abcdef" * 2 + "c0ffee"
    long = "AWS_SECRET_ACCESS_KEY"
    texts = {
        0: f'{long} = "{key}"', 1: f"{long}={key}", 2: f'{long}="{key}" x', 3: f"{long}: {key}, x", 4: f'{{"{long}": "{key}"}}',
        5: 'password = "Tr0ub4dor&3!"', 6: "password=Tr0ub4dor&3!; x", 7: f"token: secret: a1 {key} {key} é🙂{key} {key}|{key}", 8: 'pwd="" pwd = x',
        9: 'secret = "correct horse 1" ' * 3, 10: words(1, 30),
    }
    found = secret_scan.candidates(docs(spark, list(texts.items()))).withColumn("label", secret_scan.rule_labels()).collect()
    run = re.compile(secret_scan._RUN % secret_scan.MIN_CHARS)
    values = {5: ["Tr0ub4dor&3!"], 6: ["Tr0ub4dor&3!"], 7: ["secret:", "a1"], 8: ["x"], 9: ["correct horse 1"] * 3}
    for i, text in texts.items():
        own = sorted((r.finding, r.candidate, r.before, r.after) for r in found if r.doc_id == i)
        places = [m.span() for m in run.finditer(text)]
        at = 0
        for value in values.get(i, []):
            at = text.index(value, at + 1)
            places.append((at, at + len(value)))
        assert own == [(k, text[a:b], text[max(0, a - 64) : a], text[b : b + 32]) for k, (a, b) in enumerate(places)]
    assert {r.doc_id for r in found if r.label == 1} == {0, 2, 4, 5, 9}
    named = dict(secret_scan.features([]))["named"]
    table = spark.createDataFrame(found).withColumn("path", F.lit("")).select("doc_id", "candidate", named.alias("named")).collect()
    assert all(r.named == 1 for r in table if r.candidate == key and r.doc_id < 5)


def test_pipeline_keeps_clean_documents_and_removes_the_rest(spark, tmp_path):
    item = words(500, 40)
    clean = [(i, words(i, 120)) for i in range(20)]
    near = words(3, 120).split()
    near[60] = "changed"
    rows = [*clean, (30, words(3, 120)), (31, " ".join(near)), (32, f"{words(600, 200)} {item} {words(601, 200)}"), (33, "123 456"), (34, item)]
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {*range(20), 32}
    assert sum(r.n_tokens for r in packed if r.doc_id == 32) == 401

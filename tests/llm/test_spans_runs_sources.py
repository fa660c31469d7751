"""Personal data, periodic runs and source divergence against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rows import DOC_SCHEMA, awkward_rows, docs, words
from tradesift.llm import periodic_runs, pii_anchors, source_divergence

# --- personal data -------------------------------------------------------------------------------------------------

PIECES = ["a", "B", "1", "2", "9", "12", "0", ".", "-", " ", "@", "+", "(", ")", "://", "iban", "IBAN ", "ssn ", "account ", "acct no. "]
PIECES += ["é", "%", "http", "4111 1111 1111 1111", "123-45-6789", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "user", "com", "255.1.1.1"]


def plain_spans(raw):
    spans = []
    for kind in pii_anchors.KINDS:
        for m in re.finditer(pii_anchors.PATTERNS[kind].encode(), raw):
            begin, end = m.span(m.re.groups)
            check = pii_anchors.CHECKS.get(kind)
            if check is None or check(raw[begin:end].decode()):
                spans.append((kind, begin, end))
    return spans


def test_anchored_spans_are_those_of_a_whole_scan():
    draw = random.Random(7)
    for _ in range(20_000):
        raw = "".join(draw.choice(PIECES) for _ in range(draw.randint(0, 25))).encode()
        assert pii_anchors.byte_spans(raw) == plain_spans(raw), raw


def test_every_kind_and_its_boundaries(spark):
    text = (
        "é Mail: Jo.Doe+x@mail.example.com. Host 10.0.255.3 but not 10.0.256.3; card 4111-1111 1111 1111, not 4111 1111 1111 1112; "
        "call +1 (017) 555-7713. IBAN: DE89 3704 0044 0532 0130 00, iban DE89370400440532013001 SSN 123-45-6789 ssn 666-45-6789 "
        "Account number: 12345-678 see ftp://bob:pw@files.example.org:21/x and noaccount 99999999"
    )
    row = pii_anchors.find_spans(docs(spark, [(1, text)])).first()
    assert [(s.kind, s.value) for s in row.spans] == [
        ("email", "Jo.Doe+x@mail.example.com"),
        ("email", "pw@files.example.org"),
        ("ip", "10.0.255.3"),
        ("card", "4111-1111 1111 1111"),
        ("phone", "+1 (017) 555-7713"),
        ("iban", "DE89 3704 0044 0532 0130 00"),
        ("ssn", "123-45-6789"),
        ("account", "12345-678"),
        ("login", "ftp://bob:pw@files.example.org:21"),
    ]
    assert all(text[s.start : s.end] == s.value for s in row.spans)


def test_masked_text(spark):
    found = pii_anchors.find_spans(docs(spark, [(1, "ü a@b.co, ssh://joe:x@h.org!"), (2, None), (3, "none")]))
    table = found.join(spark.createDataFrame([(1, "ü a@b.co, ssh://joe:x@h.org!"), (2, None), (3, "none")], "doc_id long, text string"), "doc_id")
    got = {r.doc_id: r.m for r in table.select("doc_id", pii_anchors.masked(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert got == {1: "ü <email>, <login>!", 2: None, 3: "none"}


def test_long_runs_of_cues_take_linear_time():
    raw = b"1" * 200_000 + b"@" * 200_000 + b"a" * 200_000 + b"1." * 100_000 + b"+1" * 100_000
    assert pii_anchors.byte_spans(raw) == [("ip", *s) for s in ip_spans(raw)]


def ip_spans(raw):
    spans = [m.span() for m in re.finditer(pii_anchors.PATTERNS["ip"].encode(), raw)]
    return [(a, b) for a, b in spans if all(int(p) < 256 for p in raw[a:b].split(b"."))]


def test_digest_columns(spark):
    row = pii_anchors.digest(pii_anchors.find_spans(docs(spark, [(1, "é a@b.co 1.2.3.4 ssn 123-45-6789"), (None, None)]))).collect()
    one = next(r for r in row if r.doc_id)
    base = "email:2:8,ip:9:16"
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 0, 0)
    assert one.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and one.spans == base + ",ssn:21:32"
    none = next(r for r in row if r.doc_id is None)
    assert none.spans == "" and none.base_sha256 == hashlib.sha256(b"").hexdigest()


# --- periodic runs -------------------------------------------------------------------------------------------------


def plain_runs(w):
    runs, n = set(), len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            smallest = not any(all(w[i + k] == w[i + k + p] for k in range(size - p)) for p in range(1, q))
            if size >= max(6, 4 * q) and smallest:
                runs.add((i, size, q))
            i = j + 1
    return sorted(runs, key=lambda r: (r[0], r[2]))


def plain_collapse(w):
    runs = plain_runs(w)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    return runs, " ".join(x for k, x in enumerate(w) if k not in gone)


def random_words(draw):
    w = []
    for _ in range(draw.randint(0, 5)):
        base = [f"w{draw.randint(0, draw.choice([1, 2, 6]))}" for _ in range(draw.randint(1, 11))]
        w += base * draw.randint(1, 7) + base[: draw.randint(0, len(base))]
    return w


def test_runs_are_those_of_brute_force():
    draw = random.Random(11)
    for _ in range(1_500):
        texts = [random_words(draw) for _ in range(draw.randint(1, 5))]
        got = list(periodic_runs._collapse([" ".join(t).encode() for t in texts]))
        for w, (runs, kept) in zip(texts, got, strict=True):
            assert ([(r["start"], r["length"], r["period"]) for r in runs], kept.decode()) == plain_collapse(w)


def test_portions_change_nothing(spark, monkeypatch):
    draw = random.Random(12)
    table = docs(spark, [(k, "\t".join(random_words(draw))) for k in range(60)])
    whole = sorted(periodic_runs.find_runs(table).collect())
    monkeypatch.setattr(periodic_runs, "WORDS_AT_ONCE", 5)
    assert sorted(periodic_runs.find_runs(table).collect()) == whole and any(r.runs for r in whole)


def test_one_long_period_in_a_long_text():
    w = [f"x{k % 5000}" for k in range(20_300)]
    (runs, kept) = next(periodic_runs._collapse([" ".join(w).encode()]))
    assert [(r["start"], r["length"], r["period"]) for r in runs] == [(0, 20_300, 5000)] and kept.count(b" ") == 4999


def test_query_rows(spark, tmp_path):
    rows = [(k, words(k % 9, k % 50 + (300 if k % 7 == 0 else 0))) for k in range(300)] + [(None, "a a a a a a b"), (301, None), (302, " \n ")]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()}
    planted = 0
    for doc_id, text in rows:
        w = (text or "").split()
        h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
        if h is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs, kept = plain_collapse(w)
        top = min(((-size, s, q) for s, size, q in runs), default=None)
        r = got[doc_id]
        want = (len(runs), None, None, None, None) if top is None else (len(runs), top[1], -top[0], top[2], -1000 * top[0] // top[2])
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == want
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert planted > 10 and any(r.n_runs for r in got.values())


# --- source divergence ---------------------------------------------------------------------------------------------


def plain_divergence(rows, min_docs, top):
    """rows: (lang, source, text); the definition, with every kept term and every pair."""
    uses, in_docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        uses[lang, source].update(found)
        in_docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in in_docs[lang].items() if n >= min_docs]

        def shares(counts, kept=kept):
            whole = sum(counts[t] for t in kept) + 2 * len(kept)
            return [1 + 10**9 * (counts[t] + 2) // whole for t in kept]

        of_lang = shares(sum((uses[lang, s] for s in sources), Counter()))
        of = {s: shares(uses[lang, s]) for s in sources}
        apart = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(-sum(map(apart, of[s], of[o])), o.encode()) for o in sources if o != s]
            terms = [(-apart(p, q), t.encode()) for p, q, t in zip(of[s], of_lang, kept, strict=True) if uses[lang, s][t] and p > q]
            for part, listed in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(listed, 1)}
    return out


def divergence_rows(spark, rows, **options):
    table = spark.createDataFrame([(k, *r, 1, "t") for k, r in enumerate(rows)], "doc_id long, lang string, source string, text string, n long, term string")
    got = source_divergence.divergence(table, **options).collect()
    assert len({tuple(r[:4]) for r in got}) == len(got)
    return {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got}


def random_rows(seed, n):
    draw = random.Random(seed)
    vocabulary = ["Äpfel", "äpfel", "und", "UND", "x-ray", "été", "日本", "zebra", *("abcdefghijklmnop")]
    rows = []
    for _ in range(n):
        lang = draw.choice(["en", "de", None, ""])
        source = "hot" if draw.random() < 0.4 else draw.choice(["s1", "s2", "s10", None, "ß"])
        some = draw.sample(vocabulary, draw.randint(1, len(vocabulary)))
        rows.append((lang, source, " ".join(draw.choice(some) for _ in range(draw.randint(0, 60)))))
    return [*rows, ("xx", "only", "lone words"), ("yy", "a", "few"), ("yy", "b", None), ("en", "silent", "123 !"), rows[0], rows[0]]


@pytest.mark.parametrize("block, cells, entries", [(1_000_000, 500_000, 250_000), (7, 3, 20)])
def test_divergence_is_that_of_the_definition(spark, monkeypatch, block, cells, entries):
    monkeypatch.setattr(source_divergence, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(source_divergence, "CELLS", cells)
    monkeypatch.setattr(source_divergence, "ENTRIES", entries)
    rows = random_rows(5, 250)
    assert divergence_rows(spark, rows, min_docs=6, top_terms=4) == plain_divergence(rows, 6, 4)


def test_divergence_of_awkward_tables(spark):
    rows = [(r[2], "src", r[1]) for r in awkward_rows()] + [(r[2], None, r[1]) for r in awkward_rows()]
    assert divergence_rows(spark, rows, min_docs=2) == plain_divergence(rows, 2, 10)
    assert source_divergence.divergence(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


def test_exact_shares():
    for whole in (1, 7, 10**9 + 7, 8 * 10**17):
        counts = np.array([0, 1, whole // 3, max(0, whole - 2)])
        assert source_divergence.shares(counts, whole).tolist() == [1 + 10**9 * (int(c) + 2) // whole for c in counts]


# --- awkward rows --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("operator", [pii_anchors.find_spans, periodic_runs.find_runs])
def test_one_row_for_each_row(spark, operator):
    got = operator(docs(spark, awkward_rows())).collect()
    key = lambda i: (i is None, i)
    assert sorted((r.doc_id for r in got), key=key) == sorted((r[0] for r in awkward_rows()), key=key)
    assert operator(spark.createDataFrame([], DOC_SCHEMA)).collect() == []


def test_arrow_slices_of_the_block():
    index = pa.table({"term": ["a", "b"], "total": [3, 2], "postings": [[{"source": "x", "n": 1}, {"source": "y", "n": 2}], [{"source": "y", "n": 2}]]})
    groups = pa.table({"source": ["y", "x"], "whole": [8, 5], "lang_whole": [9, 9]})
    one = source_divergence._Block(index, groups)
    assert one.sources == ["x", "y"] and one.row(0)[1] == one.row(1)[0]

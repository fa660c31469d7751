"""Personal data found by anchors: Aho-Corasick reports cues, local parsers expand each cue to its boundaries.

One automaton runs over the bytes of a text in which every digit is ``0`` and A-Z are lower-case, so that cues such as
"a plus before a digit" or "digits around a dot" are plain words of it. A cue names a kind; the kind's parser looks for
the start of the value before the cue (never before the end of the last value of that kind) and reads the value from
there; checks (parts of an address, check digits, counts of digits) drop it or keep it. Every byte is read a bounded
number of times, so a text takes time in proportion to its length.

Kinds, in the order of the output: ``email`` (at-sign), ``ip`` (dot between digits), ``card`` (two digits at most one
blank or hyphen apart, check digit by Luhn), ``phone`` (plus before a digit), ``iban``, ``ssn`` and ``account`` (a value
named by such a word; check digits of the first, excluded ranges of the second), ``login`` (a scheme with ``://`` and a
user before the host).

Defined results: a null or empty text has no spans; places are code points, the end is exclusive; values of different
kinds may overlap, values of one kind never do; repeated rows are handled one by one; a null id stays null; columns other
than the named ones are never read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.llm.common import read_table, text_bytes

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "account", "login")
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"

#: The patterns of the values, as read from their start. Named and scheme values are the last group.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[Ii][Bb][Aa][Nn]\b[\x20:#=.]{0,3}([A-Z]{2}[0-9]{2}(?:(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30}))\b",
    "ssn": r"\b[Ss][Ss][Nn]\b[\x20:#=.]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})\b",
    "account": (
        r"\b[Aa][Cc][Cc](?:[Oo][Uu][Nn][Tt]|[Tt])\b\.?(?:\x20(?:[Nn][Uu][Mm][Bb][Ee][Rr]|[Nn][OoRr]\.?))?"
        r"[\x20:#=]{0,3}([0-9](?:[\x20-]?[0-9]){5,16})\b"
    ),
    "login": r"[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9._~%!$&'()*+,;=:-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?",
}
#: Cues in the reduced text, and how many bytes after the cue's start its expansion begins.
CUES = {
    "@": ("email", 0),
    "0.0": ("ip", 1),
    "00": ("card", 0),
    "0 0": ("card", 0),
    "0-0": ("card", 0),
    "+0": ("phone", 0),
    "iban": ("iban", 0),
    "ssn": ("ssn", 0),
    "account": ("account", 0),
    "acct": ("account", 0),
    "://": ("login", 0),
}
#: Bytes before the cue that belong to the value.
BEFORE = {
    "email": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-",
    "ip": b"0123456789",
    "login": b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-",
}
_LETTERS = BEFORE["email"][:52]
_REDUCED = bytes(0x30 if 0x30 <= b <= 0x39 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_COMPILED = {kind: re.compile(pattern.encode()) for kind, pattern in PATTERNS.items()}


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _digits(value: str) -> str:
    return "".join(c for c in value if c.isdigit())


def _iban(value: str) -> bool:
    plain = value.replace(" ", "")
    return len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


#: What a value of a kind must fulfil; a failing one is dropped and not read again in another way.
CHECKS: dict[str, Callable[[str], bool]] = {
    "ip": lambda v: all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in v.split(".")),
    "card": lambda v: 13 <= len(d := _digits(v)) <= 19 and luhn(d),
    "phone": lambda v: 9 <= len(_digits(v)) <= 15,
    "iban": _iban,
    "ssn": lambda v: v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000",
}


@lru_cache(maxsize=1)
def _automaton():
    """The automaton of all cues, one for each Python worker."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for cue, (kind, shift) in CUES.items():
        automaton.add_word(cue, (kind, len(cue) - 1 - shift))
    automaton.make_automaton()
    return automaton


def byte_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by kind as listed and start."""
    found: dict[str, list[tuple[int, int]]] = {}
    free = dict.fromkeys(KINDS, 0)  # where the next value of a kind may start
    seen = dict.fromkeys(KINDS, 0)  # the place after the last cue of a kind: nothing before it need be looked at again
    for last, (kind, back) in _automaton().iter(raw.translate(_REDUCED).decode("latin-1")):
        start = cue = last - back
        if cue < free[kind]:
            continue
        if kind in BEFORE:
            low = max(free[kind], seen[kind])
            part = raw[low:cue]
            start = low + len(part.rstrip(BEFORE[kind]))
            if kind == "login":
                start = cue - len(raw[start:cue].lstrip(b"0123456789+.-"))
            seen[kind] = cue + 1
            if start == cue:
                continue
        match = _COMPILED[kind].match(raw, start)
        if match:
            free[kind] = match.end()
            begin, end = match.span(match.re.groups)
            check = CHECKS.get(kind)
            if check is None or check(raw[begin:end].decode("ascii")):
                found.setdefault(kind, []).append((begin, end))
    return [(kind, *span) for kind in KINDS for span in found.get(kind, ())]


def _in_code_points(raw: bytes, spans: list[tuple[str, int, int]]) -> list[dict]:
    """The spans with places counted in code points; the text before each place is decoded once."""
    place, at, points = {}, 0, 0
    for cut in sorted({p for _, *span in spans for p in span}):
        points += len(raw[at:cut].decode("utf-8", "replace"))
        place[cut], at = points, cut
    return [{"kind": k, "start": place[b], "end": place[e], "value": raw[b:e].decode("utf-8", "replace")} for k, b, e in spans]


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): kind, start, end and value of every piece of personal data, one row for each row of ``docs``."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for raw in text_bytes(batch, "text"):
                hits = byte_spans(raw) if raw else []
                spans.append(_in_code_points(raw, hits) if hits else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return narrow.mapInArrow(search, f"doc_id {dict(narrow.dtypes)['doc_id']}, spans {SPANS}")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first to start counts."""
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        more = F.struct(F.concat(acc["done"], gap, F.lit("<"), s["kind"], F.lit(">")).alias("done"), s["end"].alias("at"))
        return F.when(s["start"] >= acc["at"], more).otherwise(acc)

    rest = lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    return F.when(text.isNotNull(), F.aggregate(ordered, begin, step, rest))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of the output of ``find_spans``."""
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def op11_pii_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return digest(find_spans(read_table(spark, folder, "documents")))


#: Conditions on a value ``v`` in SQL, as in CHECKS.
_DIGITS_SQL = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN_SQL = (
    f"list_sum(list_transform(string_split(reverse({_DIGITS_SQL}), ''), lambda c, k: CASE WHEN k % 2 = 1 THEN c::INT "
    "WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0"
)
_IBAN_SQL = (
    "length(replace(v, ' ', '')) <= 34 AND list_reduce(list_transform(string_split(substr(replace(v, ' ', ''), 5) || substr(v, 1, 4), ''), "
    "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::BIGINT ELSE (ascii(c) - 55)::BIGINT END), "
    "lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97) = 1"
)
_CHECKS_SQL = {
    "ip": "list_aggregate(list_transform(string_split(v, '.'), lambda p: p::HUGEINT), 'max') <= 255",
    "card": f"length({_DIGITS_SQL}) BETWEEN 13 AND 19 AND {_LUHN_SQL}",
    "phone": f"length({_DIGITS_SQL}) BETWEEN 9 AND 15",
    "iban": _IBAN_SQL,
    "ssn": "v[1:3] NOT IN ('000', '666') AND v[1] <> '9' AND v[5:6] <> '00' AND v[8:11] <> '0000'",
}


def _kind_sql(number: int, kind: str) -> str:
    pattern, group = PATTERNS[kind].replace("'", "''"), int(kind in ("iban", "ssn", "account"))
    return f"""SELECT rid, {number} AS nr, '{kind}' AS kind, v, e - length(v) AS s, e FROM (
  SELECT rid, unnest(vals) AS v, unnest(list_transform(whole, lambda w, k:
    list_sum(list_transform(gaps[1:k], lambda g: length(g))) + list_sum(list_transform(whole[1:k], lambda g: length(g))))) AS e
  FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS whole, regexp_extract_all(t, '{pattern}', {group}) AS vals,
    regexp_split_to_array(t, '{pattern}') AS gaps FROM d)
  WHERE len(whole) > 0) WHERE {_CHECKS_SQL.get(kind, "true")}"""


OP11_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
f AS MATERIALIZED ({" UNION ALL ".join(_kind_sql(k, kind) for k, kind in enumerate(KINDS))}),
s AS (SELECT rid, {", ".join(f"count(*) FILTER (nr = {k}) AS n_{kind}" for k, kind in enumerate(BASE_KINDS))},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY nr, s) FILTER (nr < 4) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY nr, s) AS spans FROM f GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in BASE_KINDS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (rid)"""

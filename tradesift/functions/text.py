"""Text forms used for display, comparison, lookup and identity.

Only text with non-ASCII characters goes to Python (one Arrow batch call); everything else stays
in the JVM. The UDF input is null (an empty list for many texts) for ASCII rows, so no such text is serialized.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# The whitespace class of the source's regular expressions, written out because
# Java's \s covers ASCII only.
WHITESPACE_CLASS = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
DISPLAY_WHITESPACE = rf"[{WHITESPACE_CLASS}\x{{200B}}]+"
PLAIN_WHITESPACE = rf"[{WHITESPACE_CLASS}]+"
ZERO_WIDTH = r"[\x{200C}\x{200D}\x{2060}]"
ACCENTS = r"[\x{0300}-\x{036F}]"
EDGE_PUNCTUATION_CLASS = r"""[\s,.;:!?()\[\]{}"'“”‘’«»|]"""
WORD = r"[\p{L}\p{N}]+"
# ASCII whitespace other than the space, and the cheaper whitespace class of ASCII text
ASCII_CONTROLS = "\t\n\x0b\f\r"
ASCII_WHITESPACE = r"[ \t-\r]+"


@F.arrow_udf(StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    return pc.utf8_normalize(values, form="NFKC")


def _without_accents(values: pa.Array) -> pa.Array:
    decomposed = pc.utf8_normalize(pc.utf8_normalize(values, form="NFKC"), form="NFD")
    return pc.replace_substring_regex(decomposed, ACCENTS, "")


@F.arrow_udf(StringType())
def _nfkc_without_accents(values: pa.Array) -> pa.Array:
    return _without_accents(values)


def _each_item(lists: pa.Array, form: Callable[[pa.Array], pa.Array]) -> pa.Array:
    return pa.Array.from_buffers(lists.type, len(lists), lists.buffers()[:2], offset=lists.offset, children=[form(lists.values)])


@F.arrow_udf(ArrayType(StringType()))
def _nfkc_items(lists: pa.Array) -> pa.Array:
    return _each_item(lists, lambda values: pc.utf8_normalize(values, form="NFKC"))


@F.arrow_udf(ArrayType(StringType()))
def _nfkc_items_without_accents(lists: pa.Array) -> pa.Array:
    return _each_item(lists, _without_accents)


def unclean_items(separator: str) -> str:
    """What an ASCII list in one text has where an item is empty or not single-spaced and trimmed."""
    edge = f"[ {separator}]"
    return f"^{edge}|{edge}{edge}|{edge}$|[\\t-\\r]"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _only_non_ascii(text: Column) -> Column:
    return F.when(~is_ascii(text), text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty_to_null(text: Column) -> Column:
    # not nullif: it repeats its argument, and nested calls would double the work per level
    return F.get(F.filter(F.array(text), lambda value: value != ""), F.lit(0))


def nfkc(text: Column) -> Column:
    return F.coalesce(_nfkc(_only_non_ascii(text)), text)


def nfkc_without_accents(text: Column) -> Column:
    return F.coalesce(_nfkc_without_accents(_only_non_ascii(text)), text)


def _together(texts: dict[str, Column], items: Callable[[Column], Column]) -> dict[str, Column]:
    foreign = F.lit(False)
    for text in texts.values():
        foreign = foreign | F.coalesce(~is_ascii(text), F.lit(False))
    # not null: Spark takes the size of a batch after every row, and Arrow then fills all null lists at its end again
    formed = items(F.when(foreign, F.array(*texts.values())).otherwise(no_items()))
    return {out: F.coalesce(F.get(formed, F.lit(place)), text) for place, (out, text) in enumerate(texts.items())}


def nfkc_together(texts: dict[str, Column]) -> dict[str, Column]:
    """``nfkc`` of many texts: they go to Python as one list, empty where all of them are ASCII."""
    return _together(texts, _nfkc_items)


def nfkc_without_accents_together(texts: dict[str, Column]) -> dict[str, Column]:
    return _together(texts, _nfkc_items_without_accents)


def _unclean_ascii(value: Column) -> Column:
    """Whether ASCII text is not single-spaced and trimmed, without a pattern: nearly all text is and gets no further."""
    unclean = value.startswith(" ") | value.endswith(" ") | value.contains("  ")
    for control in ASCII_CONTROLS:
        unclean = unclean | value.contains(control)
    return unclean


def _cleaned(value: Column, every_case: Callable[[Column], Column]) -> Column:
    """Most text is clean ASCII and passes through; the wide classes run only where needed."""
    return (
        F.when(~is_ascii(value), F.trim(every_case(value)))
        .when(_unclean_ascii(value), F.trim(F.regexp_replace(value, ASCII_WHITESPACE, " ")))
        .otherwise(value)
    )


def _collapsed(value: Column) -> Column:
    return _cleaned(value, lambda v: F.regexp_replace(v, PLAIN_WHITESPACE, " "))


def _display(value: Column) -> Column:
    return _cleaned(
        value,
        lambda v: F.regexp_replace(F.regexp_replace(v, ZERO_WIDTH, ""), DISPLAY_WHITESPACE, " "),
    )


def collapse_spaces(text: Column) -> Column:
    """Single-spaced and trimmed, empty becomes null; no Unicode normalization."""
    return empty_to_null(let(text, _collapsed))


def add_collapsed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``collapse_spaces`` for many columns, as two compiled projections instead of lambdas."""
    rows = rows.withColumns({out: _collapsed(F.col(source)) for out, source in columns.items()})
    return rows.withColumns({out: F.when(F.col(out) != "", F.col(out)) for out in columns})


def no_items() -> Column:
    return F.array().cast("array<string>")


def clean_display(normalized: Column) -> Column:
    return empty_to_null(let(normalized, _display))


def add_clean_display(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``clean_display`` for many columns, as two compiled projections instead of lambdas."""
    rows = rows.withColumns({out: _display(F.col(source)) for out, source in columns.items()})
    return rows.withColumns({out: F.when(F.col(out) != "", F.col(out)) for out in columns})


def display_text(text: Column) -> Column:
    """Cleaned text with case and punctuation kept, or null."""
    return clean_display(nfkc(text))


def comparison_text(text: Column) -> Column:
    return F.lower(display_text(text))


def identity_text(text: Column) -> Column:
    """Form used for identity only: zero-width characters stay in it."""
    return F.lower(collapse_spaces(nfkc(text)))


def tokens_of_comparison(text: Column) -> Column:
    edges = rf"^{EDGE_PUNCTUATION_CLASS}+|{EDGE_PUNCTUATION_CLASS}+$"
    tokens = F.transform(
        F.split(F.coalesce(text, F.lit("")), " "),
        lambda token: F.regexp_replace(token, edges, ""),
    )
    return F.array_distinct(F.filter(tokens, lambda token: token != ""))


def edge_trimmed_tokens(text: Column) -> Column:
    """Distinct space-separated tokens in order, punctuation trimmed from their edges."""
    return tokens_of_comparison(comparison_text(text))


def words_of_comparison(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def words_of_clean(text: Column) -> Column:
    """As ``words`` for text that already is in display or comparison form."""
    return words_of_comparison(F.lower(text))


def words(text: Column) -> Column:
    """Runs of letters and digits of the comparison form."""
    return words_of_comparison(comparison_text(text))


def _alias_key(cleaned: Column) -> Column:
    spelled = F.replace(F.lower(cleaned), F.lit("."), F.lit(""))
    spaced = F.regexp_replace(F.replace(spelled, F.lit("&"), F.lit(" and ")), "[ _-]+", " ")
    return F.regexp_replace(F.trim(spaced), "^the ", "")


def alias_key_of_plain(plain: Column) -> Column:
    """Lookup key of text that has no accents any more."""
    return empty_to_null(_alias_key(clean_display(plain)))


def add_alias_keys(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Lookup keys of clean text without accents."""
    rows = rows.withColumns({out: _alias_key(source) for out, source in columns.items()})
    return rows.withColumns({out: F.when(F.col(out) != "", F.col(out)) for out in columns})


def alias_key(text: Column) -> Column:
    """Lookup key: no accents, dots or leading "the"; "&" spelled out; separators unified."""
    return alias_key_of_plain(nfkc_without_accents(text))


def split_list(text: Column) -> Column:
    """Comma list to cleaned, non-empty items in order; null text gives an empty list.

    ASCII text is cleaned as a whole before it is split, so that no item of it meets a lambda.
    """
    spaced = F.regexp_replace(F.regexp_replace(text, ASCII_WHITESPACE, " "), "(?: ?, ?)+", ",")
    plain = F.regexp_replace(spaced, "^[ ,]+|[ ,]+$", "")
    items = F.transform(F.split(text, ","), collapse_spaces)
    return (
        F.when(text.isNull(), no_items())
        .when(~is_ascii(text), F.filter(items, lambda item: item.isNotNull()))
        .when(plain == "", no_items())
        .otherwise(F.split(plain, ","))
    )


def truncate(text: Column, limit: int = 70) -> Column:
    return F.when(
        F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 1)), F.lit("…"))
    ).otherwise(text)


def half_up(number: Column) -> Column:
    return F.floor(number + F.lit(0.5))


def number_text(number: Column) -> Column:
    """Number as text: whole values without a fraction."""
    whole = (number == F.floor(number)) & (F.abs(number) < F.lit(1e15))
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def short_number_text(number: Column) -> Column:
    """Whole values without a fraction, others with one decimal."""
    whole = (number == F.floor(number)) & (F.abs(number) < F.lit(1e15))
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(
        F.format_string("%.1f", number)
    )


# --- driver-side forms, for the few dozen terms of a profile or a lookup table ---

_SPACES = re.compile(rf"[\s{chr(0x200B)}{chr(0xFEFF)}]+")
_ZERO_WIDTH = re.compile(f"[{chr(0x200C)}{chr(0x200D)}{chr(0x2060)}]")


def comparison_text_of(term: str) -> str:
    visible = _ZERO_WIDTH.sub("", unicodedata.normalize("NFKC", term))
    return _SPACES.sub(" ", visible).strip().lower()


def words_of(term: str) -> list[str]:
    return regex.findall(WORD, comparison_text_of(term))


def alias_key_of(term: str) -> str | None:
    plain = unicodedata.normalize("NFD", comparison_text_of(term))
    plain = "".join(c for c in plain if not 0x300 <= ord(c) <= 0x36F)
    spelled = plain.replace(".", "").replace("&", " and ")
    key = re.sub(r"[\s_-]+", " ", spelled).strip()
    return key.removeprefix("the ") or None

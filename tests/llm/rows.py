"""Small tables for the tests of the corpus operators."""

from __future__ import annotations

import random

DOC_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "key long, block string, line_no int, weight string, score double, n_words string, label string, cluster string"
)


def words(seed: int, n: int, letters: str = "abcdefghij") -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 8))) for _ in range(n))


def docs(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang); the other columns have names that operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or ""), 1, "x", 3, "w", 0.5, "n", "l", "c") for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def awkward_rows():
    """Nulls, empty and blank texts, ties, repeated rows, one very long text and one very long word."""
    long_text = words(1, 30_000)
    return [
        (1, words(2, 60), "en"),
        (1, words(2, 60), "en"),
        (2, words(2, 60), "de"),
        (3, None, "en"),
        (4, "", None),
        (5, " \n\t\r\n ", "en"),
        (6, "12345 67890 !!! ***", "de"),
        (7, long_text, "en"),
        (8, long_text + " end", None),
        (9, "a" * 5000, "de"),
        (10, "é ü 日本語 🙂", "fr"),
        (None, words(3, 50), "en"),
        (None, None, None),
        (11, "\n".join([words(4, 12)] * 4), "en"),
    ]

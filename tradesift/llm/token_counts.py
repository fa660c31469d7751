"""Exact token counts at every prefix of a text, by dynamic programming over byte-pair tokens.

Within one piece of the pre-tokenizer the encoding of a prefix is the encoding of a shorter prefix plus one
last token, and a token may follow another exactly when the pair encodes to itself. So one pass over the
piece, trying the tokens that end at each place, stores the last token and the count of every prefix.
Truncation and budget questions read those counts; nothing is encoded again.

Defined results: a null text is empty (0 bytes, 0 tokens); repeated rows are counted one by one; columns
other than the named ones are never read. Special tokens that occur in a text count as one token, as the
library does by default; no text is cut or padded.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.llm.common import read_table

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
#: Entries of the caches of one Python worker; a full cache starts anew, which changes no result.
CACHE_ENTRIES = 1_500_000

#: The pre-tokenizer always starts a piece at a space that is followed by a character other than white space.
_UNIT_START = re.compile(r" (?=\S)")
_LOOSE_SPACE = re.compile(r" (?:\s|\Z)")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class PrefixCounter:
    """Token counts of prefixes under one byte-pair tokenizer file."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self._pieces = library.pre_tokenizer.pre_tokenize_str
        self._model = library.model
        special = [t.content for t in library.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._endings = ahocorasick.Automaton()
        self._bytes: dict[int, str] = {}
        for token, number in library.get_vocab(with_added_tokens=False).items():
            if token not in special:
                self._endings.add_word(token, (number, len(token)))
                self._bytes[number] = token
        self._endings.make_automaton()
        self._follows: dict[int, bool] = {}
        self._whole: dict[str, int] = {}
        self._units: dict[str, int] = {}

    def _may_follow(self, first: int, second: int) -> bool:
        key = first << 32 | second
        known = self._follows.get(key)
        if known is None:
            found = self._model.tokenize(self._bytes[first] + self._bytes[second])
            known = len(found) == 2 and found[0].id == first and found[1].id == second
            if len(self._follows) >= CACHE_ENTRIES:
                self._follows.clear()
            self._follows[key] = known
        return known

    def piece_prefixes(self, piece: str) -> list[int]:
        """Counts of the prefixes of a piece, given as one character per byte; place 0 is the empty prefix."""
        n = len(piece)
        last = [-1] * (n + 1)
        counts = [0] * (n + 1)
        follows, may = self._follows, self._may_follow
        for end, (token, size) in self._endings.iter(piece):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if start:
                before = last[start]
                known = follows.get(before << 32 | token)
                if not (may(before, token) if known is None else known):
                    continue
            elif size > 1 and not self._is_token(piece[:end]):
                continue
            last[end] = token
            counts[end] = counts[start] + 1
        return counts

    def _is_token(self, token: str) -> bool:
        known = self._whole.get(token)
        if known is None:
            known = len(self._model.tokenize(token)) == 1
            if len(self._whole) >= CACHE_ENTRIES:
                self._whole.clear()
            self._whole[token] = known
        return bool(known)

    def _count_unit(self, unit: str) -> int:
        return sum(self.piece_prefixes(piece)[-1] for piece, _ in self._pieces(unit))

    def _parts(self, text: str) -> list[tuple[str, bool]]:
        """The text between special tokens, and the special tokens."""
        if not self._special or not self._special.search(text):
            return [(text, False)]
        parts, at = [], 0
        for m in self._special.finditer(text):
            parts += [(text[at : m.start()], False), (m[0], True)]
            at = m.end()
        return [*parts, (text[at:], False)]

    def _unit_counts(self, text: str) -> tuple[list[str], list[int]]:
        """Units that the pre-tokenizer never joins (the space before each left out), and their counts."""
        units = _UNIT_START.split(text) if _LOOSE_SPACE.search(text) else text.split(" ")
        counts = list(map(self._units.get, units))
        counts[0] = self._count_unit(units[0])
        if None in counts:
            if len(self._units) >= CACHE_ENTRIES:
                self._units.clear()
            for k, count in enumerate(counts):
                if count is None:
                    counts[k] = self._units[units[k]] = self._count_unit(" " + units[k])
        return units, counts

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(1 if special else sum(self._unit_counts(part)[1]) for part, special in self._parts(text) if part)

    def prefix_counts(self, text: str) -> list[int]:
        """Count of text[:k] for every k from 0 to the length of the text."""
        return [0, *(self.count_at(text, k) for k in range(1, len(text) + 1))]

    def count_at(self, text: str, length: int) -> int:
        """Tokens of text[:length]: whole units before the cut, and the stored prefix of the unit that is cut."""
        return self.count(text[:length])

    def longest_prefix(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix that has at most ``budget`` tokens."""
        best = at = used = 0
        parts = self._parts(text or "")
        # a special token cut short is ordinary text and may join what stands before it
        cut_short = lambda at, part: [at + k for k in range(1, len(part)) if self.count(text[: at + k]) <= budget]
        for number, (part, special) in enumerate(parts):
            if special:
                if used >= budget:
                    return max([best, *cut_short(at, part)])
                used, at = used + 1, at + len(part)
                best = at
                continue
            if not part:
                continue
            units, counts = self._unit_counts(part)
            totals = list(accumulate(counts))
            k = bisect_right(totals, budget - used)
            start = at + sum(map(len, units[:k])) + max(0, k - 1)
            if k == len(units):
                used, at = used + totals[-1], at + len(part)
                best = at
                continue
            before = used + (totals[k - 1] if k else 0)
            unit = (" " if k else "") + units[k]
            fits = [start + n for n in self._prefix_within(unit, budget - before)]
            if k == len(units) - 1 and number + 1 < len(parts):
                fits += cut_short(at + len(part), parts[number + 1][0])
            return max([best, start, *fits])
        return best

    def _prefix_within(self, unit: str, budget: int) -> list[int]:
        """Lengths of the unit's prefixes that have at most so many tokens, from the stored prefix counts."""
        fits, done = [], 0
        pieces = self._pieces(unit)
        for number, (piece, (start, end)) in enumerate(pieces):
            counts = self.piece_prefixes(piece)
            if unit[start:end].isspace() or number and unit[pieces[number - 1][1][0] : start].isspace():
                # a cut after white space can join it to the white space before: count those few anew
                fits += [k for k in range(start + 1, end + 1) if self._count_unit(unit[:k]) <= budget]
            else:
                bytes_so_far = 0
                for k in range(start, end):
                    bytes_so_far += len(unit[k].encode())
                    if done + counts[bytes_so_far] <= budget and not self._resplits(unit[start : k + 1]):
                        fits.append(k + 1)
                    elif self._resplits(unit[start : k + 1]) and self._count_unit(unit[: k + 1]) <= budget:
                        fits.append(k + 1)
            done += counts[-1]
        return fits

    def _resplits(self, start_of_piece: str) -> bool:
        return "'" in start_of_piece and len(self._pieces(start_of_piece)) > 1


@lru_cache(maxsize=1)
def _counter(path: str) -> PrefixCounter:
    """One counter for all tasks of a Python worker."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars): exact counts, and the characters of the longest prefix within the limit."""
    path = tokenizer or default_tokenizer()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = [counter.count(t) for t in texts]
            fits = [len(t or "") if n <= limit else counter.longest_prefix(t, limit) for t, n in zip(texts, counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                    pa.array(fits, pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(read_table(spark, folder, "documents"))

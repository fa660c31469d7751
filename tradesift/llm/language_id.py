"""Language identification with a small byte convolutional network.

Bytes (A-Z as a-z) are embedded, filters of several widths run over windows of fixed length, each filter keeps its
largest response in the window, and a softmax layer scores the languages. A text is cut into windows from
its first to its last byte; the mean log probability over all of them, weighted by their bytes, decides.

The network is trained in numpy on labelled text, on a bounded sample: at most about ``docs_per_lang`` documents of
each language, chosen by a hash of their id, and ``windows_per_doc`` windows spread over each whole text.

Defined results: null texts and texts without a letter are ``und`` with score 0; without labelled text every
row is ``und``. Rows with a null id or language are predicted, not learned from. Repeated rows are predicted one
by one. Equal scores go to the language that sorts first. Other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.llm.common import ASCII_LOWER, crc_of_id, read_table, text_bytes

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS_PER_WIDTH = 8
EMBEDDING = 8
DOCS_PER_LANG = 400
WINDOWS_PER_DOC = 4
MAX_LANGS = 1000
EPOCHS = 30
UNKNOWN = "und"
#: A document whose best language gets less than this is rejected by ``keep_identified``.
MIN_SCORE = 0.4

#: Windows that go through the network at once; the activations of a block stay in the processor's cache.
_BLOCK = 96
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


@dataclass
class ByteNet:
    langs: list[str]
    embed: np.ndarray  # (256, embedding)
    filters: np.ndarray  # (widest * embedding, filters); narrow filters have zeros beyond their width
    bias: np.ndarray
    out: np.ndarray  # (filters, langs)
    out_bias: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """Embedded bytes of every place and the places after it: (windows, places, widest * embedding)."""
        widest = max(WIDTHS)
        places = windows.shape[1] - widest + 1
        inside = np.lib.stride_tricks.sliding_window_view(self.embed[windows].reshape(len(windows), -1), widest * EMBEDDING, axis=1)
        return inside[:, ::EMBEDDING][:, :places]

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        rows = []
        for at in range(0, len(windows), _BLOCK):
            block = self.columns(windows[at : at + _BLOCK])
            flat = np.ascontiguousarray(block).reshape(-1, block.shape[-1])
            pooled = (flat @ self.filters).reshape(block.shape[0], block.shape[1], -1).max(axis=1)
            rows.append(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias)
        logits = np.concatenate(rows)
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def cut_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of whole texts (the last one of each padded with zeros), their numbers of bytes and of their texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = -(-sizes // WINDOW)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])) * WINDOW if len(texts) else sizes
    buffer = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    for text, start in zip(texts, starts.tolist(), strict=True):
        buffer[start : start + len(text)] = np.frombuffer(text.translate(ASCII_LOWER), np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(owner)) - starts[owner] // WINDOW
    return buffer.reshape(-1, WINDOW), np.minimum(sizes[owner] - place * WINDOW, WINDOW), owner


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> ByteNet:
    """Adam on the cross-entropy; a filter's gradient flows through its largest place in each window."""
    draw = np.random.default_rng(seed)
    widest, n_filters = max(WIDTHS), FILTERS_PER_WIDTH * len(WIDTHS)
    mask = np.zeros((widest * EMBEDDING, n_filters), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * EMBEDDING, k * FILTERS_PER_WIDTH : (k + 1) * FILTERS_PER_WIDTH] = 1
    normal = lambda *shape, scale: draw.normal(0, scale, shape).astype(np.float32)
    net = ByteNet(
        langs, normal(256, EMBEDDING, scale=0.5), normal(*mask.shape, scale=0.3) * mask, np.zeros(n_filters, np.float32),
        normal(n_filters, len(langs), scale=0.3), np.zeros(len(langs), np.float32),
    )
    net.embed[0] = 0
    weights = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        order = draw.permutation(len(windows))
        for at in range(0, len(order), 64):
            take = order[at : at + 64]
            batch, target = windows[take], labels[take]
            columns = np.ascontiguousarray(net.columns(batch))
            response = columns @ net.filters
            best = response.argmax(axis=1)  # (windows, filters)
            pooled = np.take_along_axis(response, best[:, None], axis=1)[:, 0] + net.bias
            hidden = np.maximum(pooled, 0)
            logits = hidden @ net.out + net.out_bias
            share = np.exp(logits - logits.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            share[np.arange(len(take)), target] -= 1
            share /= len(take)
            back = (share @ net.out.T) * (pooled > 0)
            seen = columns[np.arange(len(take))[:, None], best]  # (windows, filters, widest * embedding)
            to_bytes = (back[:, :, None] * net.filters.T[None]).reshape(len(take), n_filters, widest, EMBEDDING)
            of_bytes = batch[np.arange(len(take))[:, None, None], best[:, :, None] + np.arange(widest)]
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, of_bytes.ravel(), to_bytes.reshape(-1, EMBEDDING))
            d_embed[0] = 0
            slopes = [d_embed, np.einsum("nf,nfc->cf", back, seen) * mask, back.sum(axis=0), hidden.T @ share, share.sum(axis=0)]
            step += 1
            for weight, slope, m, v in zip(weights, slopes, first, second, strict=True):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                weight -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def fit(docs: DataFrame, usable: Column | None = None, docs_per_lang: int = DOCS_PER_LANG,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNet | None:
    """A network trained on the rows with a language and a letter for which ``usable`` holds; None without such rows."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    rows = (rows if usable is None else rows.where(usable)).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, docs_per_lang / n))])
    mixed = F.xxhash64("id", F.lit(1))
    chosen = rows.where(F.pmod(mixed, F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"place": [], "lang": [], "window": []}
            for place, lang, text in zip(batch["place"].to_pylist(), batch["lang"].to_pylist(), text_bytes(batch, "text"), strict=True):
                if not has_letter(text):
                    continue
                total = -(-len(text) // WINDOW)
                for k in range(min(total, WINDOWS_PER_DOC)):
                    at = (k * total // min(total, WINDOWS_PER_DOC)) * WINDOW
                    out["place"].append(place)
                    out["lang"].append(lang)
                    out["window"].append(text[at : at + WINDOW])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("place", pa.int64()), ("lang", pa.string()), ("window", pa.binary())]))

    windows = chosen.select(mixed.alias("place"), "lang", "text").mapInArrow(sample, "place long, lang string, window binary")
    # the bound holds even where ids repeat
    taken = windows.orderBy("place", "lang", "window").limit(2 * docs_per_lang * WINDOWS_PER_DOC * len(sizes)).collect()
    if not taken:
        return None
    langs = sorted({r.lang for r in taken})
    cut, _, _ = cut_windows([bytes(r.window) for r in taken])
    return train(cut, np.array([langs.index(r.lang) for r in taken]), langs)


def predict(net: ByteNet | None, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [k for k, text in enumerate(texts) if has_letter(text)] if net else []
    # texts go through together, in blocks of bounded size
    at = 0
    while at < len(known):
        stop, size = at, 0
        while stop < len(known) and (stop == at or size + len(texts[known[stop]]) <= 1 << 22):
            size += len(texts[known[stop]])
            stop += 1
        block = known[at:stop]
        windows, sizes, owner = cut_windows([texts[k] for k in block])
        total = np.zeros((len(block), len(net.langs)))
        np.add.at(total, owner, net.log_probabilities(windows) * sizes[:, None])
        mean = total / np.bincount(owner, weights=sizes)[:, None]
        share = np.exp(mean - mean.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        for k, best, score in zip(block, share.argmax(axis=1).tolist(), share.max(axis=1).tolist(), strict=True):
            langs[k], scores[k] = net.langs[best], min(1.0, score)
        at = stop
    return langs, scores


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(net, text_bytes(batch, "text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return narrow.mapInArrow(run, f"doc_id {dict(narrow.dtypes)['doc_id']}, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: ByteNet | None, min_score: float = MIN_SCORE, text_col: str = "text") -> DataFrame:
    """The documents, unchanged, whose language is recognised with at least ``min_score``."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(net, batch.column(at).cast(pa.binary()).to_pylist())
            keep = [lang != UNKNOWN and score >= min_score for lang, score in zip(langs, scores, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(crc_of_id("doc_id"), F.lit(4)) == 2, F.lit(False))
    net = fit(docs, usable=~held_out)
    return identify(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")

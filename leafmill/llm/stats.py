"""Statistics of whole texts, computed for a slice of many documents at once on their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import coded, slices, starts, strings, words

#: Fixed by the rules: characters that count as symbols, words in a window.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["log_words", "mean_word", "symbols", "dup_lines", "repeats", "upper", "digits", "punctuation", "wide", "distinct", "mean_line", "long_words", "one_char_words", "bangs", "stops", "capital_words"]

_CLASSES = {"blank": b" \t\n\x0b\x0c\r", "symbol": SYMBOLS, "upper": bytes(range(65, 91)), "digit": b"0123456789", "punctuation": b".,;:!?'\"()-", "bang": b"!?", "stop": b"."}
_BIT = {name: 1 << i for i, name in enumerate(_CLASSES)}


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.uint16)
    for name, members in _CLASSES.items():
        table[list(members)] |= _BIT[name]
    table[[b for b in range(256) if b & 0xC0 != 0x80]] |= 1 << 14  # begins a code point
    table[0xC0:] |= 1 << 13  # begins one outside ASCII
    return table


_TABLE = _class_table()


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of small numbers."""
    x = (x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(codes: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each document, the words in windows that it holds twice or more, the first included."""
    at = starts(counts)
    n = len(codes)
    if n < window:
        return np.zeros(len(counts), np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    mixed, key = _mixed(codes), np.zeros(n - window + 1, np.uint64)
    for j in range(window):
        key = key * np.uint64(0x2545F4914F6CDD1D) + mixed[j : n - window + 1 + j]
    inside = doc[: n - window + 1] == doc[window - 1 :]
    place = np.flatnonzero(inside)
    key = key[place] ^ _mixed(doc[place] + (1 << 40))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    first = place[order[twice]]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + window, -1)
    total = starts(np.cumsum(change[:-1]) > 0)
    return total[at[1:]] - total[at[:-1]]


def _lines(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines that hold a word, and those of them that equal an earlier line."""
    lists = pc.split_pattern(text, "\n")
    flat = lists.flatten()
    doc = np.repeat(np.arange(len(text)), np.diff(np.asarray(lists.offsets)))
    d = flat.dictionary_encode()
    codes = np.asarray(d.indices).astype(np.int64)
    full = np.asarray(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(d.dictionary)), 0))
    doc, codes = doc[full[codes]], codes[full[codes]]
    n = np.bincount(doc, minlength=len(text))
    distinct = np.unique(doc * max(1, len(full)) + codes) // max(1, len(full))
    return n, n - np.bincount(distinct.astype(np.int64), minlength=len(text))


def text_stats(text: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and RATIOS of a string array without nulls."""
    text = pa.concat_arrays([text])  # offsets from the slice's own start
    flat, n_words = words(text)
    distinct, codes = coded(flat)
    offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64)
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    classes = _TABLE[raw]

    def count(bit: int) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int32)
        np.cumsum((classes & bit) != 0, out=total[1:], dtype=np.int32)
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.int64)

    n = {name: count(bit) for name, bit in _BIT.items()}
    points, wide = count(1 << 14), count(1 << 13)
    n_lines, n_dup = _lines(text)
    at, sizes = starts(n_words), np.array([len(w) for w in distinct], np.int64)
    of_doc = lambda per_word: (lambda t: t[at[1:]] - t[at[:-1]])(starts(per_word[codes] if len(distinct) else np.zeros(0, np.int64)))
    doc = np.repeat(np.arange(len(text)), n_words)
    n_distinct = np.bincount(np.unique(doc * max(1, len(distinct)) + codes) // max(1, len(distinct)), minlength=len(text)) if len(codes) else np.zeros(len(text), np.int64)
    capital = np.array([w.isupper() and len(w) > 1 for w in distinct], bool)
    repeats = repeated_words(codes, n_words)
    chars = points - n["blank"]
    w, c = np.maximum(1, n_words), np.maximum(1, chars)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": n["symbol"], "n_dup_lines": n_dup.astype(np.int64), "n_repeat_words": repeats,
        "log_words": np.log1p(n_words), "mean_word": chars / w, "symbols": n["symbol"] / w, "dup_lines": n_dup / np.maximum(1, n_lines), "repeats": repeats / w,
        "upper": n["upper"] / c, "digits": n["digit"] / c, "punctuation": n["punctuation"] / w, "wide": wide / c, "distinct": n_distinct / w, "mean_line": np.log1p(n_words / np.maximum(1, n_lines)),
        "long_words": of_doc(sizes > 20) / w, "one_char_words": of_doc(sizes == 1) / w, "bangs": n["bang"] / w, "stops": n["stop"] / w, "capital_words": of_doc(capital) / w,
    }


def labelled_stats(docs: DataFrame, labels: DataFrame, label: str, most: int, keep=None) -> tuple[np.ndarray, np.ndarray]:
    """RATIOS and labels of at most ``most`` labelled documents, for fitting a classifier on the driver.

    The sample is the ``most`` labels of smallest hash of doc_id, so it is the same in every run and grows with the labels up
    to its bound; being bounded, its ids are broadcast.  Null labels and doc_ids are left out; a doc_id that repeats in
    ``labels`` has its smallest label; one that repeats in ``docs`` counts with each row.
    """
    chosen = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if keep is not None:
        chosen = chosen.filter(keep(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = text_stats(strings(batch.column("text")))
            x = np.stack([found[k] for k in RATIOS], 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.string()), batch.column("label").cast(pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    got = sorted((r["doc_id"], r["label"], tuple(r["x"])) for r in rows.mapInArrow(measure, "doc_id string, label long, x array<double>").collect())
    return np.array([r[2] for r in got], np.float64).reshape(len(got), len(RATIOS)), np.array([r[1] for r in got], np.int64)

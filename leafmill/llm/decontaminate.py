"""Benchmark decontamination: an FM-index for each shard of the documents, searched for all windows of the benchmark."""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import byte_table, coded, documents, keep_rows, shared_folder, slices, starts, strings, translated, words
from leafmill.llm.files import BinaryFile, file_system
from leafmill.llm.fm_index import FmIndex

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` in UTF-8, after lower-casing: digits, a-z, and all from 0x80 on.
TABLE = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class Phrases:
    """The distinct windows of some benchmark items, as numbers of words.  A word's number is from 1 on."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.numbers: dict[bytes, int] = {}
        of: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            numbers = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in text]
            for i in range(max(1, len(numbers) - window + 1)) if numbers else ():
                of.setdefault(tuple(numbers[i : i + window]), set()).add(item)
        self.sigma = len(self.numbers) + 1
        self.groups = []
        for size in sorted({len(w) for w in of}):
            some = [w for w in of if len(w) == size]
            self.groups.append((np.array(some, np.int64), [sorted(of[w]) for w in some]))


def blocks(benchmark: DataFrame, window: int, most: int, id_col: str, text_col: str) -> list[str]:
    """The benchmark in blocks of about ``most`` words (an item is never divided), each built and written by a task as a file
    of the shared folder.  Items are dealt out by the number of all words, so blocks are as few as that allows, however many
    partitions the benchmark has.  Only the files' places come back, one a block; a task that runs again leaves files that
    nobody reads."""
    items = documents(benchmark, id_col, text_col).select(F.col("doc_id").cast("string"), "text")
    spaces = F.size(F.split(F.translate("text", "\t\n\x0b\x0c\r", " " * 5), " "))  # words, or a few more
    total = items.agg(F.sum(spaces.cast("long"))).first()[0] or 0
    items = items.repartition(max(1, -(-total // most)))
    folder = shared_folder(benchmark.sparkSession, "benchmark-blocks")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def write() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.block"
            with BinaryFile(folder, name) as out:
                out.write(pickle.dumps(Phrases(held, window), pickle.HIGHEST_PROTOCOL))
            return pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

        held, size = [], 0
        for batch in batches:
            for item, text in zip(strings(batch.column("doc_id")).to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.append((item, text.encode("utf-8", "replace").translate(TABLE).split()))
                size += len(held[-1][1])
                if size >= 2 * most:
                    yield write()
                    held, size = [], 0
        if held:
            yield write()

    return [f"{folder}/{r['name']}" for r in items.mapInArrow(build, "name string").collect()]


class Blocks:
    """Written blocks, read one after another; the first few are held by the task that has read them."""

    def __init__(self, places: list[str], held: int = 2):
        self.places, self.most, self.held = places, held, {}

    def __iter__(self) -> Iterator[Phrases]:
        for place in self.places:
            yield self.held.get(place) or self._read(place)

    def _read(self, place: str) -> Phrases:
        system, path = file_system(place)
        with system.open_input_stream(path) as f:
            block = pickle.loads(f.read())
        if len(self.held) < self.most:
            self.held[place] = block
        return block


def _shard(symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence to index, and the word that each of its places stands for.  Documents end with a separator, words that
    are in no window are separators, and several separators in a row are one."""
    ends = np.cumsum(counts)
    sequence = np.concatenate([[0], np.insert(symbols, ends, 0)])
    word = np.concatenate([[-1], np.insert(np.arange(len(symbols)), ends, -1)])
    kept = np.ones(len(sequence), bool)
    kept[1:] = (sequence[1:] != 0) | (sequence[:-1] != 0)
    return sequence[kept], word[kept]


def find(symbols: np.ndarray, counts: np.ndarray, sigma: int, of_block: list[tuple]) -> Iterator[tuple[np.ndarray, int, np.ndarray, list[list[str]]]]:
    """For each block and window length: first words of all occurrences, the length, which window each is, and the windows'
    items.  ``of_block`` gives a block's groups of windows, in the shard's symbols; the shard is indexed once."""
    sequence, word = _shard(symbols, counts)
    if len(sequence) < 2:
        return
    index = FmIndex(sequence, sigma)
    for groups in of_block:
        for patterns, items in groups:
            low, high = index.search(patterns)
            times = high - low
            which = np.repeat(np.arange(len(patterns)), times)
            rows = np.repeat(low - starts(times)[:-1], times) + np.arange(times.sum())
            yield word[index.locate(rows)], patterns.shape[1], which, items


def _translated(blocks_: Blocks, distinct: list[bytes]) -> Iterator[list[tuple]]:
    """Each block's windows in a shard's own symbols; those with a word that the shard has not can't stand in it."""
    own = {w: i for i, w in enumerate(distinct, 1)}
    for phrases in blocks_:
        to = np.zeros(phrases.sigma, np.int64)
        for w, n in phrases.numbers.items():
            to[n] = own.get(w, 0)
        groups = []
        for patterns, items in phrases.groups:
            there = to[patterns]
            some = np.flatnonzero((there > 0).all(axis=1))
            if len(some):
                groups.append((there[some], [items[k] for k in some.tolist()]))
        yield groups


def searcher(benchmark: DataFrame, window: int = 10, block_words: int = 1 << 20, item_col: str = "item_id", item_text_col: str = "text") -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, list[set[str]]]]:
    """A function from texts to how many words each has, which words (of all texts in turn) are hit, and each text's items."""
    written = Blocks(blocks(benchmark, window, block_words, item_col, item_text_col))

    def search(text: pa.Array) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
        flat, counts = words(translated(text, TABLE))
        distinct, codes = coded(flat)
        at = starts(counts)
        change = np.zeros(at[-1] + 1, np.int64)
        of: list[set[str]] = [set() for _ in counts]
        if len(written.places) == 1:  # the block's words are the symbols, so that others shrink to separators
            phrases = next(iter(written))
            symbols = np.array([phrases.numbers.get(w, 0) for w in distinct], np.int64)[codes] if distinct else np.zeros(0, np.int64)
            found = find(symbols, counts, phrases.sigma, [phrases.groups])
        else:  # the shard's words are, so that it is indexed once for all blocks
            found = find(codes + 1, counts, len(distinct) + 1, _translated(written, distinct)) if distinct else ()
        for first, size, which, items in found:
            np.add.at(change, first, 1)
            np.add.at(change, first + size, -1)
            doc = np.searchsorted(at, first, side="right") - 1
            for pair in np.unique(doc * len(items) + which).tolist():
                of[pair // len(items)].update(items[pair % len(items)])
        return counts, np.cumsum(change[:-1]) > 0, of

    return search


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Where windows of ``window`` words of the benchmark stand in the documents.

    Returns doc_id, n_words, n_hit (words inside any occurrence), items (array<string>, sorted), spans (what to remove:
    overlapping and touching occurrences merged, array<struct<begin, end>> in code points, end exclusive); a row for each
    input row.

    * Words are lower-cased (A-Z).  An item of fewer words than a window, but not none, is one window; a null or empty text
      has no words.  Items that repeat an id are one item; a null item_id is the empty string.
    * Rows that repeat are each looked through; other columns are ignored; empty tables give no rows or no hits.

    Each task cuts its documents into shards (never inside a document), indexes each once, and searches it with one block
    of the benchmark at a time (``block_words``), which it reads from the shared folder; no text is shuffled or broadcast,
    and memory is bounded by a shard, or by the longest document, and a block (or the longest item), however large the benchmark.
    """
    search = searcher(benchmark, window, block_words, item_col, item_text_col)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            text = strings(batch.column("text"))
            counts, hit, of = search(text)
            at, total = starts(counts), starts(hit)
            n_hit = total[at[1:]] - total[at[:-1]]
            spans = [_spans(text[i].as_py(), hit[at[i] : at[i + 1]]) if n else [] for i, n in enumerate(n_hit.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts), pa.array(n_hit), pa.array([sorted(x) for x in of], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return documents(docs, id_col, text_col).mapInArrow(look, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs (doc_id, text, any more) in which no window of the benchmark stands; see decontaminate."""
    search = searcher(benchmark, **options)

    def clean(text: pa.Array) -> np.ndarray:
        counts, hit, _ = search(text)
        at, total = starts(counts), starts(hit)
        return total[at[1:]] == total[at[:-1]]

    return keep_rows(docs, clean)


def _spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words, from the first one's start to the last one's end."""
    out, before = [], False
    for m, h in zip(WORD.finditer(text), hit.tolist(), strict=True):
        if h and before:
            out[-1]["end"] = m.end()
        elif h:
            out.append({"begin": m.start(), "end": m.end()})
        before = h
    return out


def remove_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Texts without their spans (doc_id, text), for callers that cut passages out instead of dropping the document.
    ``found`` is decontaminate()'s result for the same rows, whose doc_ids must be unique."""
    s = F.col("spans")
    begin = lambda i: F.coalesce(F.get(s, i - 1)["end"], F.lit(0))
    end = lambda i: F.coalesce(F.get(s, i)["begin"], F.char_length("text").cast("long"))
    pieces = F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: F.substring(F.col("text"), (begin(i) + 1).cast("int"), (end(i) - begin(i)).cast("int")))
    return documents(docs).join(found.select("doc_id", "spans"), "doc_id").select("doc_id", F.array_join(pieces, "").alias("text"))

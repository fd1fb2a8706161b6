"""Token-ID output: plane-shuffled binary files.

A file holds the ids of whole documents, in order.  Its ids are cut into blocks of ``block`` ids; a block is transposed into
byte planes (all lowest bytes, then all second bytes, ...) or bit planes, and each plane is compressed with zstandard by
itself, so that the almost constant high planes cost next to nothing.  Planes of zeros are not stored.

    planes of block 0 | planes of block 1 | ... | document table | chunk index | tail

* chunk index: for each block, little-endian u64: offset, ids, crc32 of the ids, then the length of each plane
* document table: zstandard of n flags (1: the doc_id is null), n i64 doc_ids and n i64 id counts
* tail: see ``TAIL``
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import LOWER_TABLE, SLICE_BYTES, byte_list, documents, give_back, materialise, shared_folder, slices, starts, strings, translated, words
from leafmill.llm.files import BinaryFile, partition_name, read_files

MAGIC = b"IDPLANE1"
#: magic, block, planes to an id (4: bytes, 32: bits), blocks, documents, ids, part, sequence, offset of the table, of the index.
TAIL = struct.Struct("<8sIIQQQQQQQ")
SUFFIX = ".idp"
END_ID = 1


class DamagedFile(ValueError):
    pass


def _planes(ids: np.ndarray, planes: int) -> list[bytes]:
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == 32:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        return [row.tobytes() for row in np.packbits(bits.T, axis=1, bitorder="little")]
    return [raw[:, i].tobytes() for i in range(4)]


def _unplaned(parts: list[bytes], n: int, planes: int) -> np.ndarray:
    if planes == 32:
        rows = np.stack([np.frombuffer(p, np.uint8) if p else np.zeros((n + 7) // 8, np.uint8) for p in parts])
        bits = np.unpackbits(rows, axis=1, count=n, bitorder="little")
        return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u4").ravel()
    raw = np.zeros((n, 4), np.uint8)
    for i, p in enumerate(parts):
        if p:
            raw[:, i] = np.frombuffer(p, np.uint8)
    return raw.view("<u4").ravel()


def encode_file(ids, doc_ids: list, counts, part: int = 0, sequence: int = 0, block: int = 1 << 16, planes: int = 4, level: int = 3) -> bytes:
    if planes not in (4, 32):
        raise ValueError("planes: 4 for byte planes, 32 for bit planes")
    ids = np.ascontiguousarray(ids, dtype="<u4")
    pack = zstandard.ZstdCompressor(level=level).compress
    out, index, at = [], [], 0
    for i in range(0, len(ids), block):
        piece = ids[i : i + block]
        stored = [pack(p) if any(p) else b"" for p in _planes(piece, planes)]
        index.append([at, len(piece), zlib.crc32(piece.tobytes()), *map(len, stored)])
        out += stored
        at += sum(map(len, stored))
    null = np.array([d is None for d in doc_ids], np.uint8)
    docs = pack(null.tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.asarray(counts, "<i8").tobytes())
    entries = np.array(index, "<u8").tobytes()
    tail = TAIL.pack(MAGIC, block, planes, len(index), len(doc_ids), len(ids), part, sequence, at, at + len(docs))
    return b"".join([*out, docs, entries, tail])


class IdFile:
    """Reads a whole file, its documents, or any range of ids through the chunk index."""

    def __init__(self, data: bytes):
        try:
            magic, self.block, self.planes, n, self.n_docs, self.n_ids, self.part, self.sequence, docs, index = TAIL.unpack(data[-TAIL.size :])
        except struct.error as e:
            raise DamagedFile("too short") from e
        if magic != MAGIC or self.planes not in (4, 32) or index + n * 8 * (3 + self.planes) + TAIL.size != len(data):
            raise DamagedFile("no tail")
        self.data = data
        self.index = np.frombuffer(data, "<u8", n * (3 + self.planes), index).reshape(n, 3 + self.planes).astype(np.int64)
        raw = zstandard.ZstdDecompressor().decompress(data[docs:index], max_output_size=17 * self.n_docs)
        null, ids = np.frombuffer(raw, np.uint8, self.n_docs), np.frombuffer(raw, "<i8", self.n_docs, self.n_docs)
        self.doc_ids = [None if x else int(d) for x, d in zip(null, ids, strict=True)]
        self.counts = np.frombuffer(raw, "<i8", self.n_docs, 9 * self.n_docs).astype(np.int64)

    def chunk(self, i: int) -> np.ndarray:
        at, n, check, *sizes = self.index[i].tolist()
        unpack, parts = zstandard.ZstdDecompressor().decompress, []
        whole = n if self.planes == 4 else (n + 7) // 8
        for size in sizes:
            parts.append(unpack(self.data[at : at + size], max_output_size=whole) if size else b"")
            at += size
        ids = _unplaned(parts, n, self.planes)
        if zlib.crc32(ids.tobytes()) != check:
            raise DamagedFile(f"block {i}")
        return ids

    def ids(self, begin: int = 0, end: int | None = None) -> np.ndarray:
        end = self.n_ids if end is None else end
        if begin >= end:
            return np.zeros(0, "<u4")
        first = begin // self.block
        return np.concatenate([self.chunk(i) for i in range(first, (end - 1) // self.block + 1)])[begin - first * self.block : end - first * self.block]


class WordEncoder:
    """Ids of many texts, by way of their distinct words.

    The tokenizer drops white space, lower-cases, and never joins a letter or digit and the punctuation after it, so a text's
    ids are those of its words in turn, and a word's those of its core (in lower case) and of the stops and commas at its
    end.  Each distinct core goes to the tokenizer once, as long as it is remembered.  Words are divided by ASCII white space
    only; other white space stays inside a "word" for the tokenizer to deal with.

    Cores of a-z alone are single words to the tokenizer and go to its model without normalising, many at a time; a token
    that ends a word tells them apart.  Others go through the whole tokenizer with a special token between them, and those
    that hold such a token's text one by one.
    """

    def __init__(self, path: str, keep: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.odd = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark, self.mark_id = self.odd[0], self.tokenizer.token_to_id(self.odd[0])
        layout = json.loads(self.tokenizer.to_str())
        self.plain = None
        if suffix := layout["model"].get("end_of_word_suffix"):
            self.plain = Tokenizer.from_str(json.dumps(layout | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None}))
            self.ends_word = np.zeros(max(layout["model"]["vocab"].values()) + 1, bool)
            self.ends_word[[i for t, i in layout["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        #: Entry 0 is empty.
        self.known: dict[str, int] = {"": 0}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(2, np.int64)

    def _add(self, new: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def _learn(self, new: list[str]) -> None:
        column = pa.array(new, pa.string())
        plain = np.asarray(pc.fill_null(pc.and_(pc.ascii_is_alpha(column), pc.string_is_ascii(column)), False)) if self.plain else np.zeros(len(new), bool)
        special = ~plain & np.logical_or.reduce([np.asarray(pc.match_substring(column, x)) for x in self.odd])
        taken = lambda mask: column.filter(pa.array(mask)).to_pylist()
        if some := taken(plain):
            ids = self._joined(self.plain, some, " ", "")
            last = np.flatnonzero(self.ends_word[ids])
            self._checked_add(some, ids, np.diff(last, prepend=-1))
        if some := taken(~plain & ~special):
            ids = self._joined(self.tokenizer, some, self.mark, self.mark)
            bounds = ids == self.mark_id
            self._checked_add(some, ids[~bounds], np.diff(np.flatnonzero(bounds), prepend=-1) - 1)
        self._one_by_one(taken(special))

    def _checked_add(self, new: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """Where a bound between words is lost, those of the batch are encoded each by itself."""
        if len(counts) == len(new):
            self._add(new, ids, counts)
        else:
            self._one_by_one(new)

    def _one_by_one(self, new: list[str]) -> None:
        for w in new:
            ids = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32)
            self._add([w], ids, np.array([len(ids)]))

    @staticmethod
    def _joined(tokenizer, texts: list[str], between: str, after: str, n: int = 1000) -> np.ndarray:
        # One group at a time: what the tokenizer returns is many times its ids.
        found = (tokenizer.encode_batch_fast([between.join(texts[i : i + n]) + after], add_special_tokens=False)[0].ids for i in range(0, len(texts), n))
        return np.concatenate([np.array(ids, np.uint32) for ids in found])

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id after it, and how many each text has."""
        flat, n_words = words(translated(texts, LOWER_TABLE))
        if len(self.known) > self.keep:
            self._forget()
        d = flat.dictionary_encode()
        cores, of_core, stops = _divided(d.dictionary)
        known = self.known
        if new := list(dict.fromkeys(w for w in [*cores, *stops.values()] if w not in known)):
            self._learn(new)
        # First the ids of each distinct word, its core's and its stops'; then those of all words in turn, the end id after each text.
        parts = np.zeros(2 * len(of_core), np.int64)
        parts[0::2] = np.fromiter(map(known.__getitem__, cores), np.int64, len(cores))[of_core]
        parts[[2 * i + 1 for i in stops]] = [known[w] for w in stops.values()]
        ids, lengths = _gathered(self.ids, self.ends, parts)
        ends = starts(lengths)[::2]
        pool, ends = np.append(ids, np.uint32(end_id)), np.append(ends, ends[-1] + 1)
        ids, lengths = _gathered(pool, ends, np.insert(np.asarray(d.indices), np.cumsum(n_words), len(of_core)))
        return ids, np.diff(starts(lengths)[starts(n_words + 1)])


def _text_list(array: pa.Array) -> list[str]:
    """Bytes that are no UTF-8 become replacement characters, as the tokenizer would be given them."""
    try:
        return array.to_numpy(zero_copy_only=False).tolist()
    except UnicodeDecodeError:
        return [w.decode("utf-8", "replace") for w in byte_list(array)]


_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = True


def _divided(distinct: pa.Array) -> tuple[list[str], np.ndarray, dict[int, str]]:
    """Words cut into cores and stops: the distinct cores, which of them each word has, and the stops of words that have any.
    Stops are cut off only behind an ASCII letter or digit."""
    trimmed = pc.ascii_rtrim(distinct, ".,")
    ends = np.frombuffer(trimmed.buffers()[1], np.int32, len(trimmed) + 1, trimmed.offset * 4)
    data = np.frombuffer(trimmed.buffers()[2] or b"", np.uint8)
    some = ends[1:] > ends[:-1]
    some[some] = _ALNUM[data[ends[1:][some] - 1]]
    whole = pc.if_else(pa.array(some), trimmed, distinct).dictionary_encode()
    cut = np.flatnonzero(some & (np.asarray(pc.binary_length(trimmed)) < np.asarray(pc.binary_length(distinct))))
    with_stops = _text_list(distinct.take(pa.array(cut)))
    stops = {i: w[len(w.rstrip(".,")) :] for i, w in zip(cut.tolist(), with_stops, strict=True)}
    return _text_list(whole.dictionary), np.asarray(whole.indices), stops


def _gathered(pool: np.ndarray, ends: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a ragged array in a new order, all in one, and their lengths."""
    lengths = np.diff(ends)[order]
    at = starts(lengths)
    return pool[np.repeat(ends[:-1][order] - at[:-1], lengths) + np.arange(at[-1])], lengths


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One a Python worker; what it has learned is forgotten after each task, lest it count against other work."""
    return WordEncoder(path)


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, file_ids: int = 2 << 20, block: int = 1 << 16, planes: int = 4, partitions: int | None = None) -> DataFrame:
    """Write the files of a table's documents in ascending doc_id order; returns their index (part, sequence, n_ids, n_docs)."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = documents(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, sequence = _encoder(tokenizer), partition_name(), 0
        held: list = [[], [], []]

        def flush():
            nonlocal sequence
            ids, counts = np.concatenate(held[0]), np.concatenate(held[2])
            with BinaryFile(folder, f"part-{part:08d}-{sequence:06d}{SUFFIX}") as out:
                out.write(encode_file(ids, held[1], counts, part, sequence, block, planes))
            row = pa.RecordBatch.from_pydict({"part": [part], "sequence": [sequence], "n_ids": [len(ids)], "n_docs": [len(counts)]})
            sequence += 1
            for x in held:
                x.clear()
            return row

        for batch in slices(batches, "text", 2 * SLICE_BYTES):
            ids, counts = encoder(strings(batch.column("text")), end_id)
            held[0].append(ids)
            held[1].extend(batch.column("doc_id").to_pylist())
            held[2].append(counts)
            if sum(map(len, held[0])) >= file_ids:
                yield flush()
        if held[1]:
            yield flush()
        encoder._forget()
        give_back()

    return materialise(ordered.mapInArrow(write, "part long, sequence long, n_ids long, n_docs long"), "id-index")


def read_ids(spark, folder: str) -> DataFrame:
    """(part, sequence, doc_id, at, n_tokens, ids_crc32) of every document in the files; ``at`` counts from the file's start."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                file = IdFile(data.as_buffer().to_pybytes())
                ids, at = file.ids(), starts(file.counts)
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([file.part] * file.n_docs, pa.int64()), "sequence": pa.array([file.sequence] * file.n_docs, pa.int64()), "doc_id": pa.array(file.doc_ids, pa.int64()), "at": pa.array(at[:-1]),
                    "n_tokens": pa.array(file.counts), "ids_crc32": pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                })

    return read_files(spark, folder, SUFFIX).select("content").mapInArrow(read, "part long, sequence long, doc_id long, at long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID, folder: str | None = None, **options) -> DataFrame:
    """Encode all texts, write them to plane-shuffled files in ``folder`` (default: a new shared folder) and read those back.

    Returns doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32; a row for each input row.

    * doc_ids are integers of 64 bits at most, as the format holds them; any other type is refused before anything is read.
    * A null or empty text has the end id alone.  Null doc_ids come first; rows that repeat a doc_id are ordered by their text.
    * Other columns are ignored.  An empty table writes no file and gives an empty table.

    The text is dealt out by ranges of doc_id and sorted within them; a task holds one file's ids (``file_ids``, or one
    document if that is longer) at a time.  Only the index of files, and of it one row for each partition, is summed in
    order; starts are put together from the partition's, the file's and the document's own.
    """
    spark = docs.sparkSession
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise ValueError(f"doc_id: an integer column, not {docs.schema['doc_id'].dataType.simpleString()}")
    folder = folder or shared_folder(spark, "ids")
    index = write_ids(docs, tokenizer, folder, end_id, **options)
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    parts = index.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(before().orderBy("part")), F.lit(0)).alias("part_start"))
    files = index.select("part", "sequence", F.coalesce(F.sum("n_ids").over(before("part").orderBy("sequence")), F.lit(0)).alias("file_start"))
    return (
        read_ids(spark, folder)
        .join(files, ["part", "sequence"])
        .join(parts, ["part"])
        .select("doc_id", (F.col("part_start") + F.col("file_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
    )

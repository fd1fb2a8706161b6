"""Pieces that several operators share: text batches, word arrays, shared folders."""

from __future__ import annotations

import contextlib
import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word pattern ``[^\x20\x09-\x0D]+``.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that a task holds as words at once; a longer text is one slice of its own.
SLICE_BYTES = 2 << 20


#: Rows and bytes of an Arrow batch.  Texts are long: Spark's 10,000 rows are tens of MB, in the JVM and in each Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bounded(spark: SparkSession) -> None:
    """The session's Arrow batches, where they are larger or without bound, are set to BATCH_ROWS and BATCH_BYTES: Spark has no
    setting by query, and a task's memory is bounded by them."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if not re.fullmatch(r"[1-9]\d*b?", said := spark.conf.get(size)) or int(said.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the query's folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, with null texts read as empty; other columns, whatever their names, stay behind."""
    bounded(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z.  ``lower`` has a fast path for ASCII, where both agree; other strings are translated."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bucket(column: Column, n: int) -> Column:
    """crc32 of the column as text, modulo n."""
    return F.crc32(column.cast("string").cast("binary")) % n


# --------------------------------------------------------------------------- shared folders


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see: below spark.checkpoint.dir, or below the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: a cut in the lineage that outlives any executor."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --------------------------------------------------------------------------- text in tasks


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the named column has about ``most`` bytes in each piece, one row at least."""
    give_back()
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        begin = 0
        while begin < len(batch):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end
            give_back()


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks, and what one slice has freed would else count
    against the executor for good."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def strings(array: pa.Array) -> pa.Array:
    """A string array without nulls (null: empty)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    return pc.fill_null(array if pa.types.is_string(array.type) else array.cast(pa.string()), "")


def translated(array: pa.Array, to: bytes) -> pa.Array:
    """Each byte of a string array replaced through a table of 256; lengths stay.  Of a slice, only its own bytes are read."""
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int32, len(array) + 1, array.offset * 4) if offsets is not None and len(array) else np.zeros(1, np.int32)
    begin, size = int(ends[0]), int(ends[-1] - ends[0])
    new = data.slice(begin, size).to_pybytes().translate(to) if size else b""
    return pa.Array.from_buffers(pa.string(), len(array), [None, pa.py_buffer(ends - ends[0]), pa.py_buffer(new)])


def byte_table(is_word) -> bytes:
    """For ``translated``: A-Z lower-cased, bytes of no word blank."""
    low = bytes(range(256)).lower()
    return bytes(b if is_word(b) else 0x20 for b in low)


LOWER_TABLE = bytes(range(256)).lower()


def words(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\x20\x09-\x0D]+`` of a string array, and how many each row has."""
    lists = pc.ascii_split_whitespace(array)
    flat = lists.flatten()
    counts = np.diff(np.asarray(lists.offsets, dtype=np.int64))
    some = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not some.all():
        rows = np.repeat(np.arange(len(counts)), counts)[some]
        counts = np.bincount(rows, minlength=len(counts)).astype(np.int64)
        flat = flat.filter(pa.array(some))
    return flat, counts


def coded(flat: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct words as bytes, and for each word the number of its distinct one."""
    if not len(flat):
        return [], np.zeros(0, np.int64)
    d = flat.dictionary_encode()
    return byte_list(d.dictionary), np.asarray(d.indices).astype(np.int64)


def byte_list(array: pa.Array) -> list[bytes]:
    return array.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()


def starts(counts: np.ndarray) -> np.ndarray:
    """Prefix sums with a leading zero."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def keep_rows(docs: DataFrame, judge: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of docs, with all their columns, whose texts (null: empty) the function marks True; no shuffle.  Only texts go
    to Python, and only the marks come back."""
    bounded(docs.sparkSession)

    def mark(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in columns:
            parts = slices([pa.RecordBatch.from_arrays([text], ["text"])], "text")
            yield pa.concat_arrays([pa.array([], pa.bool_()), *(pa.array(judge(strings(part.column("text"))), pa.bool_()) for part in parts)])

    mark.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}  # the function's kind, for Spark
    return docs.filter(F.arrow_udf(mark, "boolean")(F.col("text")))


# --------------------------------------------------------------------------- joins with hot keys

#: Keys that may be hot, at most, and the share of all rows that makes one hot.
HOT_KEYS = 4096


def spread_join(rows: DataFrame, per_key: DataFrame, keys: list[str], weight: str, by: Column, how: str) -> DataFrame:
    """``rows`` joined with a written table of one row a key, whose ``weight`` is about how many of the rows have the key.

    A key of more than 1 / HOT_KEYS of all weight is hot: its rows are dealt to several places by the hash of ``by``, and its one
    row is there in each.  There can be no more than HOT_KEYS such keys, so the table of them, which both sides look up, is
    bounded; and they get no more than twice as many places in all.
    """
    least = max(1, (per_key.agg(F.sum(weight)).first()[0] or 0) // HOT_KEYS)
    places = per_key.filter(F.col(weight) > least).select(*keys, F.ceil(F.col(weight) / least).cast("long").alias("_places"))
    some = F.coalesce("_places", F.lit(1))
    dealt = rows.join(F.broadcast(places), keys, "left").withColumn("_place", F.pmod(F.xxhash64(by), some)).drop("_places")
    copies = per_key.join(F.broadcast(places), keys, "left").withColumn("_place", F.explode(F.sequence(F.lit(0).cast("long"), some - 1))).drop("_places")
    return dealt.join(copies, [*keys, "_place"], how).drop("_place")

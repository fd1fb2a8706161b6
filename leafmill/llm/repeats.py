"""Suffix-array dedup: long strings that stand in several places are removed, byte by byte."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import suffixes
from leafmill.llm.common import documents, give_back, materialise, slices, spread_join, strings

#: Bytes of a string that counts as repeated.
LENGTH = 400
#: Places of strings that are looked at together in a task, whatever the texts' lengths.
STEP = 1 << 20
#: Contexts of one anchor from which they are told apart further before they are sorted.
MOST = 1024
#: Letters that are sorted together, if no more are needed for one anchor's contexts.
PIECE = 1 << 19

_OF = ["doc_id", "text_hash"]


# --------------------------------------------------------------------------- anchors


def gram(length: int) -> int:
    """Bytes of an anchor's own string."""
    return max(1, length * 4 // 25)


def _hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place on (fewer at the end), by doubling."""
    with np.errstate(over="ignore"):
        power = np.uint64(0x9E3779B97F4A7C15)
        values = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        part, out, done, k = (values ^ values >> np.uint64(29))[data], None, 0, 1
        while True:
            if size & k:
                if out is None:
                    out = part.copy()
                else:
                    out *= power
                    out[: len(out) - done] += part[done:]
                done += k
            if 2 * k > size:
                break
            wider = part * power
            wider[: len(part) - k] += part[k:]
            part, power, k = wider, power * power, 2 * k
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ out >> np.uint64(29)


def _least(keys: np.ndarray, span: int) -> np.ndarray:
    """The least of the ``span`` keys from each place on (fewer at the end): of two blocks, what one ends and the other begins with."""
    pad = -len(keys) % span
    blocks = np.concatenate([keys, np.full(pad + span, np.iinfo(np.int64).max)]).reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(keys)], ahead[span - 1 : span - 1 + len(keys)])


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, begin, n, anchor, print) of texts that stand in ``data`` one after the other.

    The anchor of a string of ``length`` bytes is the first of its places with the least hash of the bytes from there on: it
    depends on the string alone, so equal strings have equal prints at equal distances.  Strings that begin one after the other
    and have one anchor are one row: the first begins at ``begin`` of its text, there are n, and the anchor is so far from it.
    """
    size = gram(length)
    span = length - size + 1
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP + length - 1]
        if len(part) < length:
            break
        prints = _hashes(part, size)
        keys = ((prints >> np.uint64(33)).astype(np.int64) << 31) | np.arange(len(part))
        owner = _least(keys, span) & (2**31 - 1)
        some = np.arange(np.searchsorted(ends, at, side="right"), np.searchsorted(begins, at + STEP, side="left"))
        counts = np.minimum(ends[some] - length + 1, at + STEP) - np.maximum(begins[some], at)
        some, counts = some[counts > 0], counts[counts > 0]
        if not len(some):
            continue
        first = np.maximum(begins[some], at) - at
        row = np.repeat(some, counts)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        mine = owner[place]
        cut = np.flatnonzero(np.concatenate([[True], (mine[1:] != mine[:-1]) | (row[1:] != row[:-1])]))
        n = np.diff(np.append(cut, len(row)))
        yield row[cut], place[cut] + at - begins[row[cut]], n, mine[cut] - place[cut], prints[mine[cut]].view(np.int64)


def _flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, and where each row ends in them."""
    _, offsets, data = array.buffers()
    if not len(array) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(array), np.int64)
    at = np.frombuffer(offsets, np.int32, len(array) + 1, array.offset * 4).astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at[1:] - at[0]


def _anchored(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, ends = _flat(strings(batch.column("text")))
            for row, begin, n, anchor, prints in anchors(data, ends, length):
                of = batch.select(_OF).take(pa.array(row))
                columns = [*of.columns, pa.array(begin), pa.array(n.astype(np.int32)), pa.array(anchor.astype(np.int32)), pa.array(prints)]
                yield pa.RecordBatch.from_arrays(columns, [*_OF, "begin", "n", "anchor", "print"])

    return run


# --------------------------------------------------------------------------- contexts


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _contexts(length: int):
    """Of texts with their anchors: a row for each anchor, with the bytes of all strings that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for i in range(len(batch)):
                data = batch.column("text")[i].as_buffer()
                of = batch.select(_OF).slice(i, 1)
                found = batch.column("anchors")[i].values.flatten()
                begin, n = (np.asarray(x) for x in found[:2])
                for k in range(0, len(begin), 4096):
                    cut = [data[b : b + m + length - 1].to_pybytes() for b, m in zip(begin[k : k + 4096].tolist(), n[k : k + 4096].tolist(), strict=True)]
                    rows = of.take(pa.array(np.zeros(len(cut), np.int64)))
                    columns = [*rows.columns, *(x.slice(k, 4096) for x in found), pa.array([_digest(c) for c in cut], pa.binary()), pa.array(cut, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, [*_OF, "begin", "n", "anchor", "print", "members", "h", "bytes"])

    return run


def _narrower(length: int, width: int):
    """Contexts cut into those of ``width`` strings at most, by their distance to the anchor.  What all strings of a part have
    in common becomes part of its print: strings that are equal have that in common too, so none are parted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for prints, h, data, n, anchor, copies in zip(*(batch.column(c).to_pylist() for c in ("print", "h", "bytes", "n", "anchor", "copies")), strict=True):
                for part in range((anchor - n + 1) // width, anchor // width + 1):
                    last, first = anchor - part * width, anchor - (part + 1) * width + 1
                    core = data[last : first + length]
                    begin, end = max(first, 0), min(last, n - 1) + 1
                    cut = data[begin : end + length - 1]
                    print_ = int.from_bytes(_digest(b"%d %d " % (prints, part) + core)[:8], "little", signed=True)
                    out.append((prints, h, begin, print_, _digest(cut), cut, end - begin, anchor - begin, copies))
            names = ["of_print", "of_h", "shift", "print", "h", "bytes", "n", "anchor", "copies"]
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 9, kinds, strict=True)], names)

    return run


# --------------------------------------------------------------------------- sorting


def _sorted_runs(length: int):
    """Of contexts in the order of their prints: for each, the runs of its strings that are repeated, as [begin, end)."""
    schema = pa.schema([("print", pa.int64()), ("h", pa.binary()), ("begins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def piece(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        data, ends = _flat(table["bytes"].chunk(0))
        n, copies = np.asarray(table["n"]).astype(np.int64), np.asarray(table["copies"])
        row = np.repeat(np.arange(len(n)), np.diff(np.concatenate([[0], ends])))
        text = np.zeros(len(data) + len(n), np.uint16)  # a letter of its own ends each context
        text[np.arange(len(data)) + row] = data.astype(np.uint16) + 2
        text[ends + np.arange(len(n))] = 1
        firsts = np.concatenate([[0], ends[:-1]]) + np.arange(len(n))
        of = np.repeat(np.arange(len(n)), n)
        within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        found = suffixes.repeated(text, firsts[of] + within, length, copies[of] > 1)
        edge = np.diff(np.concatenate([[0], found.view(np.int8), [0]]))
        new = np.concatenate([[True], of[1:] != of[:-1], [True]])
        begin = np.flatnonzero((edge == 1) | (new & np.concatenate([found, [False]])))
        end = np.flatnonzero((edge == -1) | (new & np.concatenate([[False], found])))
        per = np.concatenate([[0], np.cumsum(np.bincount(of[begin], minlength=len(n)))]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(per), pa.array(x.astype(np.int32))) for x in (within[begin], within[end - 1] + 1)]
        return pa.RecordBatch.from_arrays([table["print"].chunk(0), table["h"].chunk(0), *lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            prints = np.asarray(batch.column("print"))
            cuts = np.flatnonzero(prints[1:] != prints[:-1]) + 1
            if held and prints[0] != np.asarray(held[-1].column("print"))[-1]:
                cuts = np.concatenate([[0], cuts])
            ends = np.cumsum(np.diff(np.concatenate([[0], _flat(batch.column("bytes"))[1]])) + 1)
            begin = 0
            for cut in cuts.tolist():
                here = size + int(ends[cut - 1] if cut else 0) - int(ends[begin - 1] if begin else 0)
                if here >= PIECE:
                    held.append(batch.slice(begin, cut - begin))
                    yield piece(pa.Table.from_batches(held))
                    held, size, begin = [], 0, cut
                    give_back()
            held.append(batch.slice(begin))
            size += int(ends[-1]) - int(ends[begin - 1] if begin else 0)
        if size:
            yield piece(pa.Table.from_batches(held))

    return run


def _resolved(contexts: DataFrame, length: int, widths: tuple[int, ...]) -> DataFrame:
    """(print, h, copies, runs) of distinct contexts (print, h, bytes, n, anchor, copies, members)."""
    runs = F.arrays_zip(F.col("begins").alias("begin"), F.col("ends").alias("end")).alias("runs")
    calm = contexts.filter(F.col("members") <= MOST) if widths else contexts
    calm = calm.select("print", "h", "bytes", "n", "copies").repartition("print").sortWithinPartitions("print", "h")
    marked = calm.mapInArrow(_sorted_runs(length), "print long, h binary, begins array<int>, ends array<int>").select("print", "h", runs)
    hot = contexts.filter(F.col("members") > MOST)
    if not widths or hot.isEmpty():
        return marked
    parts = "of_print long, of_h binary, shift int, print long, h binary, bytes binary, n int, anchor int, copies long"
    cut = materialise(hot.select("print", "h", "bytes", "n", "anchor", "copies").mapInArrow(_narrower(length, widths[0]), parts), "repeats-cut", compression="zstd")
    distinct = _distinct(cut, F.sum("copies"), length)
    sizes = materialise(distinct.groupBy("print").agg(F.count(F.lit(1)).alias("members")), "repeats-sizes")
    finer = _resolved(materialise(spread_join(distinct, sizes, ["print"], "members", F.col("h"), "inner"), "repeats-finer", compression="zstd"), length, widths[1:])
    weighed = materialise(finer.join(cut.groupBy("print", "h").agg(F.count(F.lit(1)).alias("copies")), ["print", "h"]), "repeats-runs")
    back = spread_join(cut.select("of_print", "of_h", "shift", "print", "h"), weighed, ["print", "h"], "copies", F.struct("of_print", "of_h", "shift"), "inner")
    moved = F.transform("runs", lambda r: F.struct((r["begin"] + F.col("shift")).alias("begin"), (r["end"] + F.col("shift")).alias("end")))
    return marked.union(back.groupBy(F.col("of_print").alias("print"), F.col("of_h").alias("h")).agg(F.flatten(F.collect_list(moved)).alias("runs")))


def _distinct(contexts: DataFrame, copies: Column, length: int) -> DataFrame:
    firsts = [F.first(c).alias(c) for c in ("bytes", "n", "anchor", "members") if c in contexts.columns]
    return materialise(contexts.groupBy("print", "h").agg(*firsts, copies.alias("copies")), f"repeats-contexts-{length}", compression="zstd")


# --------------------------------------------------------------------------- operator


def repeated_strings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text_hash, begin, end): runs of the bytes of repeated strings, of (doc_id, text, text_hash).  A row for each
    context; those of neighbouring contexts may touch or overlap."""
    found = materialise(docs.mapInArrow(_anchored(length), f"{_ddl(docs, *_OF)}, begin long, n int, anchor int, print long"), "repeats-anchors")
    several = materialise(found.groupBy("print").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "repeats-prints")
    met = spread_join(found, several, ["print"], "members", F.struct("doc_id", "begin"), "inner")
    per = met.groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(F.collect_set(F.struct("begin", "n", "anchor", "print", "members")).alias("anchors"))
    texts = docs.join(per, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))).select(*_OF, "text", "anchors")
    schema = f"{_ddl(docs, *_OF)}, begin long, n int, anchor int, print long, members long, h binary, bytes binary"
    contexts = materialise(texts.mapInArrow(_contexts(length), schema), "repeats-of", compression="zstd")
    distinct = _distinct(contexts, F.count(F.lit(1)), length)
    runs = _resolved(distinct, length, (max(1, length // 9), 1)).filter(F.size("runs") > 0)
    weighed = materialise(runs.join(distinct.select("print", "h", "copies"), ["print", "h"]), "repeats-marks")
    of = spread_join(contexts.select(*_OF, "begin", "print", "h"), weighed, ["print", "h"], "copies", F.struct("doc_id", "text_hash", "begin"), "inner")
    return of.select(*_OF, "begin", F.explode("runs").alias("run")).select(*_OF, (F.col("begin") + F.col("run.begin")).alias("begin"), (F.col("begin") + F.col("run.end") + length - 1).alias("end"))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans, which are merged where they touch."""
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    for batch in slices(batches, "text"):
        spans, kept, sizes = [], [], []
        for i, runs in enumerate(batch.column("runs").to_pylist()):
            data = batch.column("text")[i].as_buffer()
            merged: list[dict] = []
            for run in sorted(runs or [], key=lambda r: r["begin"]):
                if merged and run["begin"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], run["end"])
                else:
                    merged.append(dict(run))
            edges = [0, *(x for s in merged for x in (s["begin"], s["end"])), data.size]
            kept.append(b"".join(data[a:b].to_pybytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
            spans.append(merged)
            sizes.append(data.size)
        columns = [batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(spans, span), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "kept", "spans", "n_bytes"])


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte that a string of ``length`` bytes covers which also begins elsewhere, in any document.

    Returns doc_id, kept (bytes: a cut may part a character), spans (array<struct<begin, end>>, in bytes of the text) and
    n_bytes; a row for each input row.

    * A null text is empty.  Texts of fewer bytes stay as they are.  Strings never cross documents, and are judged on the input:
      all places of a string go, the first too.  Places that overlap are places of their own.
    * Rows that repeat, null doc_ids too, are documents of their own, and so lose all they share.
    * Very long texts are looked at whole, in steps.  Other columns are ignored; an empty table gives an empty one.

    What is sorted is found first, without loss: the place of least hash within a string, its anchor, depends on the string
    alone, so only strings whose anchor's print stands in two places can be repeated.  The bytes around those anchors, each
    distinct context once, are partitioned by print; a task sorts them by the difference cover's suffix array, pieces of about
    half a million letters at a time, and compares the first bytes of neighbours.  An anchor of more than MOST contexts is told
    apart by what its strings have in common, by 44 strings, then by each, so that no group grows with the corpus.
    """
    d = documents(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    runs = repeated_strings(d, length).groupBy(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash")).agg(F.collect_set(F.struct("begin", "end")).alias("runs"))
    joined = d.join(runs, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash")), "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(_removed, f"{_ddl(d, 'doc_id')}, kept binary, spans array<struct<begin:bigint,end:bigint>>, n_bytes long")


def _ddl(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*columns).schema)

"""MinHash near-dedup by bottom-k sketches of one hash function."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import documents, give_back, materialise, slices, spread_join, starts, strings
from leafmill.llm.graph import components
from leafmill.llm.shingles import mix64, shingle_sets

#: Retained values of a text, and how many of them two linked texts share at least.  At a similarity of 0.8 the number they
#: share has a mean of 25.6 and a standard deviation of 2.3; 12 or fewer come up in under one of 100,000 such pairs.
RETAINED, SHARED = 32, 13
#: Cells of the tables that go to all tasks, a byte each: as many as the entries need, between these bounds.
CELLS, MOST_CELLS = 1 << 20, 1 << 26
HEAVY_CELL = 16
#: A block of texts that are compared within one task.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 1 << 18


def least_shared(n: np.ndarray, retained: int = RETAINED, percent: int = 80) -> np.ndarray:
    """Retained values that a text of n shingles shares with each text linked to it: exact where both texts surely fit into
    their sketches, otherwise SHARED of 32 (in proportion for other sizes)."""
    whole = -(-n * percent // 100)
    return np.where(100 * n <= percent * retained, whole, np.minimum(whole, retained * SHARED // RETAINED))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, id1, id2, sketch): number of shingles, 128 bits that tell sets apart, and the smallest hashes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            key, counts = shingle_sets(strings(batch.column("text")), size)
            at = starts(counts)
            kept = np.arange(len(key)) - np.repeat(at[:-1], counts) < RETAINED
            ids = []
            for salt in (np.uint64(0x1234567), np.uint64(0x89ABCDEF)):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(key ^ salt), dtype=np.uint64)])
                ids.append(pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)))
            lists = pa.ListArray.from_arrays(pa.array(starts(np.minimum(counts, RETAINED)), pa.int32()), pa.array(key[kept].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts.astype(np.int64)), *ids, lists], ["doc_id", "n", "id1", "id2", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(sketch, f"doc_id {kind}, n long, id1 long, id2 long, sketch array<long>")


def _cells(wanted: int) -> int:
    """A power of two of cells, ``wanted`` at least within the bounds."""
    return min(max(CELLS, 1 << (wanted - 1).bit_length()), MOST_CELLS)


def _frequencies(reps: DataFrame) -> np.ndarray:
    """How often the retained values of each cell stand in all sketches: 0 under HEAVY_CELL, from there on a 16th of a power of
    two a step.  Four cells a text, so a cell holds eight values on average at any size of the corpus up to MOST_CELLS."""
    cells = _cells(4 * reps.count())
    counts = reps.select(F.explode("sketch").alias("v")).groupBy(F.pmod("v", F.lit(cells)).alias("cell")).agg(F.count(F.lit(1)).alias("n"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = np.minimum(1 + 16 * np.log2(np.asarray(batch.column("n")) / HEAVY_CELL), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(batch.column("cell")).astype(np.int32).tobytes()]), pa.array([step.tobytes()])], ["cell", "step"])

    out = np.zeros(cells, np.uint8)
    for r in counts.filter(F.col("n") >= HEAVY_CELL).mapInArrow(packed, "cell binary, step binary").collect():
        out[np.frombuffer(r["cell"], np.int32)] = np.frombuffer(r["step"], np.uint8)
    return out


def _entries(reps: DataFrame, percent: int) -> DataFrame:
    """(value, rep): the inverted lists, of each text's rarest retained values.

    Two linked texts share c retained values, so of any common order of values, the first s - c + 1 of each text's s have one
    in common.  The order is by frequency, so that passages which many texts share make lists only for texts that hold
    little else.  Frequencies are those of a table of hashed cells that grows with the texts; any order is right, a rough one
    only makes longer lists.
    """
    sent = reps.sparkSession.sparkContext.broadcast(_frequencies(reps))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("sketch")
            values = np.asarray(lists.flatten()).astype(np.int64)
            counts = np.diff(np.asarray(lists.offsets).astype(np.int64))
            row = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((values, sent.value[values % len(sent.value)], row))
            place = np.arange(len(values)) - np.repeat(starts(counts)[:-1], counts)
            first = counts - least_shared(np.asarray(batch.column("n")), percent=percent) + 1
            kept = place < np.repeat(first, counts)
            yield pa.RecordBatch.from_arrays([pa.array(values[order][kept]), batch.column("rep").take(pa.array(row[kept]))], ["value", "rep"])

    return reps.select("rep", "n", "sketch").mapInArrow(rarest, "value long, rep long")


def _lists(entries: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(cluster, rep, n, hashes): the inverted lists of two texts or more, with the texts' sketches; a cluster is a list.

    Of lists that hold the same texts, one is enough.  A list of more texts than a block is parted by their numbers of shingles:
    linked texts fall into one band or into neighbours, so each text goes to its band's part and to the next one's.
    """
    hashes = [F.bit_xor(F.xxhash64("rep")).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(1), "rep"), 32)).alias("y")]
    sizes = entries.groupBy("value").agg(F.count(F.lit(1)).alias("texts"), *hashes).filter("texts > 1")
    kept = materialise(sizes.groupBy("texts", "x", "y").agg(F.min("value").alias("value")).select("value", "texts"), "near-kept")
    listed = spread_join(entries, kept, ["value"], "texts", F.col("rep"), "inner")
    band = F.floor(F.log("n") / math.log(101 / percent))
    bands = F.when(F.col("texts") > BLOCK_TEXTS, F.array(band, band + 1)).otherwise(F.array(F.lit(-1).cast("long")))
    held = listed.join(reps.select("rep", "n", F.col("sketch").alias("hashes")), "rep")
    return held.withColumn("band", F.explode(bands)).select(F.xxhash64("value", "band").alias("cluster"), "rep", "n", "hashes")


# --------------------------------------------------------------------------- exact comparison of a block


def _overlaps(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For all pairs of sets, how many members they share: a product of 0/1 matrices, a few thousand members at a time."""
    n = len(counts)
    row = np.repeat(np.arange(n), counts)
    _, member, times = np.unique(keys, return_inverse=True, return_counts=True)
    shared = times[member] > 1
    row, member = row[shared], member[shared]
    _, member = np.unique(member, return_inverse=True)
    out = np.zeros((n, n), np.float32)
    order = np.argsort(member, kind="stable")
    row, member = row[order], member[order]
    width = 2048
    for begin in range(0, int(member[-1]) + 1 if len(member) else 0, width):
        a, b = np.searchsorted(member, [begin, begin + width])
        used, local = np.unique(row[a:b], return_inverse=True)
        matrix = np.zeros((len(used), width), np.float32)
        matrix[local, member[a:b] - begin] = 1
        out[np.ix_(used, used)] += matrix @ matrix.T
    return out


def alike(cut: list[np.ndarray], n: np.ndarray, percent: int = 80) -> np.ndarray:
    """Which pairs of texts may be linked, by the values that their sketches share and their numbers of shingles n."""
    need = least_shared(n, percent=percent)
    near = _overlaps(np.concatenate(cut), np.array([len(s) for s in cut])) >= np.maximum(need[:, None], need[None, :])
    near &= (100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])) & (n > 0)[:, None]
    np.fill_diagonal(near, False)
    return near


def linked(sets: list[np.ndarray], percent: int = 80) -> np.ndarray:
    """Which pairs of sets (hashes, ascending as unsigned) have a Jaccard similarity of ``percent`` or more, as a matrix.  Only
    texts with a partner by the estimate are compared in full."""
    n = np.array([len(s) for s in sets])
    near = alike([s[:RETAINED] for s in sets], n, percent)
    out = np.zeros((len(n), len(n)), bool)
    some = np.flatnonzero(near.any(1))
    if len(some):
        inter = _overlaps(np.concatenate([sets[i] for i in some]), n[some]).astype(np.int64)
        union = n[some][:, None] + n[some][None, :] - inter
        out[np.ix_(some, some)] = near[np.ix_(some, some)] & (100 * inter >= percent * union)
    return out


def forest(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join the same nodes as the matrix does, one less than nodes in each component."""
    open_, out = np.ones(len(adjacent), bool), []
    for root in range(len(adjacent)):
        if not open_[root]:
            continue
        open_[root], todo = False, [root]
        while todo:
            found = np.flatnonzero(adjacent[todo.pop()] & open_)
            open_[found] = False
            todo += found.tolist()
            out += [(root, i) for i in found.tolist()]
    return out


def _block_links(rows: DataFrame, keys: list[str], percent: int, full: bool) -> DataFrame:
    """(a, b): links that join the linked texts of each block; rows are (*keys, rep, n, hashes), a block's rows in one task."""
    names = [*keys, "rep", "n"]
    dealt = rows.select(*names, "hashes").repartition(*keys).sortWithinPartitions(*names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, reps, sizes, sets = None, [], [], []
        give_back()

        def found():
            if len(reps) < 2:
                return None
            pairs = forest(linked(sets, percent) if full else alike(sets, np.array(sizes), percent))
            return pa.RecordBatch.from_arrays([pa.array([reps[i] for i, _ in pairs], pa.int64()), pa.array([reps[j] for _, j in pairs], pa.int64())], ["a", "b"])

        for batch in batches:
            lists = batch.column("hashes")
            flat, at = np.asarray(lists.flatten()), starts(np.diff(np.asarray(lists.offsets)))
            for i, (*key, rep, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in names), strict=True)):
                if key != block:
                    if (out := found()) is not None:
                        yield out
                    block, reps, sizes, sets = key, [], [], []
                reps.append(rep)
                sizes.append(n)
                sets.append(flat[at[i] : at[i + 1]].copy())
        if (out := found()) is not None:
            yield out

    return dealt.mapInArrow(compare, "a long, b long")


def _blocks(n: str, texts: str) -> Column:
    return F.greatest(F.ceil(F.col(n) / BLOCK_SHINGLES), F.ceil(F.col(texts) / BLOCK_TEXTS)).cast("long")


def _joined(rows: DataFrame, percent: int, full: bool, name: str) -> DataFrame:
    """(node, component) of the texts that are linked within a cluster; rows are (cluster, rep, n, hashes), written tables.

    A cluster is dealt into blocks.  First each block is compared within itself.  Then two texts of a cluster's largest
    component so far need no comparison; all others are its query set, dealt into blocks, each of which meets each block.
    The components so far take the place of the links that made them; where no text is left to ask, they are the result.
    """
    held = F.col("n") if full else F.least(F.col("n"), F.lit(RETAINED))
    per = rows.groupBy("cluster").agg(F.sum(held).alias("all"), F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("cluster", _blocks("all", "texts").alias("blocks"))
    placed = rows.join(per, "cluster").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    within = materialise(_block_links(placed, ["cluster", "block"], percent, full), f"near-{name}")
    large = materialise(placed.filter("blocks > 1").select("cluster", "block", "blocks", "rep", "n"), f"near-{name}-large")
    so_far = components(within, f"near-{name}-within")
    if not large.head(1):
        return so_far
    component = F.coalesce("component", "rep")
    marked = large.join(so_far, F.col("rep") == F.col("node"), "left").select("cluster", "rep", "n", component.alias("component"))
    sizes = marked.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("texts"))
    largest = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("texts", "component")).alias("largest"))
    minor = materialise(marked.join(largest, "cluster").filter("component <> largest").select("cluster", "rep", "n"), f"near-{name}-minor")
    if not minor.head(1):
        return so_far
    held = F.sum(held)
    asks = minor.groupBy("cluster").agg(held.alias("all"), F.count(F.lit(1)).alias("texts")).select("cluster", _blocks("all", "texts").alias("queries"))
    queries = minor.join(asks, "cluster").select("cluster", "rep", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("queries")).alias("query"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    big = rows.join(large.select("cluster", "rep", "block", "blocks").distinct(), ["cluster", "rep"])
    asking = big.join(queries, ["cluster", "rep"]).select("cluster", "query", each(F.col("blocks")).alias("block"), "rep", "n", "hashes")
    asked = big.join(asks, "cluster").select("cluster", each(F.col("queries")).alias("query"), "block", "rep", "n", "hashes")
    across = materialise(_block_links(asking.unionAll(asked), ["cluster", "query", "block"], percent, full), f"near-{name}-across")
    return components(so_far.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(across), f"near-{name}-joined")


def _member_cells(members: DataFrame) -> np.ndarray:
    """Marks the cells of the members' ids, eight cells a member within the bounds."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(batch.column("rep")).astype(np.int64).tobytes()])], ["reps"])

    found = [np.frombuffer(r["reps"], np.int64) for r in members.select("rep").mapInArrow(packed, "reps binary").collect()]
    cells = np.zeros(_cells(8 * sum(map(len, found))), bool)
    for reps in found:
        cells[reps % len(cells)] = True
    return cells


def _full_sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(cluster, rep, n, hashes): the members with all shingles of their texts.  Of the documents, only those go to the join
    whose ids fall into a cell with a member, so that texts of others are not shuffled; the cells grow with the members."""
    sent = docs.sparkSession.sparkContext.broadcast(_member_cells(members))

    def may_be(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(pc.fill_null(batch.column("rep"), 0)).astype(np.int64)
            yield batch.filter(pa.array(sent.value[ids % len(sent.value)]))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            key, counts = shingle_sets(strings(batch.column("text")), size)
            sets = pa.ListArray.from_arrays(pa.array(starts(counts), pa.int32()), pa.array(key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("rep"), pa.array(counts.astype(np.int64)), sets], ["cluster", "rep", "n", "hashes"])

    text = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").mapInArrow(may_be, "rep long, text string")
    return text.join(members, "rep").select("cluster", "rep", "text").mapInArrow(full, "cluster long, rep long, n long, hashes array<long>")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of texts whose sets of ``size``-word shingles have a Jaccard similarity of ``percent`` or more.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable, itself included), kept (doc_id = component_id); a row
    for each input row.

    * Words are lower-cased (A-Z); a text of fewer words is one shingle; a text without words, or null, links with nothing.
    * doc_ids are integers.  A null doc_id takes no part: its component_id is null, and it is kept.  Each row is linked by
      its own text; rows that repeat a doc_id with the same text have the same result.
    * Other columns are ignored; an empty table gives an empty one.

    How: equal sets are one text, by its smallest doc_id (its rep).  Two texts that may be linked meet in an inverted list of
    the reps' rarest retained values; sketches are compared within each list, and what the estimate links is joined to
    clusters; full sets are compared in those only.  Lists are not joined first: chance alone ties texts that are not alike
    to one cluster, of a growing share of the corpus.  Either comparison goes by blocks of bounded size (see _joined), so a
    large group of near copies costs a comparison within blocks and what that leaves over, not all its pairs; no pair is a
    row, and no link between different texts is lost but by an unlikely sketch (see SHARED).
    """
    d = documents(docs, id_col, text_col)
    drawn = materialise(sketches(d, size), "near-sketches")
    reps = materialise(
        drawn.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0)).groupBy("id1", "id2", "n").agg(F.min("doc_id").cast("long").alias("rep"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")), "near-reps"
    )
    entries = materialise(_entries(reps, percent), "near-entries")
    cut = materialise(_lists(entries, reps, percent), "near-cut")
    finer = _joined(cut, percent, False, "estimates").select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    found = _joined(materialise(_full_sets(d, finer, size), "near-sets"), percent, True, "links")
    of_set = reps.select("id1", "id2", "n", "rep", "copies").join(found, F.col("rep") == F.col("node"), "left").select("id1", "id2", "n", "copies", F.coalesce("component", "rep").alias("component"))
    kind = d.schema["doc_id"].dataType
    rows = drawn.drop("sketch")
    own = (F.col("doc_id").isNull()) | (F.col("n") == 0)  # linked with nothing: they need no join
    joined = spread_join(rows.filter(~own), materialise(of_set, "near-of-set"), ["id1", "id2", "n"], "copies", F.col("doc_id"), "left")
    joined = joined.select("doc_id", "n", "component").unionByName(rows.filter(own).select("doc_id", "n", F.lit(None).cast("long").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.col("component"), F.col("doc_id")).cast(kind))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs (doc_id, text, any more) of one document of each component; see near_duplicates.  Rows that repeat a
    doc_id with the same text are one document, and all stay or go."""
    gone = near_duplicates(docs, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("component_id").alias("_gone_to")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone_id"], "left_anti")

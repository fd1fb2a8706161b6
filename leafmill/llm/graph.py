"""Connected components of a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from leafmill.llm.common import materialise

#: Edges that a task holds before it contracts them.
HELD_EDGES = 1 << 22


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) of all nodes of the edges (a, b); the component is its smallest node.

    Large stars and small stars in turn (Kiveris et al., 2014), the latter by tasks over all edges they have: each round hangs
    every node nearer to the smallest one it knows, until all edges point there.  No step makes the sum of all ends larger, and
    only stars leave it as it is.  The number of rounds grows with the logarithm of the longest path.  Each round is written to the shared
    folder; minima combine before they are shuffled.  All edges that point to one node meet in one task of the join with that
    node's minimum: the hub of a large star is not dealt out.
    """
    now, mark = _contracted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), name)
    while mark[0]:
        # A node's least neighbour, if that is smaller than itself, takes over all that hangs on the node.
        least = now.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        large = now.join(least, F.col("v") == F.col("x"), "left").select("u", F.coalesce("m", "v").alias("v"))
        before = mark
        now, mark = _contracted(large.repartition("u"), name)
        if before == mark:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same nodes as (u, v) do, each from a node to the smallest one of its component."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    to = np.arange(len(nodes))
    while True:
        x, y = to[a], to[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(further := to[to], to):
            to = further
    moved = to != np.arange(len(nodes))
    return nodes[moved], nodes[to[moved]]


def _contracted(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges (u, v) as a table, those of a task as stars, and a mark that tells two tables of edges apart, observed while they are written."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def contracted() -> tuple[np.ndarray, np.ndarray]:
            return stars(*(np.concatenate([pair[i] for pair in held]) for i in (0, 1)))

        most = HELD_EDGES
        for batch in batches:
            held.append(tuple(np.asarray(batch.column(c)).astype(np.int64) for c in ("u", "v")))
            n += len(batch)
            if n > most:
                held = [contracted()]
                n = len(held[0][0])
                most = max(HELD_EDGES, 2 * n)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in contracted()], ["u", "v"])

    seen = Observation()
    hashed = F.xxhash64("u", "v")
    some = edges.mapInArrow(contract, "u long, v long").observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(hashed).alias("x"), F.sum(F.shiftright(hashed, 32)).alias("y"))
    written = materialise(some, name)
    return written, (seen.get["n"], seen.get["x"], seen.get["y"])

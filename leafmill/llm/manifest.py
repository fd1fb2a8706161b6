"""Merkle manifest of a dataset: a digest for each row, a tree of fan-out 8 for each group, one root, and a proof for each row."""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.common import ascii_lower, materialise

FAN = 8
#: Levels of a tree that one task sweeps at once: a block has FAN ** LEVELS nodes at most.
LEVELS = 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PROOF = "array<struct<before:string,after:string>>"


def leaf(columns: list[Column]) -> Column:
    """SHA-256 of the columns as text: each its UTF-8 byte count, a colon and the value, or ``-`` where it is null."""
    said = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*(said(c) for c in columns)), 256)


# --------------------------------------------------------------------------- one block, by time-forward processing


def _levels(n: int) -> int:
    """Levels above n nodes until one is left, LEVELS at most."""
    up = 0
    while n > 1 and up < LEVELS:
        n, up = -(-n // FAN), up + 1
    return up


def sweep(digests: list[str], up: int) -> list[list[str]]:
    """All digests of a block by level, the given ones first.

    Nodes are labelled (level, place).  A priority queue ordered by label holds the digests that children have sent: the next
    node takes all messages of its label, and sends its own digest on to its parent, whose label is larger.
    """
    made: list[list[str]] = [list(digests)] + [[] for _ in range(up)]
    queue = [(1, i // FAN, i % FAN, d) for i, d in enumerate(digests)] if up else []  # in label order: a heap as it is
    while queue:
        level, place = queue[0][:2]
        children = []
        while queue and queue[0][:2] == (level, place):
            children.append(heapq.heappop(queue)[3])
        digest = hashlib.sha256("".join(children).encode()).hexdigest()
        made[level].append(digest)
        if level < up:
            heapq.heappush(queue, (level + 1, place // FAN, place % FAN, digest))
    return made


def proofs(made: list[list[str]], suffix: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The proof of each node of the block's lowest level: what stands before and after it in its run, level by level, then the
    block's own suffix.  The sweep is reversed: labels fall, and a node hands its suffix and its children's siblings down."""
    found: list[list[tuple[str, str]]] = [[] for _ in made[0]]
    top = len(made) - 1
    queue = [(-top, -i, suffix) for i in range(len(made[top]))]
    heapq.heapify(queue)
    while queue:
        level, place, rest = heapq.heappop(queue)
        level, place = -level, -place
        if level == 0:
            found[place] = rest
            continue
        run = made[level - 1][place * FAN : (place + 1) * FAN]
        for k in range(len(run)):
            heapq.heappush(queue, (1 - level, -(place * FAN + k), [("".join(run[:k]), "".join(run[k + 1 :])), *rest]))
    return found


def _up(block: pa.Table) -> pa.Table:
    """A block's root, as a node of the next round."""
    block = block.sort_by("idx")
    n = block["n"][0].as_py()
    last = sweep(block["digest"].to_pylist(), _levels(n))[-1]
    row = {"key": block["key"][0].as_py(), "idx": block["block"][0].as_py(), "n": -(-n // BLOCK), "digest": last[0]}
    return pa.Table.from_pylist([row], pa.schema([("key", pa.string()), ("idx", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]))


def _down(block: pa.Table) -> pa.Table:
    """A block's nodes with their proofs; the block's own message (idx is null) tells it the suffix and the roots."""
    block = block.sort_by([("idx", "ascending")])  # nulls are last
    message = block.slice(block.num_rows - 1).to_pylist()[0]
    nodes = block.slice(0, block.num_rows - 1)
    suffix = [(s["before"], s["after"]) for s in message["proof"]]
    found = proofs(sweep(nodes["digest"].to_pylist(), _levels(nodes["n"][0].as_py())), suffix)
    said = pa.array([[{"before": b, "after": a} for b, a in p] for p in found], block.schema.field("proof").type)
    for name, values in (("proof", said), ("subroot", pa.array([message["subroot"]] * len(nodes), pa.string())), ("root", pa.array([message["root"]] * len(nodes), pa.string()))):
        nodes = nodes.set_column(nodes.schema.get_field_index(name), block.schema.field(name), values)
    return nodes


# --------------------------------------------------------------------------- rounds of blocks


def ranked(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows, written, with idx (their place within the key, from 0) and n (rows of the key).

    Rows are range-partitioned and sorted; a place is the row's place in its partition, from the key's first there, and the
    sizes of what earlier partitions hold of the key.  So a key of a third of all rows is many tasks' work.
    """
    placed = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialise(placed, f"{name}-placed").withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(key)
    before = F.coalesce(F.sum("_n").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(key, "_part", "_first", before.alias("_before"), F.sum("_n").over(over).alias("n"))
    found = placed.join(parts, [key, "_part"]).withColumn("idx", F.col("_at") - F.col("_first") + F.col("_before"))
    return materialise(found.drop("_at", "_part", "_first", "_before"), f"{name}-ranked")


def _climb(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The nodes of each round, as written tables: those given, then the roots of their blocks, until each key has one."""
    rounds = [nodes]
    while len(rounds) == 1 or (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        blocks = rounds[-1].select("key", "idx", "n", "digest", F.floor(F.col("idx") / BLOCK).alias("block"))
        above = blocks.groupBy("key", "block").applyInArrow(_up, "key string, idx long, n long, digest string")
        rounds.append(materialise(above, f"{name}-round-{len(rounds)}"))
    return rounds


def _descend(rounds: list[DataFrame], messages: DataFrame, name: str) -> DataFrame:
    """The first round's nodes with proof, subroot and root; ``messages`` has those of each key's last node, by (key, idx)."""
    for i in range(len(rounds) - 2, -1, -1):
        nodes = rounds[i].withColumn("block", F.floor(F.col("idx") / BLOCK))
        nodes = nodes.withColumns({"proof": F.lit(None).cast(_PROOF), "subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string")})
        told = messages.select("key", F.col("idx").alias("block"), "proof", "subroot", "root")
        both = nodes.unionByName(told, allowMissingColumns=True)
        down = both.groupBy("key", "block").applyInArrow(_down, both.schema).drop("block")
        messages = down if i == 0 else materialise(down, f"{name}-down-{i}")
    return messages


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", also: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, leaf, proof, subroot, root (and the columns of ``also``) for each row.

    A row's leaf is the digest of the fields.  Within a group, leaves ascend by id; eight at a time become their digest, until
    one is left, the subroot; subroots, ordered by group, become the root likewise.  ``proof`` says for each level what digests
    stand before and after the row's own.

    * Nulls: a field is ``-``, an id comes first, a group is a group of its own that comes first.  Empty texts are values.
    * Rows of one id are ordered by their leaves, so repeated rows have leaves of their own that are equal.
    * Very long texts are hashed where they are read, and go no further.  Other columns, clashing names too, are ignored.  An
      empty table gives an empty one.

    Rounds: a task sweeps blocks of 512 nodes, whose roots are the nodes of the next round.  Messages between rounds are
    written and brought into label order by Spark's sort, so that they are the external part of the queue; memory is bounded
    by a block, and the number of rounds grows with the logarithm of the largest group.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    leaves = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), leaf([F.col(f) for f in fields]).alias("digest"), *(c.alias(k) for k, c in (also or {}).items()))
    leaves = ranked(materialise(leaves, "manifest-leaves"), "key", ["doc_id", "digest"], "manifest")
    rounds = _climb(leaves, "manifest")
    groups = rounds[-1].select(F.lit("").alias("key"), F.col("key").alias("lang_key"), "digest")
    tops = _climb(ranked(groups, "key", ["lang_key"], "manifest-groups"), "manifest-groups")
    root = tops[-1].select("key", "idx", F.array().cast(_PROOF).alias("proof"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    subroots = materialise(_descend(tops, root, "manifest-groups"), "manifest-subroots")
    told = subroots.select(F.col("lang_key").alias("key"), F.lit(0).cast("long").alias("idx"), "proof", F.col("digest").alias("subroot"), "root")
    return _descend(rounds, told, "manifest").select("doc_id", F.col("digest").alias("leaf"), "proof", "subroot", "root", *(also or {}))


def folded(leaf_digest: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf_digest, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def audit(docs: DataFrame) -> DataFrame:
    """manifest() of documents, with the roots that their leaves lead to after a third of the texts have been lower-cased:
    where 3 divides the crc32 of the doc_id (a null doc_id stays as it is)."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    low = leaf([ascii_lower(F.col("text")) if f == "text" else F.col(f) for f in FIELDS])
    found = manifest(docs, also={"_changed": F.when(changed, low)})
    return found.withColumn("folded_root", folded(F.coalesce("_changed", "leaf"), F.col("proof"))).withColumn("verified", F.col("folded_root") == F.col("root")).drop("_changed")


def digest(found: DataFrame) -> DataFrame:
    """Proofs of audit() as digests: their siblings, level by level, from left to right."""
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), "")
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")

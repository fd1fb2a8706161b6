"""Revision chains, overlays and trees."""

from __future__ import annotations

import contextlib
import uuid

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CalendarIntervalType, DataType, MapType, NullType, StructType

#: Spark's setting by which a query's shuffles go when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """A cut in the lineage: written as Parquet in the folder that spark.checkpoint.dir names (below the warehouse where that is unset)
    and read back.

    So the planner sees a table's real size.  ``DataFrame.checkpoint`` hands on an estimate, which for a join is the product of both sides':
    a number whose digits double with each round that joins a table with itself, until the driver's memory holds nothing
    else.  Only types that Parquet can't hold go that way.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or f"{df.sparkSession.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    if not df.columns or not _storable(df.schema):
        return df.checkpoint()
    path = f"{context.getCheckpointDir().rstrip('/')}/table-{uuid.uuid4().hex}"
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    # The shuffles that made the table are of no use once it is written; Spark would keep their files until the driver collects garbage.
    conf = df.sparkSession.conf
    was = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        plain.write.parquet(path, compression="zstd")
    finally:
        conf.unset(_CLEANUP) if was is None else conf.set(_CLEANUP, was)
    out = df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    out._written = path
    return out


def _storable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return bool(kind.fields) and all(_storable(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _storable(kind.elementType)
    return _storable(kind.keyType) and _storable(kind.valueType) if isinstance(kind, MapType) else not isinstance(kind, NullType | CalendarIntervalType)


def gone(df: DataFrame) -> None:
    """The files of a table that ``checkpointed`` has written go; no other table may be read from them any more.  In stores that pyarrow
    doesn't reach they stay, as all others do, until the folder goes."""
    path = getattr(df, "_written", None)
    with contextlib.suppress(OSError, pa.ArrowException):
        if path:
            system, at = fs.FileSystem.from_uri(path)
            system.delete_dir(at)


def next_round(df: DataFrame, before: DataFrame) -> DataFrame:
    """``checkpointed``, for a table that takes the place of another, whose files go: so rounds don't add up on disk."""
    out = checkpointed(df)
    gone(before)
    return out


def newest(rows: DataFrame, keys: list[str], *newest_first) -> DataFrame:
    """Of each key's rows, the first in the given order: an overlay of revisions, or keep-last."""
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of each key's rows, the last in the order of the columns: as ``newest``, with map-side combining, so that a key of very many
    rows costs a row for each task."""
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row"))
    return found.select(*(F.col(f"_row.{c}").alias(c) for c in rows.columns))


def first_in_ancestry(chain: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """(revision, object, value, depth): the value that the nearest ancestor declares.

    chain: (revision, ancestor, depth), the revision itself at 0; values: (revision, object, value).
    """
    found = chain.join(values.withColumnRenamed("revision", "ancestor"), "ancestor").filter(F.col(value).isNotNull())
    return found.groupBy("revision", "object").agg(F.min_by(value, "depth").alias(value), F.min("depth").alias("depth"))


def nearest_declared(edges: DataFrame, node: str, parent: str, value: str) -> DataFrame:
    """(revision, value, depth) of the nearest ancestor with a value, the node itself at 0; nodes without any are left out.

    One row a node: a node with a value is done; others point to a parent, and in each round to where that one points, or take
    its value.  A chain of n takes log2(n) rounds, however long; a node that still points after them is in a cycle without
    values or leads to one, and has none.  Parents that are missing end the walk.  Nodes are unique.
    """
    has = F.col(value).isNotNull()
    first = edges.select(F.col(node).alias("revision"), F.col(value).alias(value), F.when(~has, F.col(parent)).alias("_to"), F.when(has, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("depth"))
    known = checkpointed(first)
    open_rows = known.filter("_to IS NOT NULL").count()
    for _ in range(max(1, known.count()).bit_length() + 1):
        if not open_rows:
            break
        on = known.select(F.col("revision").alias("_at"), F.col(value).alias("_value"), F.col("_to").alias("_next"), F.col("depth").alias("_more"))
        open_ = known.filter("_to IS NOT NULL").join(on, F.col("_to") == F.col("_at"), "left")
        moved = open_.select("revision", F.col("_value").alias(value), F.col("_next").alias("_to"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"))
        known = next_round(known.filter("_to IS NULL").unionByName(moved), known)
        open_rows, before = known.filter("_to IS NOT NULL").count(), open_rows
        # Nodes that end take all distances up to the longest, so a round that finishes none leaves cycles alone.
        if open_rows == before:
            break
    return known.filter(has).select("revision", value, "depth")


def ancestry(spark: SparkSession, edges: DataFrame, node: str, parent: str, most: int | None = None) -> DataFrame:
    """(revision, ancestor, depth) of all nodes, by doubling: each round joins what is known of a node with what is known of
    its farthest ancestor, so a chain of n takes log2(n) joins.  All ancestors up to ``most`` steps away (by default as many
    as there are nodes, which ends cycles) are rows: for the nearest value alone, nearest_declared is the way."""
    if most is None:
        most = max(1, edges.count() - 1)
    known = edges.select(F.col(node).alias("revision"), F.col(node).alias("ancestor"), F.lit(0).alias("depth"))
    jump = edges.filter(F.col(parent).isNotNull()).select(F.col(node).alias("from"), F.col(parent).alias("to"))
    reach = 1
    while reach <= most:
        more = known.join(jump, F.col("ancestor") == F.col("from")).filter(F.col("depth") + reach <= most)
        known = checkpointed(known.unionAll(more.select("revision", F.col("to").alias("ancestor"), (F.col("depth") + reach).alias("depth"))))
        far = jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.from")).select(F.col("a.from").alias("from"), F.col("b.to").alias("to"))
        jump, reach = checkpointed(far), reach * 2
        if not jump.head(1):
            break
    return known


def chain_depth(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``depth`` and ``previous`` of each row in a chain that its order states, without any walk."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("depth", (F.row_number().over(w) - 1).cast("long")).withColumn("previous", F.lag(order[-1]).over(w))


def tree_paths(spark: SparkSession, nodes: DataFrame, deepest: int | None = None) -> DataFrame:
    """(id, name, depth, path, shown) of all nodes below the roots: path orders them depth first, by position at each level.

    nodes: (id, parent, pos, name); roots have no parent.  One join a level, each level written, until one is empty or beyond
    ``deepest``.  Nodes in a cycle, or below a parent that is missing, hang on no root and are left out.
    """
    level = nodes.filter("parent IS NULL").select("id", "name", F.lit(0).alias("depth"), F.lpad(F.col("pos").cast("string"), 10, "0").alias("path"), F.col("name").alias("shown"))
    out, depth = level, 0
    while (deepest is None or depth < deepest) and level.head(1):
        depth += 1
        up = level.select(F.col("id").alias("up"), F.col("path").alias("up_path"), F.col("shown").alias("up_shown"))
        level = nodes.join(up, F.col("parent") == F.col("up")).select(
            "id",
            "name", F.lit(depth).alias("depth"), F.concat_ws("/", "up_path", F.lpad(F.col("pos").cast("string"), 10, "0")).alias("path"), F.concat_ws(" › ", "up_shown", "name").alias("shown"),
        )
        level = checkpointed(level)
        out = out.unionAll(level)
    return out


def folded_offsets(nodes: DataFrame, deepest: int | None = None) -> DataFrame:
    """(id, root, depth, dx, dy): the container at the top, the steps to it, and the sums of the offsets of a container and of all
    above it but the top, whose own offset places the whole.

    nodes: (id, parent, x, y), a row each; a null offset is 0, and a parent that is missing is none.  Pointers double, with one row a
    node; containers in a cycle, or below one, or more than ``deepest`` steps down, are left out.
    """
    ids = nodes.select(F.col("id").alias("_up"))
    first = nodes.join(ids, F.col("parent") == F.col("_up"), "left")
    inner = F.col("_up").isNotNull()
    offset = lambda c: F.when(inner, F.coalesce(F.col(c).cast("double"), F.lit(0.0))).otherwise(F.lit(0.0))
    known = checkpointed(first.select("id", F.coalesce("_up", "id").alias("to"), inner.alias("open"), inner.cast("long").alias("depth"), offset("x").alias("dx"), offset("y").alias("dy")))
    open_rows = known.filter("open").count()
    for _ in range(max(1, known.count()).bit_length() + 1):
        if not open_rows:
            break
        on = known.select(F.col("id").alias("_at"), F.col("to").alias("_to"), F.col("open").alias("_open"), *(F.col(c).alias(f"_{c}") for c in ("depth", "dx", "dy")))
        moved = known.filter("open").join(on, F.col("to") == F.col("_at"))
        moved = moved.select("id", F.col("_to").alias("to"), F.col("_open").alias("open"), *((F.col(c) + F.col(f"_{c}")).alias(c) for c in ("depth", "dx", "dy")))
        known = next_round(known.filter("NOT open").unionByName(moved), known)
        open_rows, before = known.filter("open").count(), open_rows
        # Containers that end take all distances up to the longest, so a round that finishes none leaves cycles alone.
        if open_rows == before:
            break
    done = known.filter("NOT open").select("id", F.col("to").alias("root"), "depth", "dx", "dy")
    return done if deepest is None else done.filter(F.col("depth") <= deepest)

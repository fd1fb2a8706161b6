"""Texts of any size in pieces: ordered lines of a group as parts of bounded size, none of which needs the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.graph import checkpointed

#: Bytes of a piece, about.
MOST = 64 << 20


def running_totals(rows: DataFrame, keys: list[str], order: list[str], weight: Column, name: str) -> DataFrame:
    """``name``: the sum of ``weight`` over the keys' rows before, in the order; ``name``_all: over all of them.

    Rows are range-partitioned by keys and order: a group of very many rows is many tasks' work.  Within a partition a window
    sums; across partitions, one number for each of a group's partitions.  A null weight counts nothing; keys may be null.
    """
    ordered = rows.withColumn("_weight", F.coalesce(weight.cast("long"), F.lit(0))).repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    ordered = checkpointed(ordered.withColumn("_key", F.struct(*keys, "_part")))
    parts = ordered.groupBy("_key").agg(F.sum("_weight").alias("_sum"))
    over = Window.partitionBy(*(f"_key.{k}" for k in keys))
    parts = parts.select("_key", F.coalesce(F.sum("_sum").over(over.orderBy("_key._part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_sum").over(over).alias(f"{name}_all"))
    inside = F.coalesce(F.sum("_weight").over(Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ordered.withColumn("_inside", inside).join(parts, "_key").withColumn(name, F.col("_before") + F.col("_inside")).drop("_weight", "_part", "_key", "_inside", "_before")


def pieces(lines: DataFrame, group: list[str], order: str, line: Column, between: str = "\n", head: str = "", tail: str = "", most: int = MOST) -> DataFrame:
    """(group, piece, lines, bytes, text): a group's lines in order, cut into pieces that begin every ``most`` bytes or so.

    Pieces put one after the other are the whole: the head, the lines with ``between`` them, the tail; a piece holds what it needs
    of its edges.  A piece is under ``most`` bytes and a line more, so no group need fit into one string or one task.  Numbers
    rise but may be missing, where one line is longer than a piece.  A null line is empty; order ties go by the line.
    """
    e = lines.select(*group, order, F.coalesce(line, F.lit("")).alias("_line"))
    e = running_totals(e, group, [order, "_line"], F.octet_length("_line") + max(1, len(between.encode())), "_at")
    own = F.octet_length("_line") + max(1, len(between.encode()))
    first, last = F.col("_at") == 0, F.col("_at") + own == F.col("_at_all")
    edge = lambda c, a, b: F.when(c, F.lit(a)).otherwise(F.lit(b))
    said = F.concat(edge(first, head, between), "_line", edge(last, tail, ""))
    e = e.withColumn("piece", F.floor(F.col("_at") / most)).withColumn("_said", said)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_at", "_said"))), lambda x: x["_said"])
    out = e.groupBy(*group, "piece").agg(F.count(F.lit(1)).alias("lines"), F.array_join(texts, "").alias("text"))
    return out.select(*group, "piece", "lines", F.octet_length("text").alias("bytes"), "text")


def piece_paths(pieces_: DataFrame, stem: Column, ending: str) -> DataFrame:
    """(path, text) for ``export.write``: files of a group whose names, sorted, are in the order of its pieces."""
    return pieces_.select(F.concat(stem, F.lit("."), F.lpad(F.col("piece").cast("string"), 8, "0"), F.lit(ending)).alias("path"), "text")

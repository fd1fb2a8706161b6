"""Operators whose rows depend on their neighbours: navigation, numbering, runs, unique names.

Every table carries its order in a column.  Groups are window partitions: a window sorts a group's rows in one task and holds
them there, spilling where they are many.  Where that would not do, ``ranks_within`` ranks by partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leafmill.functions import text
from leafmill.operators.graph import checkpointed


def navigation(pages: DataFrame, section: str, order: str, *columns: str) -> DataFrame:
    """The columns' values on the page before and after, as prev_* and next_*."""
    w = Window.partitionBy(section).orderBy(order)
    return pages.withColumns({f"{at}_{c}": f(c).over(w) for c in columns for at, f in (("prev", F.lag), ("next", F.lead))})


def parent_page(pages: DataFrame, section: str, order: str, level: str) -> DataFrame:
    """``parent``: the order value of the latest page one level up that no page of a lower level has followed since; null for
    level 0, where a level was skipped, and where the level is null (such a page is no page's parent).

    That page, if any, is the last one before of a lower level.  Rows stream through, sorted, and a stack holds one page for
    each level that is open, whatever levels there are.
    """

    def stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []
        for batch in batches:
            parents = []
            for g, o, k in zip(*(batch.column(c).to_pylist() for c in (section, order, level)), strict=True):
                if (g,) != at:
                    at, stack = (g,), []
                if k is None:
                    parents.append(None)
                    continue
                while stack and stack[-1][0] >= k:
                    stack.pop()
                parents.append(stack[-1][1] if stack and stack[-1][0] == k - 1 else None)
                stack.append((k, o))
            yield batch.append_column("parent", pa.array(parents, batch.column(order).type))

    schema = StructType([*pages.schema.fields, StructField("parent", pages.schema[order].dataType)])
    return pages.repartition(section).sortWithinPartitions(section, order).mapInArrow(stacked, schema)


def ranks_within(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``name``: how many of the keys' rows come before, in the order.  Rows are range-partitioned by both, so that a key of very
    many rows is many tasks' work; only counts of partitions are windowed."""
    placed = checkpointed(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_key", F.struct(*keys, "_part"))
    parts = placed.groupBy("_key").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*(f"_key.{k}" for k in keys)).orderBy("_key._part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_key", "_from", before.alias("_before"))
    return placed.join(parts, "_key").withColumn(name, F.col("_at") - F.col("_from") + F.col("_before")).drop("_at", "_part", "_key", "_from", "_before")


def islands(rows: DataFrame, group: str, order: str, starts: Column, name: str = "island") -> DataFrame:
    """Number of the run that each row is in; ``starts`` says which rows begin one."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def changed(group: str, order: str, *keys: str) -> Column:
    """True for a row that differs in a key from the row before, and for the first."""
    w = Window.partitionBy(group).orderBy(order)
    first = F.row_number().over(w) == 1
    for k in keys:
        first = first | ~F.lag(k).over(w).eqNullSafe(F.col(k))
    return first


def list_numbers(elements: DataFrame, group: str, order: str, ordered: Column, restart: Column) -> DataFrame:
    """``number`` of each ordered element: consecutive ones count on; a run begins at its first row's restart, or 1; any other
    element ends it."""
    e = elements.withColumn("_ordered", ordered).withColumn("_restart", restart)
    e = islands(e, group, order, changed(group, order, "_ordered"), "_run")
    run = Window.partitionBy(group, "_run").orderBy(order)
    number = F.greatest(F.lit(1), F.coalesce(F.first("_restart").over(run), F.lit(1)) + F.row_number().over(run) - 1)
    return e.withColumn("number", F.when(F.col("_ordered"), number)).drop("_ordered", "_restart", "_run")


def merged_runs(rows: DataFrame, group: str, order: str, keys: list[str], joined: str, between: str = "") -> DataFrame:
    """Consecutive rows that agree on the keys as one, with their texts joined in order: (group, keys, first, last, parts, text)."""
    runs = islands(rows, group, order, changed(group, order, *keys), "_run")
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, joined))), lambda x: x[joined])
    return (
        runs.groupBy(group, "_run", *keys)
        .agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("parts"), F.array_join(texts, between).alias("text"))
        .drop("_run")
    )


def joined_lines(rows: DataFrame, group: list[str], order: str, line: Column, between: str = "\n", name: str = "text") -> DataFrame:
    """One string a group, of its lines in order."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return rows.groupBy(*group).agg(F.array_join(texts, between).alias(name))


def unique_names(rows: DataFrame, group: str, order: str, name: str, reserved: tuple[str, ...] = (), out: str = "unique_name", files: bool = False) -> DataFrame:
    """Names made unique within their group, in order: a name that is taken (ASCII case aside) gets `` (2)``, `` (3)`` and so on,
    whichever is free.  Reserved names are taken from the start.

    A name's numbered forms can only meet names of the same root, which is the name without such endings.  Roots whose names
    have no endings need a count alone; only the others go through Python, each root's rows in order, as Arrow batches, in
    which other columns stay what they are.  Numbers of a root are ranks by partitions, so one name of very many rows is no
    hot window.  A null name stays null and takes none.

    With ``files``, the number comes before the name's last ending, as ``-2``.
    """
    key = text.lower(F.col(name))
    end = F.regexp_extract(F.col(name), r"(?s)^.+(\.[^.]*)\z", 1) if files else F.lit("")
    stem = F.left(F.col(name), F.char_length(name) - F.char_length(end))
    open_, close = ("-", "") if files else (" (", ")")
    root = F.concat(F.regexp_replace(text.lower(stem), r"(?:-[0-9]+)+\z" if files else r"(?: \([0-9]+\))+\z", ""), text.lower(end))
    taken = F.array(*(F.lit(r.lower()) for r in reserved)).cast("array<string>")
    named = rows.filter(F.col(name).isNotNull()).withColumn("_as_key", key).withColumn("_root", F.when(root == "", key).otherwise(root)).withColumn("_of", F.struct(group, "_root"))
    plain = named.groupBy("_of").agg(F.min(F.col("_as_key") == F.col("_root")).alias("_plain"))
    r = named.join(plain, "_of").drop("_of")
    ranked = ranks_within(r.filter("_plain"), [group, "_root"], [order], "_nth")
    nth = F.col("_nth") + F.when(F.array_contains(taken, F.col("_root")), 2).otherwise(1)
    simple = ranked.withColumn(out, F.when(nth == 1, F.col(name)).otherwise(F.concat(stem, F.lit(open_), nth.cast("string"), F.lit(close), end))).drop("_nth")
    unnamed = rows.filter(F.col(name).isNull()).withColumn(out, F.lit(None).cast("string"))

    def greedy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, used, next_ = None, set(), {}
        for rows in batches:
            names = []
            for g, root_, key_, name_ in zip(*(rows.column(c).to_pylist() for c in (group, "_root", "_as_key", name)), strict=True):
                if (g, root_) != at:
                    at, used, next_ = (g, root_), {x.lower() for x in reserved}, {}
                dot = name_.rfind(".") if files else -1
                stem_, end_ = (name_[:dot], name_[dot:]) if dot > 0 else (name_, "")
                candidate, i = name_, next_.get(key_, 2)
                while candidate.translate(_LOWER) in used:
                    candidate, i = f"{stem_}{open_}{i}{close}{end_}", i + 1
                next_[key_] = i
                used.add(candidate.translate(_LOWER))
                names.append(candidate)
            yield rows.append_column(out, pa.array(names, pa.string()))

    schema = StructType([*r.schema.fields, StructField(out, StringType())])
    hard = r.filter("NOT _plain").repartition(group, "_root").sortWithinPartitions(group, "_root", order).mapInArrow(greedy, schema)
    return simple.unionByName(hard).drop("_as_key", "_root", "_plain").unionByName(unnamed)


_LOWER = str.maketrans(text.UPPER, text.LOWER)


def reading_order(items: DataFrame, page: str, order: str, x: str = "x", y: str = "y") -> DataFrame:
    """``place`` from 1 on: by bands of a tenth of an inch (0.2 half-inches) and then from the left, where all of a page's items have a y; else as stored.
    Bands are taken in single precision."""
    placed = F.min(F.col(y).isNotNull()).over(Window.partitionBy(page))
    band = F.floor(F.col(y).cast("float") * F.lit(5.0).cast("float"))
    w = Window.partitionBy(page).orderBy(F.when(F.col("_placed"), band), F.when(F.col("_placed"), F.coalesce(F.col(x), F.lit(0))), order)
    return items.withColumn("_placed", placed).withColumn("place", F.row_number().over(w)).drop("_placed")


def nested_list_tags(rows: DataFrame, group: str, order: str, level: str) -> DataFrame:
    """``opens`` and ``closes``: how many lists begin before a row and end after it, from the levels of the row and the next."""
    w = Window.partitionBy(group).orderBy(order)
    opens = F.greatest(F.lit(0), F.col(level) - F.lag(level, 1, -1).over(w))
    closes = F.greatest(F.lit(0), F.col(level) - F.lead(level, 1, -1).over(w))
    return rows.withColumn("opens", opens).withColumn("closes", closes)


def running_sums(points: DataFrame, group: str, order: str, *columns: str) -> DataFrame:
    """Deltas to positions, in place."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumns({c: F.sum(F.col(c).cast("double")).over(w) for c in columns})

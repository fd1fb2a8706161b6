"""Planning of names and links: joins against tables of targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text


def wiki_targets(pages: DataFrame, stem: str, path: str) -> DataFrame:
    """``wiki``: the name alone where it is the only one of all (ASCII case aside), else the path.  Counted with map-side
    combining and joined back, so that a name of very many pages is no hot window."""
    counts = pages.groupBy(text.lower(F.col(stem)).alias("_key")).agg(F.count(F.lit(1)).alias("same_name"))
    marked = pages.withColumn("_key", text.lower(F.col(stem))).join(counts, "_key").drop("_key")
    return marked.withColumn("wiki", F.when(F.col("same_name") == 1, F.col(stem)).otherwise(F.col(path)))


def resolve(links: DataFrame, pages: DataFrame, sections: DataFrame, page: str, section: str, href: str) -> DataFrame:
    """``target``: of the page, else of the section's first page, else the address as it is.

    pages, sections: (key, target), a key's last row wins before they come here.  How they are joined is Spark's choice by size.
    """
    p, s = pages.select(F.col("key").alias("_p"), F.col("target").alias("_page_target")), sections.select(F.col("key").alias("_s"), F.col("target").alias("_section_target"))
    found = links.join(p, F.col(page) == F.col("_p"), "left").join(s, F.col(section) == F.col("_s"), "left")
    return found.withColumn("target", F.coalesce("_page_target", "_section_target", href)).drop("_p", "_s", "_page_target", "_section_target")


def toc_ordered(entries: DataFrame, toc: DataFrame, group: str, name: str, pos: str) -> DataFrame:
    """``place`` of each entry: those that the table of contents lists in its order, then the others by name.

    toc: (group, name, pos, color), of rows that name one entry the last wins.
    """
    key = text.lower(F.col(name))
    last = Window.partitionBy(group, "_key").orderBy(F.desc(pos))
    t = toc.withColumn("_key", key).withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(F.col(group).alias("_g"), F.col("_key").alias("_k"), F.col(pos).alias("_pos"), "color")
    found = entries.withColumn("_key", key).join(t, (F.col(group) == F.col("_g")) & (F.col("_key") == F.col("_k")), "left")
    w = Window.partitionBy(group).orderBy(F.col("_pos").isNull(), "_pos", "_key", name)
    return found.withColumn("place", F.row_number().over(w)).withColumn("listed", F.col("_pos").isNotNull()).drop("_key", "_g", "_k", "_pos")


def unresolved(references: DataFrame, targets: DataFrame, on: str) -> DataFrame:
    """References without a target."""
    return references.join(targets, on, "left_anti")


def first_seen(rows: DataFrame, group: str, order: str, key: Column, label: Column) -> DataFrame:
    """Distinct keys of a group in the order of their first row, with that row's label: (group, key, label, place)."""
    per = rows.groupBy(group, key.alias("key")).agg(F.min_by(label, order).alias("label"), F.min(order).alias("_first"))
    return per.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("_first"))).drop("_first")

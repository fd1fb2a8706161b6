"""Folders of notebook files as tables: discovery, order, tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators import trees
from leafmill.operators.links import toc_ordered

#: Fixed: folders and files of what is deleted, in lower case; the ending of section files; how deep folders are read.
DELETED, SECTION, DEEPEST = ("onenote_recyclebin", "onenote_deletedpages.one"), ".one", 16


def scan(spark: SparkSession, folder: str, suffix: str = "*") -> DataFrame:
    """(path, length, content) of all files below a folder.  Without the content column only the listing is read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", suffix).load(folder).select("path", "length", "content")


def entries(files: DataFrame, root: str, with_deleted: bool = False, ending: str = SECTION, deleted: tuple[str, ...] = DELETED) -> DataFrame:
    """(path, parts, dir, name, depth): the sections among the files; hidden folders, deleted sections and what is too deep go."""
    below = F.regexp_replace("path", rf"^.*?\Q{root.rstrip('/')}\E/", "")
    parts = F.split(below, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    hidden: Column = F.exists(folders, lambda p: p.startswith("."))
    gone = F.exists(parts, lambda p: text.lower(p).isin(*deleted)) & F.lit(not with_deleted)
    rows = files.withColumn("parts", parts).withColumn("dir", F.array_join(folders, "/")).withColumn("name", F.element_at(parts, -1)).withColumn("depth", F.size(folders))
    return rows.filter(text.lower(F.col("name")).endswith(ending) & ~hidden & ~gone & (F.col("depth") <= DEEPEST))


def ordered(found: DataFrame, toc: DataFrame) -> DataFrame:
    """Sections with their ``place`` in their folder: as its table of contents (dir, name, pos, color) has them, then by name."""
    return toc_ordered(found, toc, "dir", "name", "pos")


def largest_toc(toc: DataFrame) -> DataFrame:
    """Of several tables of contents of a folder, (dir, file, entry...), the rows of the one with most entries; of equals the first by name."""
    sizes = toc.groupBy("dir", "file").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy("dir").agg(F.min_by("file", F.struct(-F.col("n"), text.lower(F.col("file")), "file")).alias("file"))
    return toc.join(best, ["dir", "file"], "left_semi")


def loaded(found: DataFrame, toc: DataFrame, color: str | None = None) -> DataFrame:
    """A notebook as its folders load: (kind, dir, name, title, path, depth, order, place, color) of sections and groups.

    found: sections, as ``entries`` gives them (with ``color``, if that column is named); toc: (dir, name, pos, color), one table of
    contents a folder (``largest_toc``), of sections and groups.  A group is there if a section is left below it at any depth, so one that holds
    nothing, or only what is deleted, goes.  In a folder, what its contents list comes first, in their order, then the rest by
    name (ASCII case aside).  ``order`` is the place in the folder, ``place`` the place in the whole notebook, a group before what it
    holds.  A section without a colour has that of its last entry in the contents; the recycle bin has a plain title.

    Names are compared without ASCII case; a null dir is the top.  A folder of any size is ordered by its own rows, and the
    whole by pointers that double, whatever the depth.
    """
    top = F.coalesce("dir", F.lit(""))
    own = F.col(color) if color else F.lit(None).cast("string")
    sections = found.select(F.lit("section").alias("kind"), top.alias("dir"), "name", "path", own.alias("color"))
    parts = F.split(top, "/")
    each = found.select(top.alias("dir")).distinct().filter("dir <> ''").select(parts.alias("p"), F.explode(F.sequence(F.lit(1), F.size(parts))).alias("n"))
    groups = each.select(F.lit("group").alias("kind"), F.array_join(F.slice("p", F.lit(1), F.col("n") - 1), "/").alias("dir"), F.get("p", F.col("n") - 1).alias("name")).distinct()
    items = sections.unionByName(groups.withColumns({"path": F.lit(None).cast("string"), "color": F.lit(None).cast("string")}))
    listed = toc.groupBy(F.coalesce("dir", F.lit("")).alias("dir"), text.lower(F.col("name")).alias("_low")).agg(F.min("pos").alias("_pos"), F.max_by("color", "pos").alias("_color"))
    items = items.withColumn("_low", text.lower(F.col("name"))).join(listed, ["dir", "_low"], "left")
    items = items.withColumn("color", F.when(F.col("kind") == "section", F.coalesce("color", "_color")))
    order = F.row_number().over(Window.partitionBy("dir").orderBy(F.col("_pos").asc_nulls_last(), "_low", "name", "kind"))
    items = items.withColumn("order", order)
    whole = F.concat("dir", F.when(F.col("dir") == "", "").otherwise("/"), "name")
    refs = items.withColumns({"id": F.concat(F.substring("kind", 1, 1), F.lit(":"), whole), "parent": F.concat(F.lit("g:"), "dir"), "pos": F.col("order")})
    spark = found.sparkSession
    root = spark.createDataFrame([("g:", None, 0)], "id string, parent string, pos int")
    t = trees.toured(refs.unionByName(root, allowMissingColumns=True)).filter("depth > 0")
    title = F.when((F.col("kind") == "group") & (F.col("_low") == DELETED[0]), "Recycle Bin").otherwise(F.col("name"))
    return t.select("kind", "dir", "name", title.alias("title"), "path", (F.col("depth") - 1).alias("depth"), "order", "place", "color")

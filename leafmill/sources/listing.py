"""Files inside archives, as tables of (archive, path): folders, roots, payloads beside a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text

#: Fixed: endings of sections and of tables of contents; the ending of a payload's own file beside its section; how many lone
#: folders are gone down to the root.
NOTEBOOK, PAYLOAD, LONE = (".one", ".onetoc2"), ".onebin", 4


def listing(files: DataFrame, folder: str = "") -> DataFrame:
    """(archive, name, is_folder): what stands directly in a folder, each name once; of equal names the first path says what it is."""
    prefix = f"{folder}/" if folder else ""
    path = F.regexp_replace("path", "^/+", "")
    rest = F.substring(path, len(prefix) + 1, 1 << 30)
    inside = files.filter(path.startswith(prefix)).select("archive", path.alias("_path"), F.split_part(rest, F.lit("/"), F.lit(1)).alias("name"), rest.contains("/").alias("_folder"))
    return inside.groupBy("archive", "name").agg(F.min_by("_folder", "_path").alias("is_folder"))


def package_roots(files: DataFrame, deepest: int = LONE) -> DataFrame:
    """(archive, root): down from the top while a folder holds exactly one folder and no notebook file, ``deepest`` steps at most."""
    parts = F.split(F.regexp_replace("path", "^/+", ""), "/")
    steps = files.select("archive", parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(deepest - 1))).alias("i")).filter(F.col("i") < F.size("parts"))
    child, is_folder = F.get("parts", F.col("i")), F.col("i") < F.size("parts") - 1
    at = steps.select("archive", F.array_join(F.slice("parts", 1, F.col("i")), "/").alias("dir"), child.alias("child"), is_folder.alias("is_folder"))
    ends = F.lit(False)
    for ending in NOTEBOOK:
        ends = ends | text.lower(F.col("child")).endswith(ending)
    lone = F.when(F.col("is_folder"), F.col("child"))
    folders = at.groupBy("archive", "dir").agg(F.min(lone).alias("first"), F.max(lone).alias("last"), F.max(~F.col("is_folder") & ends).alias("has_notebook"))
    down = folders.filter((F.col("first") == F.col("last")) & ~F.col("has_notebook")).select(F.col("archive").alias("_a"), F.col("dir").alias("_d"), "first")
    roots = files.select("archive").distinct().withColumn("root", F.lit("")).withColumn("open", F.lit(True))
    for _ in range(deepest):
        found = roots.join(down, F.col("open") & (F.col("archive") == F.col("_a")) & (F.col("root") == F.col("_d")), "left")
        below = F.when(F.col("root") == "", F.col("first")).otherwise(F.concat_ws("/", "root", "first"))
        roots = found.select("archive", F.coalesce(below, F.col("root")).alias("root"), F.col("first").isNotNull().alias("open"))
    return roots.select("archive", "root")


def beside(references: DataFrame, files: DataFrame) -> DataFrame:
    """``found``: the file that a reference (dir, name) means, by its name or its name with the payloads' ending; null without one."""
    f = files.select(F.col("dir").alias("_dir"), F.col("name").alias("_name"))
    plain, other = f.select(F.col("_dir").alias("_d1"), F.col("_name").alias("_n1")), f.select(F.col("_dir").alias("_d2"), F.col("_name").alias("_n2"))
    both = references.join(plain, (F.col("dir") == F.col("_d1")) & (F.col("name") == F.col("_n1")), "left")
    both = both.join(other, (F.col("dir") == F.col("_d2")) & (F.concat("name", F.lit(PAYLOAD)) == F.col("_n2")), "left")
    return both.withColumn("found", F.coalesce("_n1", "_n2")).drop("_d1", "_n1", "_d2", "_n2")

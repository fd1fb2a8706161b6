"""Watch folders: files that arrive are read once each, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.sources import cabinet

#: Fixed: the columns of Spark's binary files.
SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, suffix: str = "*", per_trigger: int = 1000) -> DataFrame:
    """(path, modificationTime, length, content) of new files, at most ``per_trigger`` a batch; works with any sink."""
    return spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", suffix).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger).load(folder)


def cabinet_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files inside the cabinets that arrive, damage as an error column."""
    return cabinet.extract(arriving(spark, folder, "*.cab"), "path")

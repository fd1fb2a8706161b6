"""Payloads of pages: kinds, de-duplication, sizes, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text

#: Fixed: MIME types by extension; anything else is application/octet-stream.
MIME = {
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "svg": "image/svg+xml", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff",
    "emf": "image/x-emf", "wmf": "image/x-wmf",
    "pdf": "application/pdf", "htm": "text/html", "html": "text/html", "txt": "text/plain", "csv": "text/csv", "json": "application/json", "xml": "application/xml", "zip": "application/zip",
    "rtf": "application/rtf", "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint", "msg": "application/vnd.ms-outlook",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "mp3": "audio/mpeg", "wav": "audio/wav", "m4a": "audio/mp4", "wma": "audio/x-ms-wma", "ogg": "audio/ogg", "flac": "audio/flac",
    "mp4": "video/mp4", "mov": "video/quicktime", "wmv": "video/x-ms-wmv", "avi": "video/x-msvideo", "mkv": "video/x-matroska", "webm": "video/webm",
}
OTHER = "application/octet-stream"


def mime_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MIME.items()), "ext string, mime string")


def with_mime(files: DataFrame, name: str) -> DataFrame:
    """``ext`` and ``mime`` of each file name; the table of types is fixed and small, so it is broadcast."""
    types = mime_table(files.sparkSession).withColumnRenamed("ext", "_ext")
    found = files.withColumn("ext", text.extension(F.col(name))).join(F.broadcast(types), F.col("ext") == F.col("_ext"), "left")
    return found.withColumn("mime", F.coalesce("mime", F.lit(OTHER))).drop("_ext")


def resources(payloads: DataFrame, page: str, order: str, data: Column) -> DataFrame:
    """One row for each payload of a page by its MD5, with the attributes of the first, and how often it is used."""
    hashed = payloads.withColumn("md5", F.md5(data))
    first = hashed.groupBy(page, "md5").agg(F.min_by(F.struct(*hashed.columns), order).alias("_row"), F.count(F.lit(1)).alias("uses"))
    return first.select(*(F.col(f"_row.{c}").alias(c) for c in hashed.columns), "uses")


def oversized(pages: DataFrame, group: str, size: Column, most: int) -> DataFrame:
    """Groups whose payloads come to more than ``most`` bytes."""
    return pages.groupBy(group).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("payloads")).filter(F.col("bytes") > most)


def reference_faults(references: DataFrame, resources: DataFrame, key: str) -> DataFrame:
    """(key, fault): references without a resource ("missing") and resources without a reference ("unused"), each once."""
    missing = references.select(key).distinct().join(resources, key, "left_anti").withColumn("fault", F.lit("missing"))
    unused = resources.select(key).distinct().join(references, key, "left_anti").withColumn("fault", F.lit("unused"))
    return missing.unionAll(unused)

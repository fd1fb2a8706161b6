"""Binary files in the shared folder.

Spark has no sink for binary files, so a task writes its file through pyarrow's file systems, under a name of its own
attempt, and then renames it: a task that runs again, or twice at once, leaves one whole file with the same bytes.  They are
read with Spark's ``binaryFile``.
"""

from __future__ import annotations

import os
import posixpath
import re
import uuid

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system for a folder, given as a path or a URI, and the path in it.  Hadoop writes local URIs with one slash."""
    if re.match(r"file:/(?!/)", folder):
        folder = folder.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(folder if re.match(r"[A-Za-z][\w+.-]+:", folder) else f"file://{os.path.abspath(folder)}")


class BinaryFile:
    """A file that appears under its name only when it is complete."""

    def __init__(self, folder: str, name: str):
        self.system, root = file_system(folder)
        self.path, self.made = posixpath.join(root, name), posixpath.join(root, f"_{uuid.uuid4().hex}.tmp")
        self.system.create_dir(root, recursive=True)

    def __enter__(self):
        self.out = self.system.open_output_stream(self.made, buffer_size=1 << 20)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.system.move(self.made, self.path)
        else:
            self.system.delete_file(self.made)


def read_files(spark: SparkSession, folder: str, suffix: str) -> DataFrame:
    """(path, content) of the finished files; an empty table where no task wrote one."""
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder).select("path", "content")


def partition_name() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


__all__ = ["BinaryFile", "partition_name", "read_files"]

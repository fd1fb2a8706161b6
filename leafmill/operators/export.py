"""Export: plan names and links first, render each page where it is, write one file a page."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text
from leafmill.operators import links, render, sequence
from leafmill.operators.graph import checkpointed


@dataclass(frozen=True)
class ExportOptions:
    format: str = "md"  # md, vault or html
    heading_offset: int = 1
    front_matter: bool = True
    reserved: tuple[str, ...] = ("assets",)
    name_bytes: int = 80


def planned(pages: DataFrame, options: ExportOptions = ExportOptions()) -> DataFrame:
    """``stem``, ``path``, ``wiki`` and ``parent`` of (page, section, seq, level, title): the barrier that all pages pass before any is rendered,
    since links may point ahead and names must be unique."""
    named = text.file_name(text.once(F.col("title"), lambda t: text.fallback(t, "Untitled Page")), options.name_bytes)
    folder = text.file_name(F.col("section"))
    if options.format == "vault":
        named, folder = text.vault_name(named), text.vault_name(folder)
    # Written: names are read several times from here on, and the texts they come from are long.
    p = checkpointed(pages.withColumn("_name", named).withColumn("_folder", folder))
    p = sequence.unique_names(p, "_folder", "seq", "_name", options.reserved, "stem")
    p = sequence.parent_page(p, "section", "seq", "level").withColumn("_path", F.concat_ws("/", "_folder", "stem"))
    p = links.wiki_targets(p, "stem", "_path")
    return p.withColumn("path", F.concat("_path", F.lit(".html" if options.format == "html" else ".md"))).drop("_name", "_folder", "_path")


def rendered(pages: DataFrame, elements: DataFrame, options: ExportOptions = ExportOptions()) -> DataFrame:
    """(page, path, text) of all planned pages; pages without elements have their head alone."""
    if options.format == "html":
        body = render.html_pages(elements)
    else:
        body = render.markdown_pages(elements, options.format == "vault", options.heading_offset)
    p = planned(pages, options).join(body.withColumnRenamed("text", "body"), "page", "left")
    content = F.coalesce("body", F.lit(""))
    if options.front_matter and options.format != "html":
        content = F.concat(render.front_matter({"title": F.col("title"), "section": F.col("section")}), F.lit("\n"), content, F.lit("\n"))
    return p.select("page", "path", content.alias("text"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write (path, text) as files below a folder that all executors see; returns (path, bytes, error), one row a file.

    Files are written once, when this is called; the result is a table of its own, that later actions read.  A file is written
    under another name and then renamed, so a task that runs again leaves whole files; one that is there already with the same
    bytes stays as it is, so a run that is repeated changes nothing.  A page that can't be written is reported and stops no other.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = fs.FileSystem.from_uri(folder)
        for rows in batches:
            out = []
            for path, body in zip(rows["path"], rows["text"], strict=True):
                data, at = body.encode("utf-8", "replace"), posixpath.join(root, path)
                try:
                    if _holds(system, at, data):
                        out.append((path, len(data), None))
                        continue
                    system.create_dir(posixpath.dirname(at), recursive=True)
                    made = posixpath.join(posixpath.dirname(at), f"_{uuid.uuid4().hex}.tmp")
                    with system.open_output_stream(made) as f:
                        f.write(data)
                    system.move(made, at)
                    out.append((path, len(data), None))
                except OSError as e:
                    out.append((path, 0, str(e)))
            yield pd.DataFrame(out, columns=["path", "bytes", "error"])

    return checkpointed(pages.select("path", "text").mapInPandas(put, "path string, bytes long, error string"))


def _holds(system: fs.FileSystem, path: str, data: bytes) -> bool:
    info = system.get_file_info(path)
    if info.type != fs.FileType.File or info.size != len(data):
        return False
    with system.open_input_stream(path) as f:
        return f.read() == data


def asset_plan(assets: DataFrame, scope: str, order: str, name: str, identity: list[str]) -> DataFrame:
    """assets with ``file``, the name of the file in its scope that has the asset's content, and ``writes`` for the one use of
    it that writes that file: the first, in order.

    Contents that are the same (``identity``: their place, or their hash and size) are one file of a scope, named as its first
    use wants; only then names are made unique, so a use that comes again takes no name.  Nulls in the identity are values; a
    null name has no file.  ``order`` is unique in a scope.
    """
    key = F.struct(scope, *identity)
    a = assets.withColumn("_content", key)
    firsts = a.groupBy("_content").agg(F.min_by(F.struct(F.col(order).alias("o"), F.col(name).alias("n")), order).alias("first"))
    firsts = firsts.select("_content", F.col(f"_content.{scope}").alias("_scope"), F.col("first.o").alias("_first"), F.col("first.n").alias("_wanted"))
    named = sequence.unique_names(firsts, "_scope", "_first", "_wanted", out="file", files=True)
    return a.join(named.select("_content", "_first", "file"), "_content").withColumn("writes", F.col(order) == F.col("_first")).drop("_content", "_first")


def statistics(written: DataFrame) -> DataFrame:
    return written.agg(F.count_if(F.col("error").isNull()).alias("pages"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))

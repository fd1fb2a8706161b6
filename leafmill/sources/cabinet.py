"""Cabinet archives: a reader for stored and MSZIP folders, and a writer of MSZIP ones.

Archives are rows of bytes, as ``binaryFile`` reads them; each is decoded where it is, and damage becomes an error column.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

BLOCK = 32768
STORED, MSZIP = 0, 1


class DamagedCabinet(ValueError):
    pass


def _name(data: bytes, at: int, utf8: bool) -> tuple[str, int]:
    end = data.index(b"\0", at)
    raw = data[at:end]
    try:
        name = raw.decode("utf-8")
    except UnicodeDecodeError:
        name = raw.decode("utf-8" if utf8 else "cp1252", "replace")
    return name.replace("\\", "/"), end + 1


def _folder(data: bytes, at: int, blocks: int, kind: int, reserve: int) -> bytes:
    out = bytearray()
    for _ in range(blocks):
        _, packed, size = struct.unpack_from("<IHH", data, at)
        at += 8 + reserve
        block = data[at : at + packed]
        at += packed
        if kind == MSZIP:
            if block[:2] != b"CK":
                raise DamagedCabinet("a block without its signature")
            inflate = zlib.decompressobj(-15, zdict=bytes(out[-BLOCK:]))
            try:
                block = inflate.decompress(block[2:], BLOCK + 1)
            except zlib.error as e:
                raise DamagedCabinet(str(e)) from e
        elif kind != STORED:
            raise DamagedCabinet(f"compression {kind} is not supported")
        if len(block) != size:
            raise DamagedCabinet("a block of the wrong size")
        out += block
    return bytes(out)


def files(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, content) of each file, with ``/`` between folders."""
    try:
        if data[:4] != b"MSCF":
            raise DamagedCabinet("not a cabinet")
        first, folders, count, flags = struct.unpack_from("<I", data, 16)[0], *struct.unpack_from("<HHH", data, 26)
        at, folder_reserve, block_reserve = 36, 0, 0
        if flags & 4:
            head, folder_reserve, block_reserve = struct.unpack_from("<HBB", data, at)
            at += 4 + head
        for bit in (1, 2):
            if flags & bit:
                at = data.index(b"\0", data.index(b"\0", at) + 1) + 1
        places = [struct.unpack_from("<IHH", data, at + i * (8 + folder_reserve)) for i in range(folders)]
        whole: dict[int, bytes] = {}
        at = first
        for _ in range(count):
            size, offset, folder, _, _, attributes = struct.unpack_from("<IIHHHH", data, at)
            name, at = _name(data, at + 16, bool(attributes & 0x80))
            if folder >= folders:
                raise DamagedCabinet("a file that goes on in another part")
            if folder not in whole:
                begin, blocks, kind = places[folder]
                whole[folder] = _folder(data, begin, blocks, kind & 15, block_reserve)
            if offset + size > len(whole[folder]):
                raise DamagedCabinet("a file beyond its folder")
            yield name, whole[folder][offset : offset + size]
    except (struct.error, ValueError) as e:
        raise e if isinstance(e, DamagedCabinet) else DamagedCabinet(str(e)) from e


def build(entries: list[tuple[str, bytes]]) -> bytes:
    """A cabinet with one MSZIP folder; each block is compressed by itself, which any reader of shared history takes too."""
    body = b"".join(c for _, c in entries)
    blocks = []
    for i in range(0, len(body), BLOCK):
        deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
        packed = b"CK" + deflate.compress(body[i : i + BLOCK]) + deflate.flush()
        blocks.append(struct.pack("<IHH", 0, len(packed), len(body[i : i + BLOCK])) + packed)
    table, at = b"", 0
    for name, content in entries:
        table += struct.pack("<IIHHHH", len(content), at, 0, 0x21, 0, 0xA0) + name.encode() + b"\0"
        at += len(content)
    begin = 36 + 8 + len(table)
    total = begin + sum(map(len, blocks))
    head = struct.pack("<4sIIIIIBBHHHHH", b"MSCF", 0, total, 0, 44, 0, 3, 1, 1, len(entries), 0, 0, 0)
    return head + struct.pack("<IHH", begin, len(blocks), MSZIP) + table + b"".join(blocks)


def extract(archives: DataFrame, path: str = "archive", content: str = "content") -> DataFrame:
    """(archive, path, content, error): a row for each file; an archive with damage adds a row with the error alone after the
    files before it."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for name, data in zip(rows[path], rows[content], strict=True):
                found, error = [], None
                try:
                    for f in files(bytes(data)):
                        found.append((str(name), *f, None))
                except DamagedCabinet as e:
                    error = str(e)
                if error:
                    found.append((str(name), None, None, error))
                yield pd.DataFrame(found, columns=["archive", "path", "content", "error"])

    return archives.select(path, content).mapInPandas(read, "archive string, path string, content binary, error string")


def pack(entries: DataFrame, group: str) -> DataFrame:
    """(archive, content): the files (path, content) of each group in a cabinet of their own.  A cabinet holds at most 65,535
    files and 2 GB, so groups are bounded by the format; the caller deals them out."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("path")
        return pd.DataFrame({"archive": [str(rows[group].iloc[0])], "content": [build(list(zip(rows["path"], map(bytes, rows["content"]), strict=True)))]})

    return entries.groupBy(group).applyInPandas(one, "archive string, content binary")

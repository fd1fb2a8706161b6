"""WARC files: a writer with revisit records, and a reader that salvages what it can from damaged files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import bounded, materialise, shared_folder, slices, spread_join, strings
from leafmill.llm.files import BinaryFile, partition_name, read_files

SUFFIX = ".warc.gz"
DATE = "2020-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
MEMBER = b"\x1f\x8b\x08"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(text: str | None) -> int | None:
    number = re.fullmatch(r"<urn:page:(-?\d*)>", text or "")
    return int(number[1]) if number and number[1] else None


def record(page_id, url: str, payload: bytes, refers_to=None, revisit: bool = False, digest: str | None = None) -> bytes:
    """One record, not compressed.  A revisit has the HTTP head alone; its digest and length are the full payload's."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    digest = digest or sha1_base32(payload)
    block += b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        *([f"WARC-Refers-To: {urn(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"] if revisit else []),
    ]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


class Record(NamedTuple):
    offset: int
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


class Gap(NamedTuple):
    """Bytes of the file that belong to no record that passed its checks."""

    offset: int
    end: int
    reason: str


class Damage(ValueError):
    pass


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    for line in raw.decode("utf-8", "replace").splitlines():
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
        elif line:
            raise Damage("a header line without a colon")
    return out


def parse(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at a version line, and where it ends.  Raises Damage where any check fails."""
    version = VERSION.match(data, at)
    if not version:
        raise Damage("no version line")
    end = data.find(b"\r\n\r\n", version.end() - 2)
    if end < 0:
        raise Damage("headers without end")
    headers = _headers(data[version.end() : end])
    if not re.fullmatch(r"\d+", headers.get("content-length", "")):
        raise Damage("no length")
    begin, size = end + 4, int(headers["content-length"])
    block = data[begin : begin + size]
    if len(block) < size or data[begin + size : begin + size + 4] != b"\r\n\r\n":
        raise Damage("the length is wrong")
    digest = headers.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != sha1_base32(block):
        raise Damage("the block's digest is wrong")
    http, payload = {}, block
    if block.startswith(b"HTTP/"):
        top, _, payload = block.partition(b"\r\n\r\n")
        http = _headers(top.partition(b"\r\n")[2])
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and digest.startswith("sha1:") and digest[5:] != sha1_base32(payload):
        raise Damage("the payload's digest is wrong")
    return Record(at, headers, http, payload), begin + size + 4


def _member(data: bytes, at: int, piece: int = 1 << 14) -> tuple[bytes, int]:
    """The member at a place, and where it ends.  It is fed by pieces, so that no more is read than it has, and one."""
    inflate, view, out = zlib.decompressobj(31), memoryview(data), []
    try:
        while not inflate.eof and at < len(data):
            out.append(inflate.decompress(view[at : at + piece]))
            at = min(len(data), at + piece)
    except zlib.error as e:
        raise Damage(f"gzip: {e}") from e
    if not inflate.eof:
        raise Damage("a gzip member without end")
    return b"".join(out), at - len(inflate.unused_data)


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """All records of a file, compressed by member or plain, that pass their checks, and the gaps between them, in order.

    After a failed check the reader goes on from the next byte where a gzip member or a version line may begin, and takes up
    again at the first one that holds a whole valid record; all between is one gap, with the first failure as its reason.
    A member may hold several records; those after a bad one in the same member are found by their version lines.
    """
    at, bad, reason, marks = 0, None, "", Marks(data)
    while at < len(data):
        try:
            if data.startswith(MEMBER, at):
                inner, end = _member(data, at)
                found = [x for x in salvage(inner) if isinstance(x, Record)] if not inner.startswith(MEMBER) else []
                if not found:
                    raise Damage(_why(inner))
                whole = sum(1 for _ in VERSION.finditer(inner)) == 1 or _whole(inner)
            else:
                one, end = parse(data, at)
                found, whole = [one], True
        except Damage as e:
            if bad is None:
                bad, reason = at, str(e)
            at = marks.next(at + 1)
            continue
        if bad is not None:
            yield Gap(bad, at, reason)
            bad = None
        for x in found:
            yield x._replace(offset=at)
        if not whole:
            yield Gap(at, end, "a member with a damaged record")
        at = end
    if bad is not None:
        yield Gap(bad, len(data), reason)


def _why(inner: bytes) -> str:
    try:
        parse(inner)
    except Damage as e:
        return str(e)
    return "no record"


def _whole(inner: bytes) -> bool:
    at = 0
    try:
        while at < len(inner):
            _, at = parse(inner, at)
    except Damage:
        return False
    return True


class Marks:
    """Places where a record may begin.  The next one of either kind is remembered until it is passed, so that a file is
    searched once, however many checks fail."""

    def __init__(self, data: bytes):
        self.data, self.line, self.member = data, -1, -1

    def next(self, at: int) -> int:
        if self.line < at:
            line = VERSION.search(self.data, at)
            self.line = line.start() if line else len(self.data)
        if self.member < at:
            member = self.data.find(MEMBER, at)
            self.member = member if member >= 0 else len(self.data)
        return min(self.line, self.member)


# --------------------------------------------------------------------------- tables


def write_pages(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = 16 << 20) -> DataFrame:
    """Write a record for each page; returns the index of files (path, records, bytes)."""
    bounded(pages.sparkSession)
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    digests = p.filter(F.octet_length("html") >= min_bytes).select("page_id", F.unhex(F.sha1("html")).alias("sha1"))
    same = materialise(digests.groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "warc-same")
    # Only ids and digests meet by digest; payloads move once, by page_id, which no group of equal pages makes hot.
    revisits = spread_join(digests, same, ["sha1"], "copies", F.col("page_id"), "inner").filter(~F.col("page_id").eqNullSafe(F.col("keeper")))
    by_page = revisits.select(F.col("page_id").alias("of_page"), F.col("sha1").alias("of_sha1"), "keeper").distinct()
    marked = (
        p.withColumn("sha1", F.unhex(F.sha1("html")))
        .join(by_page, F.col("page_id").eqNullSafe(F.col("of_page")) & (F.col("sha1") == F.col("of_sha1")), "left")
        .select("page_id", "url", "html", "keeper", (F.octet_length("html") >= min_bytes).alias("large"), F.col("of_sha1").isNotNull().alias("found"))
        .select("page_id", "url", "html", "keeper", (F.col("found") & F.col("large")).alias("revisit"))
        .sortWithinPartitions("page_id", "url", "html")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sequence, held, size = partition_name(), 0, [], 0

        def flush():
            nonlocal sequence, size
            name = f"part-{part:08d}-{sequence:06d}{SUFFIX}"
            with BinaryFile(folder, name) as out:
                for x in held:
                    out.write(x)
            row = pa.RecordBatch.from_pydict({"path": [name], "records": [len(held)], "bytes": [size]})
            sequence, size = sequence + 1, 0
            held.clear()
            return row

        for batch in slices(batches, "html"):
            html = strings(batch.column("html")).cast(pa.binary()).to_pylist()
            for page_id, url, payload, keeper, revisit in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url")), html, *(batch.column(c).to_pylist() for c in ("keeper", "revisit")), strict=True):
                held.append(gzip.compress(record(page_id, url, payload, keeper, revisit), 4, mtime=0))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    return materialise(marked.mapInArrow(write, "path string, records long, bytes long"), "warc-index")


def read_warcs(spark, folder: str, suffix: str = SUFFIX) -> DataFrame:
    """A row for each record that passes its checks, and one for each quarantined gap.

    kind is record or gap; both have path and begin (offset in the file); records have page_id, url, record_type,
    payload_bytes, payload_digest, refers_to and payload (null for revisits); gaps have end and reason.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "kind", "begin", "end", "reason", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows: list[tuple] = []
                size = 0
                for x in salvage(content.as_buffer().to_pybytes()):
                    rows.append(_row(path, x))
                    size += len(rows[-1][-1] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "path string, kind string, begin long, end long, reason string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return read_files(spark, folder, suffix).mapInArrow(read, schema)


def _row(path: str, x: Record | Gap) -> tuple:
    if isinstance(x, Gap):
        return (path, "gap", x.offset, x.end, x.reason, *[None] * 7)
    h, revisit = x.headers, x.headers.get("warc-type") == "revisit"
    length = int(x.http.get("content-length", "0") or 0) if revisit else len(x.payload)
    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return (path, "record", x.offset, None, None, page_of(h.get("warc-record-id")), h.get("warc-target-uri"), h.get("warc-type"), length, digest, page_of(h.get("warc-refers-to")) if revisit else None, None if revisit else x.payload)


def archive_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, file_bytes: int = 16 << 20) -> DataFrame:
    """Write a WARC record for each page to ``folder`` (default: a new shared folder) and read the archives back.

    Returns what ``read_warcs`` does.  Of pages with equal payloads of ``min_bytes`` or more, that with the largest page_id
    is a response and the others revisit it; smaller payloads are all responses.

    * A null html is empty, a null url too.  Rows that repeat the largest page_id are all responses; null page_ids are the
      smallest, and where all of a group are null, all are responses.
    * Other columns are ignored; an empty table writes no file and gives an empty one.

    The largest page_id of each digest is found with map-side combining; only ids and digests are joined with it, and a digest
    of very many pages is dealt to several places.  Payloads move once, by page_id and digest.  A task holds one file
    (``file_bytes``) at a time.
    """
    folder = folder or shared_folder(pages.sparkSession, "warc")
    write_pages(pages, folder, min_bytes, file_bytes)
    return read_warcs(pages.sparkSession, folder)

"""WARC archives inside ZIP packages: writing, and reading by byte ranges.

A package is a ZIP file whose members are stored, not compressed: one WARC file, whose
records are gzip members of their own, and one index with a line for each record
(offset, length, id, type). The reader finds
the end record (and the ZIP64 end record, where a size, offset or count outgrows its
field), walks the central directory, locates the members from their local headers,
and cuts single records out of the archive by range, so nothing is extracted.

Packages are files in the cluster's shared folder, written and read by the tasks through
pyarrow's file systems; a task that runs again writes files of new names, and only those
of the one that ended are listed. Where pyarrow can't open the folder's kind of store they
travel as rows of a table there, read by the same ranges. Each holds at most ``PACKAGE_RECORDS`` records or
about ``PACKAGE_BYTES`` of payload, whichever comes first.

Defined cases: a null html is an empty payload; payloads under ``least`` bytes are
never revisits; of equal payloads the smallest id is the response (of rows that share
that id too, one; the pages must come laid out the same twice, as tables do),
a null id counts as the largest.
"""

from __future__ import annotations

import gzip
import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.llm.common import checkpoint, shared

PACKAGE_RECORDS, PACKAGE_BYTES = 2000, 16 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.tsv"
LIMIT32, LIMIT16 = 0xFFFFFFFF, 0xFFFF


def record(kind: str, uri: str, number: int, payload: bytes, digest: str, refers_to: int | None, page_id: int | None) -> bytes:
    """A WARC/1.1 record; a revisit keeps its payload's digest and length but no body."""
    body = payload if kind == "response" else b""
    safe = "".join(c if c > " " else f"%{ord(c):02X}" for c in uri)
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:record:{number}>",
        f"WARC-Target-URI: {safe}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n : n + 4] != b"\r\n\r\n":
        raise ValueError("record of another length than it says")
    return fields, rest[:n]


def zip_stored(members: list[tuple[str, bytes]], *, zip64: bool = False) -> bytes:
    """A ZIP file of stored members; ``zip64`` writes the large forms whatever the sizes."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        at, crc, raw = len(out), zlib.crc32(data), name.encode()
        big = zip64 or len(data) >= LIMIT32 or at >= LIMIT32
        size = LIMIT32 if big else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        out += struct.pack("<IHHHHHIIIHH", 0x04034B50, 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        central += struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, LIMIT32 if big else at) + raw + extra
    at, n = len(out), len(members)
    big = zip64 or at >= LIMIT32 or n >= LIMIT16
    out += central
    if big:
        end = len(out)
        out += struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, len(central), at)
        out += struct.pack("<IIQI", 0x07064B50, 0, end, 1)
    out += struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, LIMIT16 if big else n, LIMIT16 if big else n, LIMIT32 if big else len(central), LIMIT32 if big else at, 0)
    return bytes(out)


@dataclass
class Member:
    name: str
    method: int
    crc: int
    size: int
    header: int  # offset of its local header


class Package:
    """A ZIP file behind ``read(offset, length)``, of which only ranges are read."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read, self.size = read, size
        self.members = {m.name: m for m in self._directory()}

    def _directory(self) -> Iterator[Member]:
        tail = self.read(back := max(0, self.size - 65557), self.size - back)
        at = tail.rfind(b"PK\5\6")
        if at < 0:
            raise ValueError("no end of central directory")
        _, _, _, n, length, offset = struct.unpack_from("<HHHHII", tail, at + 4)
        if LIMIT16 in (n,) or LIMIT32 in (length, offset):
            mark, _, end, _ = struct.unpack("<IIQI", self.read(back + at - 20, 20))
            if mark != 0x07064B50:
                raise ValueError("no ZIP64 locator")
            mark, _, _, _, _, _, _, n, length, offset = struct.unpack("<IQHHIIQQQQ", self.read(end, 56))
            if mark != 0x06064B50:
                raise ValueError("no ZIP64 end record")
        central, at = self.read(offset, length), 0
        for _ in range(n):
            mark, _, _, _, method, _, _, crc, packed, size, a, b, c, _, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", central, at)
            if mark != 0x02014B50:
                raise ValueError("no central directory entry")
            name, extra = central[at + 46 : at + 46 + a].decode(), central[at + 46 + a : at + 46 + a + b]
            while len(extra) >= 4:
                kind, long = struct.unpack_from("<HH", extra)
                if kind == 1:
                    big = list(struct.unpack_from(f"<{long // 8}Q", extra, 4))
                    size = big.pop(0) if size == LIMIT32 else size
                    packed = big.pop(0) if packed == LIMIT32 else packed
                    header = big.pop(0) if header == LIMIT32 else header
                extra = extra[4 + long :]
            at += 46 + a + b + c
            yield Member(name, method, crc, size, header)

    def start(self, name: str) -> int:
        """Offset of a stored member's data."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed; ranges need stored members")
        mark, *_, a, b = struct.unpack("<IHHHHHIIIHH", self.read(m.header, 30))
        if mark != 0x04034B50:
            raise ValueError("no local header")
        return m.header + 30 + a + b

    def member(self, name: str) -> bytes:
        data = self.read(self.start(name), self.members[name].size)
        if zlib.crc32(data) != self.members[name].crc:
            raise ValueError(f"{name} has another checksum than it says")
        return data

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        """The archive's records, each cut out by the range the index gives."""
        base = self.start(ARCHIVE)
        for line in self.member(INDEX).decode().splitlines():
            offset, length = map(int, line.split("\t")[:2])
            yield parse_record(gzip.decompress(self.read(base + offset, length)))


def package(rows: list[tuple], *, zip64: bool = False) -> bytes:
    """A package of (page_id, url, payload, digest, kind, refers_to)."""
    archive, lines = bytearray(), []
    for number, (page, url, payload, digest, kind, refers) in enumerate(rows):
        data = gzip.compress(record(kind, url or "", number, payload, digest, refers, page), 4, mtime=0)
        lines.append(f"{len(archive)}\t{len(data)}\t{'' if page is None else page}\t{kind}\n")
        archive += data
    return zip_stored([(ARCHIVE, bytes(archive)), (INDEX, "".join(lines).encode())], zip64=zip64)


def decide(pages: DataFrame, *, page: str = "page_id", html: str = "html", url: str = "url", least: int = 100) -> DataFrame:
    """(page, url, html, digest, kind, first): which records are revisits, and of which page.

    Equal payloads may be a third of all rows: only the least (id, place in the input)
    of each is aggregated, and joined back by a join that adaptive execution can split.
    """
    rows = pages.select(F.col(page).cast("long").alias("page"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256)).withColumn("place", F.monotonically_increasing_id())
    last = F.lit((1 << 63) - 1)  # a null id counts as the largest
    key = F.struct(F.coalesce("page", last).alias("o"), F.col("place").alias("p"), F.col("page").alias("page"))
    first = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    named = rows.join(first.select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & (F.col("first.p") != F.col("place"))
    return named.select("page", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first.page")).alias("first"))


def opened(folder: str):
    """pyarrow's file system and path of a folder, or None for a kind of store it can't open."""
    from pyarrow import fs

    try:
        return fs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def write(pages: DataFrame, *, page: str = "page_id", html: str = "html", url: str = "url", least: int = 100, folder: str | None = None) -> DataFrame:
    """Packages of the pages' records: rows (path, records, content), the path of a file in ``folder`` or, without one, the content."""
    rows = decide(pages, page=page, html=html, url=url, least=least)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def one():
            data, path = package(held), None
            if folder:
                store, base = opened(folder)
                store.create_dir(base, recursive=True)
                path = f"{base}/{uuid.uuid4().hex}.zip"
                with store.open_output_stream(path) as out:
                    out.write(data)
            return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([len(held)], pa.int32()), pa.array([None if path else data], pa.binary())], names=["path", "records", "content"])

        for b in batches:
            for page_id, link, text, digest, kind, first in zip(*b.columns, strict=True):
                payload = text.as_py().encode()
                held.append((page_id.as_py(), link.as_py(), payload, digest.as_py(), kind.as_py(), first.as_py()))
                size += len(payload)
                if len(held) >= PACKAGE_RECORDS or size >= PACKAGE_BYTES:
                    yield one()
                    held, size = [], 0
        if held:
            yield one()

    return rows.mapInArrow(put, "path string, records int, content binary")


def read(packages: DataFrame, *, folder: str | None = None) -> DataFrame:
    """Every record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, body.

    The digest of a response is computed from its body; a revisit states its own.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "body"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())

    def ranges(path: str | None, content: pa.BinaryScalar) -> tuple[Callable[[int, int], bytes], int]:
        if path is None:
            data = content.as_buffer()
            return lambda at, n: data.slice(at, n).to_pybytes(), data.size
        file = opened(folder)[0].open_input_file(path)
        return lambda at, n: file.read_at(n, at), file.size()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out, size = [[] for _ in names], 0
                for fields, body in Package(*ranges(path, content)).records():
                    kind = fields["WARC-Type"]
                    full = kind == "response"
                    digest = hashlib.sha256(body).hexdigest() if full else fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    page = fields.get("X-Page-ID")
                    refers = fields.get("WARC-Refers-To", "")[10:-1]
                    for column, value in zip(out, (page and int(page), len(body) if full else int(fields["X-Payload-Length"]), digest, kind, int(refers) if refers and refers != "None" else None, fields["WARC-Target-URI"], body.decode() if full else None), strict=True):
                        column.append(value)
                    size += len(body)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)
                        out, size = [[] for _ in names], 0
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=names)

    return packages.select("path", "content").mapInArrow(cut, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, body string")


def round_trip(pages: DataFrame, *, page: str = "page_id", html: str = "html", url: str = "url", least: int = 100) -> DataFrame:
    """Writes the pages to packages in the shared folder and reads every record back."""
    spark = pages.sparkSession
    shared(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/packages-{uuid.uuid4().hex}"
    folder = folder if opened(folder) else None
    packages = checkpoint(write(pages, page=page, html=html, url=url, least=least, folder=folder))
    return read(packages, folder=folder)

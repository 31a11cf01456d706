"""Arrow IPC stream files as a data source: ranges of record batches are partitions.

    register(spark)
    spark.read.format("arrow_stream").schema(...).load("/folder/*.arrow")

The driver walks through the messages of each file by their headers alone and cuts it into ranges
of about ``rangeBytes``; a task opens its range behind the file's schema and reads no other
column than those of the schema asked for. A file with dictionaries is one range, for later
batches need earlier ones. Files are opened through pyarrow's file systems, so a path may be local
or of any store that pyarrow knows.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of record batches that one task reads, about.
RANGE_BYTES = 64 << 20
#: The marker before a message, and the kinds of headers.
CONTINUATION, SCHEMA, DICTIONARY = b"\xff\xff\xff\xff", 1, 2


@dataclass
class Range(InputPartition):
    path: str
    head: int  # bytes of the schema message, at the start of the file
    start: int
    end: int


def _opened(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return store, inner


def files(path: str) -> list[str]:
    """The files of a path: a file, a folder's files, or those that match a pattern in its last part."""
    from pyarrow import fs

    store, inner = _opened(path)
    prefix = path[: len(path) - len(inner)]
    folder, _, last = inner.rpartition("/")
    if any(c in last for c in "*?["):
        found = store.get_file_info(fs.FileSelector(folder or "/"))
        return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, last))
    info = store.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        return sorted(prefix + f.path for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
    return [path]


def _number(data: bytes, at: int, width: int, signed: bool = False) -> int:
    return int.from_bytes(data[at : at + width], "little", signed=signed)


def header(data: bytes) -> tuple[int, int]:
    """The kind of a message and the bytes of its body, from its metadata (a flatbuffer table)."""
    table = _number(data, 0, 4)
    slots = table - _number(data, table, 4, True)
    size = _number(data, slots, 2)

    def place(field: int) -> int:
        at = 4 + 2 * field
        return _number(data, slots + at, 2) if at < size else 0

    kind, body = place(1), place(3)
    return data[table + kind] if kind else 0, _number(data, table + body, 8) if body else 0


def messages(path: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of the messages of a stream; bodies aren't read."""
    store, inner = _opened(path)
    with store.open_input_file(inner) as f:
        at, size = 0, f.size()
        while at + 8 <= size:
            f.seek(at)
            mark = f.read(8)
            if mark[:4] != CONTINUATION:
                raise ValueError(f"{path}: no Arrow stream at byte {at}")
            n = _number(mark, 4, 4)
            if n == 0:
                return
            kind, body = header(f.read(n))
            yield kind, at, at + 8 + n + body
            at += 8 + n + body


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.most = schema.names, options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for path in files(self.path):
            found = list(messages(path))
            if not found or found[0][0] != SCHEMA:
                raise ValueError(f"{path}: an Arrow stream begins with its schema")
            head, batches = found[0][2], found[1:]
            whole = any(kind == DICTIONARY for kind, *_ in batches)
            start = None
            for k, (_, a, b) in enumerate(batches):
                start = a if start is None else start
                if k + 1 == len(batches) or (b - start >= self.most and not whole):
                    out.append(Range(path, head, start, b))
                    start = None
        return out

    def read(self, partition: Range) -> Iterator:
        import pyarrow as pa

        store, inner = _opened(partition.path)
        with store.open_input_file(inner) as f:
            head = f.read(partition.head)
            with pa.ipc.open_stream(pa.py_buffer(head)) as schema:
                own = schema.schema
            at = [own.get_field_index(n) for n in self.names]
            if missing := [n for n, i in zip(self.names, at, strict=True) if i < 0]:
                raise ValueError(f"{partition.path}: no columns {missing}")
            f.seek(partition.start)
            data = pa.py_buffer(head + f.read(partition.end - partition.start))
            with pa.ipc.open_stream(data, options=pa.ipc.IpcReadOptions(included_fields=sorted(at))) as stream:
                for batch in stream:
                    yield batch.select(self.names)


class ArrowStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrow_stream"

    def schema(self) -> StructType:
        import pyarrow as pa
        from pyspark.sql.pandas.types import from_arrow_schema

        store, inner = _opened(files(self.options["path"])[0])
        with store.open_input_stream(inner) as f, pa.ipc.open_stream(f) as stream:
            return from_arrow_schema(stream.schema)

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowStream)

"""Classic pcap files as a Spark data source: one file is read by many tasks, as a table or as a stream of new files."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from belltower.sources.packets import MAGIC

SCHEMA = "path string, linktype int, t double, frame binary"
#: Bytes of a file's header and of a record's; the most bytes of one frame; records that must follow one another where a part begins.
FILE_HEADER, RECORD, LONGEST, CHAIN = 24, 16, 262_144, 16
#: Seconds that a capture's records are from its first, and neighbours from each other, at most.
SPAN, APART = 300_000_000, 86_400
#: Bytes of a part, of one read, and frames of one batch.
PART, READ, BATCH = 64 << 20, 4 << 20, 4096


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local and shared mounts, HDFS, object stores), and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path else fs.LocalFileSystem().normalize_path(path))


def captures(path: str) -> list[fs.FileInfo]:
    """The capture file, or those of a folder, oldest first."""
    store, inside = store_of(path)
    info = store.get_file_info(inside)
    found = store.get_file_info(fs.FileSelector(inside)) if info.type == fs.FileType.Directory else [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: (f.mtime_ns or 0, f.path))


def parts_of(files: Sequence[fs.FileInfo], size: int) -> list[Part]:
    return [Part(f.path, a, min(a + size, f.size)) for f in files for a in range(0, max(f.size, 1), size)]


class Records:
    """Record by record through an open capture, a few bytes of which are held."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()
        head = file.read_at(FILE_HEADER, 0)
        if head[:4] not in MAGIC or len(head) < FILE_HEADER:
            raise ValueError("no classic pcap file")
        self.order, self.unit = MAGIC[head[:4]]
        self.link = struct.unpack_from(self.order + "I", head, 20)[0]
        self.at, self.held = 0, b""
        first = self.header(FILE_HEADER)
        self.began = first[0] if first else 0

    def bytes_at(self, at: int, n: int) -> bytes:
        if not self.at <= at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(max(n, READ), at)
        return self.held[at - self.at : at - self.at + n]

    def header(self, at: int) -> tuple[int, int, int, int] | None:
        raw = self.bytes_at(at, RECORD)
        return struct.unpack(self.order + "IIII", raw) if len(raw) == RECORD else None

    def begins(self, at: int) -> bool:
        """Whether a record begins here: a chain of headers that make sense leads on, or to the file's end. Times near the file's first tell a frame's zeros, or a header's other numbers, from a header."""
        before = None
        for _ in range(CHAIN):
            if at == self.size:
                return before is not None
            h = self.header(at)
            if h is None or h[1] >= self.unit or not h[2] <= h[3] <= LONGEST or abs(h[0] - self.began) > SPAN or at + RECORD + h[2] > self.size or before is not None and abs(h[0] - before) > APART:
                return False
            before, at = h[0], at + RECORD + h[2]
        return True

    def first(self, start: int) -> int:
        """Where the first record at or after a place begins; the file's end if there is none."""
        if start <= FILE_HEADER:
            return FILE_HEADER
        return next((at for at in range(start, min(start + LONGEST + RECORD, self.size)) if self.begins(at)), self.size)

    def frames(self, start: int, end: int) -> Iterator[tuple[float, bytes]]:
        """The records that begin from start on and before end; one that the file breaks off is cut, as it is."""
        at = self.first(start)
        while at < end and (h := self.header(at)):
            yield h[0] + h[1] / self.unit, self.bytes_at(at + RECORD, h[2])
            at += RECORD + h[2]


def read_part(part: Part) -> Iterator[pa.RecordBatch]:
    store, inside = store_of(part.path)
    with store.open_input_file(inside) as file:
        records = Records(file)
        t, found = [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part.path] * len(t), pa.string()), pa.array([records.link] * len(t), pa.int32()), pa.array(t, pa.float64()), pa.array(found, pa.binary())], names=["path", "linktype", "t", "frame"])

        held = 0
        for when, frame in records.frames(part.start, part.end):
            t.append(when)
            found.append(frame)
            held += len(frame)
            if len(t) >= BATCH or held >= READ:
                yield batch()
                t, found, held = [], [], 0
        if t:
            yield batch()


class CaptureReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> Sequence[InputPartition]:
        return parts_of(captures(self.path), self.size)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_part(partition)


class CaptureStream(DataSourceStreamReader):
    """New files of a folder; an offset is the last file's time and path. Files must come whole, by a move."""

    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = captures(self.path)
        return {"time": files[-1].mtime_ns, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        after, upto = ((o["time"], o["path"]) for o in (start, end))
        return parts_of([f for f in captures(self.path) if after < (f.mtime_ns, f.path) <= upto], self.size)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return read_part(partition)


class CaptureSource(DataSource):
    """Format `pcap`: frames of the classic pcap file or folder of them at `path`. Option partBytes: about how much of a file one task reads."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def _made(self, kind: type) -> CaptureReader | CaptureStream:
        if "path" not in self.options:
            raise ValueError("a pcap source needs a path")
        return kind(self.options["path"], int(self.options.get("partBytes", str(PART))))

    def reader(self, schema: object) -> DataSourceReader:
        return self._made(CaptureReader)

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return self._made(CaptureStream)


def register(spark: SparkSession) -> None:
    """After this, spark.read.format("pcap") and spark.readStream.format("pcap") work."""
    spark.dataSource.register(CaptureSource)


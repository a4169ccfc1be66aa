"""Archives of several zstd frames as a data source with one partition per run of frames.

A zstd file is a sequence of frames that decode on their own. Their starts are found by walking the block headers,
which name the size of each block, so only a few bytes per block are read. A partition decodes whole frames. A line
that crosses a border of partitions belongs to the partition it starts in, which reads on until the line ends; the
others skip to the first line that starts in them.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from agoraflow.functions.scale import storage_of
from agoraflow.schemas import BY_KIND
from agoraflow.sources.archives import MAX_WINDOW

# fixed values of the frame format: magic numbers, sizes of optional header fields by flag
_MAGIC = 0xFD2FB528
_SKIPPABLE, _SKIPPABLE_MASK = 0x184D2A50, 0xFFFFFFF0
_DICTIONARY_BYTES = (0, 1, 2, 4)
_SIZE_BYTES = (0, 2, 4, 8)

# compressed bytes of a partition, about
PARTITION_BYTES = 64 << 20
_BATCH_LINES = 20_000


def _number(file, n: int) -> int:
    data = file.read(n)
    if len(data) < n:
        raise ValueError("the file ends inside a frame")
    return int.from_bytes(data, "little")


def frame_starts(file, size: int) -> list[int]:
    """Offsets of the frames with content in a seekable file of ``size`` bytes."""
    starts, at = [], 0
    while at < size:
        file.seek(at)
        magic = _number(file, 4)
        if magic & _SKIPPABLE_MASK == _SKIPPABLE:
            at += 8 + _number(file, 4)
            continue
        if magic != _MAGIC:
            raise ValueError(f"no zstd frame at byte {at}")
        start, filled = at, False
        flags = _number(file, 1)
        single, checksum = flags >> 5 & 1, flags >> 2 & 1
        size_bytes = _SIZE_BYTES[flags >> 6] or single
        at += 5 + (0 if single else 1) + _DICTIONARY_BYTES[flags & 3] + size_bytes
        last = False
        while not last:
            file.seek(at)
            header = _number(file, 3)
            last, kind, length = bool(header & 1), header >> 1 & 3, header >> 3
            at += 3 + (1 if kind == 1 else length)  # a run of one byte is stored as that byte
            filled = filled or length > 0
        at += 4 * checksum
        if filled:
            starts.append(start)
    return starts


class _Frames(InputPartition):
    def __init__(self, path: str, start: int, end: int | None, previous: int | None):
        self.path, self.start, self.end, self.previous = path, start, end, previous


class _Limited(io.RawIOBase):
    """The bytes of a file from one offset, up to another one."""

    def __init__(self, file, start: int, end: int | None):
        self._file, self._left = file, None if end is None else end - start
        file.seek(start)

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        n = len(target) if self._left is None else min(len(target), self._left)
        data = self._file.read(n) if n else b""
        target[: len(data)] = data
        if self._left is not None:
            self._left -= len(data)
        return len(data)


def _decoded(file, start: int, end: int | None) -> io.BufferedReader:
    import zstandard

    raw = io.BufferedReader(_Limited(file, start, end), 1 << 20)
    unpacked = zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW).stream_reader(raw, read_across_frames=True)
    return io.BufferedReader(unpacked, 1 << 20)


def _ends_a_line(storage, inner: str, start: int, end: int) -> bool:
    """Whether the last byte of the frames from ``start`` to before ``end`` ends a line."""
    with storage.open_input_file(inner) as file:
        last, reader = b"", _decoded(file, start, end)
        while block := reader.read(1 << 20):
            last = block[-1:]
    return last in (b"\n", b"")


def partition_lines(path: str, start: int, end: int | None, previous: int | None = None) -> Iterator[bytes]:
    """The lines that start in the frames from ``start`` to before ``end`` (None: the end of the file).

    ``previous`` is the start of the last frame before ``start``; its last byte tells whether a line starts here.
    """
    storage, inner = storage_of(path)
    with storage.open_input_file(inner) as file:
        here = _decoded(file, start, end)
        if previous is not None and not _ends_a_line(storage, inner, previous, start):
            here.readline()  # the end of a line that the partition before reads
        line = b""
        for line in here:
            if line.endswith(b"\n"):
                yield line
        if line and not line.endswith(b"\n"):
            if end is None:
                yield line
            else:
                with storage.open_input_file(inner) as more:
                    yield line + _decoded(more, end, None).readline()


class ArchiveReader(DataSourceReader):
    def __init__(self, paths: Sequence[str], partition_bytes: int):
        self.paths, self.partition_bytes = list(paths), partition_bytes

    def partitions(self) -> list[InputPartition]:
        found = []
        for path in self.paths:
            storage, inner = storage_of(path)
            size = storage.get_file_info(inner).size
            with storage.open_input_file(inner) as file:
                starts = frame_starts(file, size)
            cuts = starts[:1]
            for s in starts[1:]:
                if s - cuts[-1] >= self.partition_bytes:
                    cuts.append(s)
            before = dict(zip(starts[1:], starts))
            found += [_Frames(path, a, b, before.get(a)) for a, b in zip(cuts, [*cuts[1:], None])]
        return found

    def read(self, partition: _Frames) -> Iterator[pa.RecordBatch]:
        lines: list[str] = []

        def batch() -> pa.RecordBatch:
            names = ["path", "line"]
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(lines)), pa.array(lines)], names=names)

        for line in partition_lines(partition.path, partition.start, partition.end, partition.previous):
            lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
            if len(lines) == _BATCH_LINES:
                yield batch()
                lines = []
        if lines:
            yield batch()


class ArchiveSource(DataSource):
    """``spark.read.format("archive_frames")``: path and line of every line; options paths (one a line) and partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "archive_frames"

    def schema(self) -> str:
        return "path string, line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options["paths"].split("\n"), int(self.options.get("partition_bytes", PARTITION_BYTES)))


def read_framed_archives(
    spark: SparkSession, paths: Sequence[str], kind: str, partition_bytes: int = PARTITION_BYTES
) -> DataFrame:
    """The rows of zstd archives with the schema of ``kind``, ``source_file`` and ``bad_line``.

    A file of many frames is read by many tasks. A line that is no JSON object of the kind gives a row of nulls with the line in
    ``bad_line``, so it can be counted and kept; empty lines give none. Bytes that are not UTF-8 become replacement characters.
    """
    spark.dataSource.register(ArchiveSource)
    lines = spark.read.format("archive_frames").option("paths", "\n".join(paths)).option("partition_bytes", partition_bytes).load()
    schema = StructType([*BY_KIND[kind].fields]).add("bad_line", "string")
    row = F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line"})
    named = lines.filter(F.trim("line") != "").select(row.alias("row"), F.element_at(F.split("path", "/"), -1).alias("source_file"))
    return named.select(*[F.col(f"row.{f.name}").alias(f.name) for f in BY_KIND[kind].fields], "source_file", F.col("row.bad_line").alias("bad_line"))

"""Gzip lines as data sources: files are streamed, never held whole, with true line numbers and the compressed bytes read so far.

``spark.read.format("gzip_lines").load(path)`` gives path, line_no (from 1, blank lines counted), value, read_bytes (compressed
bytes read when the line was) and file_bytes, a task for each file; as a stream new files are read once, in the order of their
time and name. ``gzip_checksums`` gives path, length and sha256 of any file, hashed piece by piece.
Paths are folders, files or patterns (``*``) of any store that Arrow's file systems know.
"""

from __future__ import annotations

import fnmatch
import hashlib
import posixpath
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Compressed bytes that are read at once, and rows that are handed on at once.
PIECE, ROWS = 1 << 20, 4096


def _opened(path: str):
    """(file system, path within it)."""
    import pyarrow.fs as fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


@dataclass
class Found(InputPartition):
    """A file: its full path, size and time of change in nanoseconds."""

    path: str
    size: int
    changed: int


def listed(path: str) -> list[Found]:
    """The files of a folder, a pattern or a path, by time of change, then name."""
    import pyarrow.fs as fs

    system, inside = _opened(path.rstrip("/"))
    prefix = path.rstrip("/").removesuffix(inside) if "://" in path else ""
    head, last = posixpath.split(inside)
    if "*" in last:
        infos = [i for i in system.get_file_info(fs.FileSelector(head)) if fnmatch.fnmatch(i.base_name, last)]
    else:
        info = system.get_file_info(inside)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        infos = system.get_file_info(fs.FileSelector(inside)) if info.type == fs.FileType.Directory else [info]
    files = [i for i in infos if i.type == fs.FileType.File and not i.base_name.startswith(("_", "."))]
    return sorted((Found(prefix + i.path, i.size, i.mtime_ns or 0) for i in files), key=lambda f: (f.changed, f.path))


def lines_of(file: Found, piece: int = PIECE) -> Iterator[tuple[int, bytes, int]]:
    """(line number, line, compressed bytes read) of a gzip file of one or more members; one that breaks off raises.

    What is held is one piece, unpacked, and the line that goes on behind it.
    """
    system, inside = _opened(file.path)
    number, rest, read = 0, b"", 0
    unpack = zlib.decompressobj(31)
    with system.open_input_stream(inside, compression=None) as source:
        while packed := source.read(piece):
            read += len(packed)
            while packed:
                if unpack.eof:  # the next member
                    unpack = zlib.decompressobj(31)
                rest += unpack.decompress(packed, piece)
                packed = unpack.unconsumed_tail or (unpack.unused_data if unpack.eof else b"")
                *whole, rest = rest.split(b"\n")
                for line in whole:
                    number += 1
                    yield number, line.removesuffix(b"\r"), read
    if read and not unpack.eof:
        raise EOFError(f"{file.path} breaks off")
    if rest:
        yield number + 1, rest.removesuffix(b"\r"), read


def _rows(file: Found):
    import pyarrow as pa

    held: list[tuple[int, bytes, int]] = []

    def batch():
        numbers, texts, read = zip(*held, strict=True)
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array([file.path] * n), pa.array(numbers, pa.int64()), pa.array([t.decode("utf-8", "replace") for t in texts]), pa.array(read, pa.int64()), pa.array([file.size] * n, pa.int64())], ["path", "line_no", "value", "read_bytes", "file_bytes"])

    for row in lines_of(file):
        held.append(row)
        if len(held) == ROWS:
            yield batch()
            held.clear()
    if held:
        yield batch()


class LinesReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        return listed(self.path)

    def read(self, partition):
        yield from _rows(partition)


class LinesStream(DataSourceStreamReader):
    """An offset names the last file that was read, by its time of change and name."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.path)
        return {"changed": files[-1].changed, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        key = lambda x: (x["changed"], x["path"])
        return [f for f in listed(self.path) if key(start) < (f.changed, f.path) <= key(end)]

    def read(self, partition):
        yield from _rows(partition)


class GzipLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gzip_lines"

    def schema(self) -> str:
        return "path string, line_no long, value string, read_bytes long, file_bytes long"

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LinesStream(self.options["path"])


class ChecksumReader(LinesReader):
    def read(self, partition):
        digest, length = hashlib.sha256(), 0
        system, inside = _opened(partition.path)
        with system.open_input_stream(inside, compression=None) as source:
            while piece := source.read(PIECE):
                digest.update(piece)
                length += len(piece)
        yield (partition.path, length, digest.hexdigest())


class Checksums(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gzip_checksums"

    def schema(self) -> str:
        return "path string, length long, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return ChecksumReader(self.options["path"])


def register(spark: SparkSession) -> None:
    from larkspur.session import ship

    ship(spark)
    for source in (GzipLines, Checksums):
        spark.dataSource.register(source)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("gzip_lines").load(path)


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("gzip_lines").load(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("gzip_checksums").load(path)


def stream_files(spark: SparkSession, folder: str, files_per_batch: int = 8) -> DataFrame:
    """The gzip files of a folder as a stream of names and sizes, so many a batch; contents are not read here."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.gz").option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "length")


def lines_of_files(files: DataFrame) -> DataFrame:
    """The lines of named files (path, length), as ``read_lines`` gives them; a file is one task's."""
    from larkspur.session import ship

    ship(files.sparkSession)

    def run(batches):
        for batch in batches:
            for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from _rows(Found(path, size, 0))

    return files.select("path", "length").mapInArrow(run, "path string, line_no long, value string, read_bytes long, file_bytes long")


def progress(lines: DataFrame) -> DataFrame:
    """Per file how far its lines go: path, lines, read_bytes, file_bytes, share. Whole files have a share of 1."""
    from pyspark.sql import functions as F

    done = lines.groupBy("path").agg(F.max("line_no").alias("lines"), F.max("read_bytes").alias("read_bytes"), F.first("file_bytes").alias("file_bytes"))
    return done.withColumn("share", F.col("read_bytes") / F.col("file_bytes"))

"""Dictionary-compressed WARC archives.

Each file starts with a skippable frame (magic 0x184D2A5D) that embeds a Zstandard
dictionary built from the first records of that file; every record follows as a frame of
its own, compressed with that dictionary, so any record can be read given its offset and
the dictionary. Empty skippable frames separate what the writer's rows wrote; every
Zstandard reader passes over them.

Files are written by Spark's own committed writer: retries leave no half files and any
storage that Spark knows will do. The dictionary is trained in the task that writes the
file, on at most ``TRAIN_BYTES`` of records that wait in memory for it; nothing goes to the
driver.

Records with equal payloads of at least ``MIN_REVISIT`` bytes are stored once: the one
with the smallest page_id is a response, the others are revisit records that name it, its
digest and its length. Equality is that of SHA-256 digests and lengths.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import scratch, utf8_size

DICTIONARY_MAGIC = 0x184D2A5D

#: An empty skippable frame; all its bytes are ASCII, so the text writer can put it between rows.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")

#: Smallest payload that may be a revisit; dictionary size; records' bytes that it is trained on.
MIN_REVISIT, DICTIONARY_BYTES, TRAIN_BYTES = 100, 64 << 10, 4 << 20

#: Part of a record that is used for training; compressed bytes of a written row, and rows of a file.
TRAIN_RECORD, ROW_BYTES, FILE_ROWS = 64 << 10, 1 << 20, 64

#: Bytes of an archive that are handed to the decompressor first for each record.
FIRST_SLICE = 1 << 10

LEVEL = 3
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _header(value: object) -> str:
    """One line: what would break a header line is written as a percent escape."""
    return "".join(c if c not in "%\r\n" else f"%{ord(c):02X}" for c in str(value))


def _unheader(value: str) -> str:
    for code, c in (("%0D", "\r"), ("%0A", "\n"), ("%25", "%")):
        value = value.replace(code, c)
    return value


def record_bytes(name: str, date: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, refers_url: str | None = None) -> bytes:
    """A WARC/1.1 record of the given id and date; a revisit (of the page ``refers_to``) has no block but keeps the digest and the length of its payload."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Date: {date}",
        *([] if url is None else [f"WARC-Target-URI: {_header(url)}"]),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to}"] if revisit else []),
        *([] if refers_url is None else [f"WARC-Refers-To-Target-URI: {_header(refers_url)}"]),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's block doesn't end where its length says")
    return fields, rest[:size]


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary, or one of raw content where there is too little to train on."""
    samples = [r[:TRAIN_RECORD] for r in records]
    total = sum(map(len, samples))
    if len(samples) >= 16 and total >= 16 * 1024:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 8), samples, k=256, d=8)
        except zstandard.ZstdError:
            pass  # too uniform to train on
    return zstandard.ZstdCompressionDict((b"".join(samples)[:4096] or b"WARC/1.1").ljust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def dictionary_frame(dictionary: zstandard.ZstdCompressionDict) -> bytes:
    data = dictionary.as_bytes()
    return struct.pack("<II", DICTIONARY_MAGIC, len(data)) + data


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive file."""
    at, reader = 0, None
    while at < len(content):
        magic = int.from_bytes(content[at : at + 4], "little")
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            size = int.from_bytes(content[at + 4 : at + 8], "little")
            if magic == DICTIONARY_MAGIC:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[at + 8 : at + 8 + size]))
            at += 8 + size
            continue
        if reader is None:
            raise ValueError("records stand before the dictionary")
        data, at = _frame(reader, content, at)
        yield parse_record(data)


def _frame(reader: zstandard.ZstdDecompressor, content: bytes, at: int) -> tuple[bytes, int]:
    """The content of the frame at ``at``, and where it ends. Frames don't say how long they are, so the reader gets slices that
    double: what is handed to it beyond the frame's end is less than the frame and ``FIRST_SLICE`` together, whatever follows."""
    machine, parts, step = reader.decompressobj(), [], FIRST_SLICE
    while not machine.eof:
        part = content[at : at + step]
        if not part:
            raise ValueError("an archive ends inside a record")
        parts.append(machine.decompress(part))
        at += len(part)
        step *= 2
    return b"".join(parts), at - len(machine.unused_data)


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, size, digest, refers_to, refers_url: which rows are revisits, and of what.

    Digests are grouped with partial sums before the shuffle; only rows of a digest that
    occurs more than once join its smallest page_id, on narrow rows that Spark may split
    where one digest has a large share. Rows whose page_id is null are never revisits; of
    rows with the same page_id and payload none revisits the other.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", utf8_size("html").alias("size"), F.sha2(payload, 256).alias("digest"))
    narrow = rows.where(F.col("size") >= MIN_REVISIT).where("page_id IS NOT NULL").select("page_id", "url", "size", "digest")
    firsts = narrow.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.min_by("url", "page_id").alias("refers_url")).where("first < last")
    revisits = narrow.drop("url").join(firsts, ["digest", "size"]).where("page_id > first").select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to"), "refers_url").distinct()
    return rows.join(revisits, (F.col("page_id") == F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").drop("_page", "_digest")


def write_archives(pages: DataFrame, folder: str, date: str | None = None) -> None:
    """Write a record for each row of page_id, url and html (null: empty payload).

    ``date`` is the time of all records, as WARC-Date has it; by default that of this call.
    Record ids are unique over the archives, also where a page_id repeats or is null.
    """
    date, job = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), uuid.uuid4()

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        waiting: list[bytes] = []  # records of a new file, until there are enough for its dictionary
        held, writer, row, size, filed = 0, None, [], 0, 0

        def start():
            nonlocal writer, row, size
            dictionary = build_dictionary(waiting)
            writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
            row = [dictionary_frame(dictionary), *map(writer.compress, waiting)]
            size = sum(map(len, row))
            waiting.clear()

        def flush():
            nonlocal writer, row, size, held, filed
            out = pa.RecordBatch.from_arrays([pa.array([b"".join(row)], pa.binary())], ["value"])
            row, size, filed = [], 0, filed + 1
            if filed % FILE_ROWS == 0:  # the writer starts its next file here
                writer, held = None, 0
            return out

        for batch in batches:
            for page_id, url, html, *rest in zip(*batch.columns, strict=True):
                name, number = uuid.uuid5(job, f"{part}/{number}").urn, number + 1
                record = record_bytes(name, date, page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), *(x.as_py() for x in rest))
                if writer is None:
                    waiting.append(record)
                    held += len(record)
                    if held >= TRAIN_BYTES:
                        start()
                else:
                    row.append(writer.compress(record))
                    size += len(row[-1])
                if size >= ROW_BYTES:
                    yield flush()
        if waiting:
            start()
        if row:
            yield flush()

    rows = plan_records(pages).select("page_id", "url", "html", "digest", "size", "refers_to", "refers_url")
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", FILE_ROWS).text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Per record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit).

    A response's length and digest are computed from its payload and checked against its header.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in read_archive(content.as_py()):
                    revisit = fields["WARC-Type"] == "revisit"
                    digest, size = fields["WARC-Payload-Digest"].partition(":")[2], int(fields["X-Payload-Length"])
                    if not revisit and (len(block) != size or hashlib.sha256(block).hexdigest() != digest):
                        raise ValueError("a payload doesn't match its digest")
                    name, of = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                    rows.append((None if name is None else int(name), _unheader(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None, size, digest, fields["WARC-Type"], None if of is None else int(of), None if revisit else block))
                    if len(rows) == 256:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    def _batch(rows):
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*"abcdefg"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return files.select("content").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives and read them back; one row per page, without the payload.

    Null html is an empty payload; repeated rows are repeated records; other columns are
    not read; an empty table gives no archive and an empty result.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    write_archives(pages, folder)
    return read_archives(spark, folder).drop("payload")

"""Token-id files of patched frame-of-reference blocks.

Layout of a file: segments, each followed by one newline (the separator of the writer).
A segment holds whole documents and is self-contained:

    magic "LPF1" | u64 bytes of the segment | u32 part | u32 sequence in part | u64 first id in part
    u16 ids per block | u32 documents | u64 ids | u32 blocks
    doc ids (i64 each) | flags (u8 each, 1: the doc_id is null) | lengths (u32 each)
    block starts (u64 each, from the start of the block area) | block area

    block: u32 minimum | u8 width | u16 exceptions | ids * width packed bits
           | exception positions (u16 each) | exception values (u32 each, above the minimum)

All numbers are little-endian. A block subtracts its minimum and packs the rest at the
width that holds ``PERCENTILE`` of its values; the others are exceptions, whose full
values are patched in. Block starts make any range of ids readable by itself
(``read_range``). Files are written by Spark's own committed writer, so retried and
speculative tasks leave no half files, and on any storage that Spark knows.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.bpe import byte_letters
from larkspur.llm.common import scratch, shuffle_parts, written
from larkspur.llm.pieces import RUN, piece_runs, pieces, special_matcher, split_specials

MAGIC, HEAD = b"LPF1", struct.Struct("<4sQIIQHIQI")
BLOCK, PERCENTILE = 256, 0.90

#: Ids after which a segment ends at the next document; segments per file.
SEGMENT_IDS, FILE_SEGMENTS = 1 << 19, 32

#: Characters that are encoded together; distinct pieces, and their characters, kept per worker; the longest piece that outlasts a trimming.
BATCH_CHARS, CACHED_PIECES, CACHED_CHARS, LONGEST_KEPT = 1 << 20, 400_000, 8 << 20, 48


def _widths(values: np.ndarray, percentile: float) -> np.ndarray:
    """Bits per row of a 2-d array that hold that share of its values."""
    rank = min(values.shape[1] - 1, int(np.ceil(percentile * values.shape[1])) - 1)
    at = np.partition(values, rank, axis=1)[:, rank]
    return np.where(at == 0, 0, np.floor(np.log2(np.maximum(at, 1))).astype(np.int64) + 1).astype(np.uint8)


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, most significant bit first; eight values fill ``width`` bytes."""
    values = (rows.astype(np.uint64) & np.uint64((1 << width) - 1)).reshape(len(rows), -1, 8)
    out = np.zeros((len(rows), values.shape[1], width + 5), np.uint8)
    for k in range(8):
        byte, shift = divmod(k * width, 8)
        spread = values[:, :, k] << np.uint64(40 - width - shift)
        for t in range((width + shift + 7) // 8):
            out[:, :, byte + t] |= (spread >> np.uint64(32 - 8 * t)).astype(np.uint8)
    return np.ascontiguousarray(out[:, :, :width]).reshape(len(rows), -1)


def _unpack(packed: np.ndarray, width: int, size: int) -> np.ndarray:
    bit = np.arange(size) * width
    byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
    padded = np.zeros((len(packed), packed.shape[1] + 5), np.uint8)
    padded[:, : packed.shape[1]] = packed
    found = np.zeros((len(packed), size), np.uint64)
    taken = (width + 14) // 8
    for t in range(taken):
        found = (found << np.uint64(8)) | padded[:, byte + t]
    return ((found >> (np.uint64(8 * taken - width) - shift)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """Block starts and the block area of an array of unsigned 32-bit ids; the last block repeats its last id."""
    if not len(ids):
        return np.zeros(0, "<u8"), b""
    rows = np.concatenate([ids, np.repeat(ids[-1:], -len(ids) % block)]).astype(np.uint32).reshape(-1, block)
    low = rows.min(axis=1)
    rest = rows - low[:, None]
    widths = _widths(rest, percentile)
    packed: dict[int, np.ndarray] = {}
    order = np.zeros(len(rows), np.int64)
    for width in np.unique(widths):
        chosen = np.flatnonzero(widths == width)
        order[chosen] = np.arange(len(chosen))
        if width:
            packed[int(width)] = np.concatenate([_pack(rest[chosen[i : i + 512]], int(width)) for i in range(0, len(chosen), 512)])
    over = rest > np.where(widths >= 32, np.uint32(0xFFFFFFFF), (np.uint64(1) << widths.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)[:, None]
    counts = over.sum(axis=1)
    out, starts, at = [], np.zeros(len(rows), "<u8"), 0
    for i, width in enumerate(widths.tolist()):
        blob = struct.pack("<IBH", int(low[i]), width, int(counts[i])) + (packed[width][order[i]].tobytes() if width else b"")
        if counts[i]:
            where = np.flatnonzero(over[i])
            blob += where.astype("<u2").tobytes() + rest[i][where].astype("<u4").tobytes()
        starts[i] = at
        at += len(blob)
        out.append(blob)
    return starts, b"".join(out)


def unpack_blocks(area: memoryview, starts: np.ndarray, block: int) -> np.ndarray:
    """The ids of all blocks that the starts name, the padding of the last one included."""
    heads = [struct.unpack_from("<IBH", area, int(s)) for s in starts]
    out = np.zeros((len(heads), block), np.uint32)
    widths = np.array([h[1] for h in heads], np.int64)
    flat = np.frombuffer(area, np.uint8)
    for width in np.unique(widths[widths > 0]):
        size = -(-block * int(width) // 8)
        chosen = np.flatnonzero(widths == width)
        for i in range(0, len(chosen), 512):
            some = chosen[i : i + 512]
            packed = flat[(starts[some].astype(np.int64) + 7)[:, None] + np.arange(size)]
            out[some] = _unpack(packed, int(width), block)
    for i, (_, width, exceptions) in enumerate(heads):
        if exceptions:
            at = int(starts[i]) + 7 + -(-block * width // 8)
            where = np.frombuffer(area, "<u2", exceptions, at)
            out[i][where] = np.frombuffer(area, "<u4", exceptions, at + 2 * exceptions)
    out += np.array([h[0] for h in heads], np.uint32)[:, None]
    return out.reshape(-1)


def write_segment(part: int, sequence: int, first: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    starts, area = pack_blocks(ids)
    body = b"".join(
        (
            np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(), np.array(lengths, "<u4").tobytes(),
            starts.tobytes(), area,
        )
    )
    return HEAD.pack(MAGIC, HEAD.size + len(body), part, sequence, first, BLOCK, len(doc_ids), len(ids), len(starts)) + body


class Segment:
    """A view of one segment inside a buffer."""

    def __init__(self, data: memoryview):
        magic, self.size, self.part, self.sequence, self.first, self.block, docs, self.n_ids, blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment of patched frame-of-reference blocks")
        at = HEAD.size
        nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if null else x for x, null in zip(np.frombuffer(data, "<i8", docs, at).tolist(), nulls.tolist(), strict=True)]
        self.lengths = np.frombuffer(data, "<u4", docs, at + 9 * docs)
        at += 13 * docs
        self.starts = np.frombuffer(data, "<u8", blocks, at)
        self.area = data[at + 8 * blocks : self.size]

    def ids(self) -> np.ndarray:
        return unpack_blocks(self.area, self.starts, self.block)[: self.n_ids]

    def read_range(self, first: int, count: int) -> np.ndarray:
        """Ids first to first + count of this segment; only their blocks are decoded."""
        count = max(0, min(count, self.n_ids - first))
        if not count:
            return np.zeros(0, np.uint32)
        low, high = first // self.block, (first + count - 1) // self.block + 1
        return unpack_blocks(self.area, self.starts[low:high], self.block)[first - low * self.block :][:count]


def read_segments(content: bytes) -> Iterator[Segment]:
    view, at = memoryview(content), 0
    while at < len(content):
        segment = Segment(view[at:])
        yield segment
        at += segment.size + 1


class LibraryEncoder:
    """Ids of the tokenizers library's byte-level BPE model, which encodes each distinct piece once; later ones are looked up."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("not a file of a byte-level BPE tokenizer")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.model = BPE(vocab=spec["model"]["vocab"], merges=merges, cache_capacity=0)
        self.specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.matcher = special_matcher(self.specials)
        self.letters = [byte_letters()[b] for b in range(256)]
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.seen = (np.zeros(1 << 14, np.int32) for _ in range(3))

    def _trim(self) -> None:
        """Keep the short pieces that were met most, half of the table at most and none that was met once only."""
        known = len(self.number)
        seen = self.seen[:known]
        kept = np.flatnonzero(seen >= max(2, np.partition(seen, known // 2)[known // 2] + 1))
        names, sizes, starts = list(self.number), self.length[kept], self.start[kept]
        ends = np.cumsum(sizes, dtype=np.int64)
        ids = self.ids[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        names = [names[i] for i in kept.tolist()]
        short = np.array([len(x) <= LONGEST_KEPT for x in names], bool)
        self.clear()
        self._store([x for x, s in zip(names, short.tolist(), strict=True) if s], ids[np.repeat(short, sizes)], sizes[short].astype(np.int64))

    def _learn(self, new: list[str]) -> None:
        letters, tokenize = self.letters, self.model.tokenize
        blank = letters[32]
        # most pieces are a blank and ASCII letters, each of which stands for itself
        spelled = [blank + p[1:] if p[0] == " " and p[1:].isalpha() and p.isascii() else "".join([letters[b] for b in p.encode()]) for p in new]
        found = [[t.id for t in tokenize(piece)] for piece in spelled]
        self._store(new, np.array(list(chain.from_iterable(found)), np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def _store(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        known = len(self.number)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while known + len(names) > len(self.start):
            self.start, self.length, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.seen))
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[known : known + len(names)] = self.used + np.cumsum(sizes) - sizes
        self.length[known : known + len(names)] = sizes
        self.used += len(ids)
        self.chars += sum(map(len, names))
        self.number.update(zip(names, range(known, known + len(names)), strict=True))

    def _run(self, run: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a run of pieces, and the number of ids up to each piece's end."""
        if not run:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.number) > CACHED_PIECES or self.chars > CACHED_CHARS:
            self._trim()
        number = self.number
        codes = list(map(number.get, run))
        if None in codes:
            unseen = [i for i, c in enumerate(codes) if c is None]
            self._learn(list({run[i] for i in unseen}))
            for i in unseen:
                codes[i] = number[run[i]]
        at = np.array(codes, np.int64)
        self.seen[: len(number)] += np.bincount(at, minlength=len(number)).astype(np.int32)
        sizes = self.length[at]
        ends = np.cumsum(sizes, dtype=np.int32)
        return self.ids[np.repeat(self.start[at] - ends + sizes, sizes) + np.arange(ends[-1], dtype=np.int32)], ends

    def encode_many(self, texts: list[str], end: int) -> list[np.ndarray]:
        """The ids of each text and the end id; short texts are looked up together."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        group, sizes, at = [], [], []
        for i, text in enumerate(texts):
            if any(x in text for x in self.specials) or len(text) > RUN:
                parts = []
                for stretch in split_specials(text, self.specials, self.matcher):
                    parts += [np.array([stretch], np.uint32)] if isinstance(stretch, int) else [self._run(r)[0] for r in piece_runs(stretch)]
                out[i] = np.concatenate([*parts, np.array([end], np.uint32)])
            else:
                found = pieces(text)
                group += found
                sizes.append(len(found))
                at.append(i)
        if at:
            ids, ends = self._run(group)
            edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
            for k, i in enumerate(at):
                out[i] = np.append(ids[edges[k] : edges[k + 1]], np.uint32(end))
        return out


@lru_cache(2)
def _encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """doc ids and texts in groups of about BATCH_CHARS characters."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(doc_id.as_py())
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size >= BATCH_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def write_token_files(docs: DataFrame, path: str, folder: str, end: int) -> None:
    """Encode every text (null: empty), append ``end`` to each, and write the files in ascending doc_id order.

    Rows are dealt by range of (doc_id, checksum of the text), so that a doc_id that
    repeats without end still spreads; rows that agree in both are interchangeable. Null
    doc_ids come first. Parts are numbered in that order.
    """

    def run(batches):
        encoder, part = _encoder(path), TaskContext.get().partitionId()
        sequence = first = 0
        doc_ids, lengths, ids, total = [], [], [], 0
        for names, texts in _texts(batches):
            for name, found in zip(names, encoder.encode_many(texts, end), strict=True):
                doc_ids.append(name)
                lengths.append(len(found))
                ids.append(found)
                total += len(found)
                if total >= SEGMENT_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([write_segment(part, sequence, first, doc_ids, lengths, np.concatenate(ids))], pa.binary())], ["value"])
                    sequence, first = sequence + 1, first + total
                    doc_ids, lengths, ids, total = [], [], [], 0
        if doc_ids:
            yield pa.RecordBatch.from_arrays([pa.array([write_segment(part, sequence, first, doc_ids, lengths, np.concatenate(ids))], pa.binary())], ["value"])

    keyed = docs.select("doc_id", "text", F.crc32(F.col("text").cast("binary")).alias("_crc"))
    parts = shuffle_parts(docs.sparkSession)
    dealt = keyed.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("_crc")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_crc")
    segments = dealt.select("doc_id", "text").mapInArrow(run, "value binary")
    segments.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_SEGMENTS).text(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: part, its first id within the part, doc_id, n_tokens, ids_crc32."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                for segment in read_segments(content.as_py()):
                    ids = segment.ids().astype("<u4")
                    ends = np.cumsum(segment.lengths, dtype=np.int64)
                    begins = ends - segment.lengths
                    sums = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([segment.part] * len(sums), pa.int32()), pa.array(segment.first + begins, pa.int64()),
                            pa.array(segment.doc_ids, pa.int64()), pa.array(segment.lengths.astype(np.int64), pa.int64()), pa.array(sums, pa.int64()),
                        ],
                        ["part", "first", "doc_id", "n_tokens", "ids_crc32"],
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(run, "part int, first long, doc_id long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str, end: int, folder: str | None = None) -> DataFrame:
    """Write ``docs`` to files and read them back: doc_id, start, n_tokens, ids_crc32 per document.

    ``start`` counts the ids of all documents before it. A null or empty text has only the
    end id; an empty table gives an empty result; other columns are not read. The part
    totals, one row per part, are the only thing that is summed in one place.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    write_token_files(docs, path, folder, end)
    rows = written(read_token_files(spark, folder), "token-rows")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(bases, "part").select("doc_id", (F.col("_base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "part")

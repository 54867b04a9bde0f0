"""BPE encoding and decoding as bounded-lookahead streaming transducers.

Encoding. For a *proper* merge list (every part of a merge is a byte or the result of an
earlier merge) the tokens of a prefix can differ from the tokens of the whole text only
near the prefix's end. Let F be the last boundary up to which both agree. At merge
(u, v) F moves left, by len(u), only if exactly one of the two runs has v starting at F.
After that, the token starting at F in either run is u or something grown from u to the
right, so u is on the left spine of it. A chain of moves is thus a sequence of merges of
rising rank, each v having the previous u on its left spine, and the sum of the len(u) of
the heaviest chain is a lookahead that suffices: every token that ends at least that many
bytes before the end of what has been read is final, and encoding can restart behind it.
One pass over the merge list computes it (``sufficient_lookahead``); it is a few hundred
bytes for public 50k vocabularies. ``PieceStream`` keeps a buffer of a fixed number of
bytes and emits tokens as they become stable.

Decoding. ``TextStream`` is the inverse machine: ids go in, bytes come out of a table and
run through an incremental UTF-8 automaton (malformed sequences become U+FFFD, one per
maximal subpart); it holds at most three bytes between steps.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from larkspur.llm.common import rest_worker
from larkspur.llm.pieces import piece_runs, special_matcher, split_specials

#: Pieces up to this many characters are kept; the table starts anew beyond so many entries.
CACHED_CHARS, CACHED_PIECES = 48, 150_000

#: How a pair's rank and the resulting id share one integer; NONE stands for a pair that never merges.
ID_BITS = 24
ID_MASK, NONE = (1 << ID_BITS) - 1, 1 << 62


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def sufficient_lookahead(merges: Iterable[tuple[bytes, bytes]]) -> int | None:
    """Bytes of lookahead after which a token can no longer change; None if the list isn't proper."""
    left_of: dict[bytes, bytes] = {}
    reach: dict[bytes, int] = {}
    most = 0
    for u, v in merges:
        if any(len(x) > 1 and x not in left_of for x in (u, v)) or u + v in left_of:
            return None
        spine, before = v, 0
        while True:
            before = max(before, reach.get(spine, 0))
            if spine not in left_of:
                break
            spine = left_of[spine]
        reach[u] = max(reach.get(u, 0), before + len(u))
        most = max(most, reach[u])
        left_of[u + v] = u
    return most


class MergeModel:
    """Vocabulary, ranked merges, special strings and the lookahead of a byte-level BPE file."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]], specials: dict[str, int] | None = None):
        self.vocab, self.specials = vocab, specials or {}
        self.matcher = special_matcher(self.specials)
        shared = self.shared = {i: i for i in vocab.values()}  # one int object per id, however often it is kept
        self.code: dict[tuple[int, int], int] = {}  # of a pair: its rank, then the id it becomes
        for r, (u, v) in enumerate(merges):
            self.code.setdefault((shared[vocab[u]], shared[vocab[v]]), r << ID_BITS | vocab[u + v])
        self.byte_ids = [shared.get(vocab.get(bytes([b]))) for b in range(256)]
        self.bytes_of = {i: t for t, i in vocab.items()} | {i: s.encode() for s, i in self.specials.items()}
        self.table = [self.bytes_of.get(i) for i in range(max(self.bytes_of, default=-1) + 1)]
        self.lookahead = sufficient_lookahead(merges)
        self.longest = max(map(len, vocab), default=1)
        self.kept: dict[str, tuple[int, ...]] = {}

    @classmethod
    def from_file(cls, path: str) -> MergeModel:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_letters().items()}
        raw = lambda token: bytes(back[c] for c in token)
        specials = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in specials}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        return cls(vocab, [(raw(u), raw(v)) for u, v in merges], specials)

    def merge(self, data: bytes) -> list[int]:
        """Tokens of bytes taken as a whole: lowest rank first, leftmost first among equals."""
        ids = [i for i in map(self.byte_ids.__getitem__, data) if i is not None]
        return self._merge_few(ids) if len(ids) <= 24 else self._merge_many(ids)

    def _merge_few(self, ids: list[int]) -> list[int]:
        get = self.code.get
        codes = [get(pair, NONE) for pair in zip(ids, ids[1:])]
        while codes and (best := min(codes)) != NONE:
            i = codes.index(best)
            new = self.shared[best & ID_MASK]
            ids[i : i + 2] = [new]
            del codes[i]
            if i < len(codes):
                codes[i] = get((new, ids[i + 1]), NONE)
            if i:
                codes[i - 1] = get((ids[i - 1], new), NONE)
        return ids

    def _merge_many(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.code.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(code, i, ids[i], ids[i + 1]) for i in range(n - 1) if (code := get((ids[i], ids[i + 1]), NONE)) != NONE]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            code, i, left, right = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != left or ids[j] != right:
                continue
            ids[i], alive[j] = self.shared[code & ID_MASK], False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (code := get((ids[a], ids[b]), NONE)) != NONE:
                    heapq.heappush(heap, (code, a, ids[a], ids[b]))
        return [x for x, here in zip(ids, alive, strict=True) if here]

    def piece(self, piece: str) -> tuple[int, ...]:
        """Tokens of one piece; ordinary pieces are looked up, long ones streamed."""
        found = self.kept.get(piece)
        if found is None:
            data = piece.encode()
            found = tuple(self.merge(data) if len(data) <= 64 else PieceStream(self).run([data]))
            if len(piece) <= CACHED_CHARS:
                if len(self.kept) >= CACHED_PIECES:
                    self.kept.clear()
                self.kept[piece] = found
        return found

    def encode_runs(self, text: str) -> Iterator[list[int]]:
        """Ids of a text in runs of bounded length; special strings are single ids, as the library's default has it."""
        kept = self.kept
        for part in split_specials(text, self.specials, self.matcher):
            if isinstance(part, int):
                yield [part]
                continue
            for run in piece_runs(part):
                yield list(chain.from_iterable([kept.get(p) or self.piece(p) for p in run]))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_runs(text)))


class PieceStream:
    """Encodes the bytes of one piece as they arrive, in constant memory."""

    def __init__(self, model: MergeModel):
        self.model, self.buffer = model, b""
        self.room = None if model.lookahead is None else 3 * model.lookahead + model.longest

    def feed(self, data: bytes) -> Iterator[int]:
        """Tokens that can no longer change."""
        if self.room is None:
            self.buffer += data
            return
        for at in range(0, len(data), self.room):
            self.buffer += data[at : at + self.room]
            if len(self.buffer) < self.room:
                continue
            stable, done = len(self.buffer) - self.model.lookahead, 0
            for token in self.model.merge(self.buffer):
                size = len(self.model.bytes_of[token])
                if done + size > stable:
                    break
                done += size
                yield token
            self.buffer = self.buffer[done:]

    def close(self) -> Iterator[int]:
        yield from self.model.merge(self.buffer)
        self.buffer = b""

    def run(self, chunks: Iterable[bytes]) -> Iterator[int]:
        for chunk in chunks:
            yield from self.feed(chunk)
        yield from self.close()


class TextStream:
    """Turns ids into text step by step; at most three bytes wait between steps."""

    def __init__(self, model: MergeModel):
        self.table, self.automaton = model.table, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.automaton.decode(b"".join([self.table[i] for i in ids]))

    def close(self) -> str:
        return self.automaton.decode(b"", True)


@lru_cache(2)
def model_at(path: str) -> MergeModel:
    """One model, with its table of pieces, per Python worker."""
    return MergeModel.from_file(path)


@lru_cache(2)
def _decimal(path: str) -> list[str]:
    return [str(i) for i in range(max(model_at(path).bytes_of) + 1)]


def digest_text(text: str | None, path: str) -> tuple[int, str, str]:
    """Token count, digest of the decimal ids and digest of the text decoded from them."""
    model, names = model_at(path), _decimal(path)
    count, of_ids, of_text, back = 0, hashlib.sha256(), hashlib.sha256(), TextStream(model)
    for ids in model.encode_runs(text or ""):
        if ids:
            of_ids.update((("," if count else "") + ",".join([names[i] for i in ids])).encode())
            count += len(ids)
            of_text.update(back.feed(ids).encode())
    of_text.update(back.close().encode())
    return count, of_ids.hexdigest(), of_text.hexdigest()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``ids`` (array of int) of every row; a null text has none."""

    def run(batches):
        model = model_at(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.encode(t.as_py() or "") for t in part.column(1)], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; unknown ids raise."""

    def run(batches):
        model = model_at(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = []
                for ids in part.column(1).to_pylist():
                    stream = TextStream(model)
                    texts.append(stream.feed(ids or []) + stream.close())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens and the digests of nothing; repeated rows give
    repeated results; other columns are not read. There is no shuffle: a lost task is
    run again on its own rows.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [digest_text(t.as_py(), path) for t in part.column(1)]
                counts, of_ids, of_text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        rest_worker()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")

r"""Chat formatting with typed content parts.

A turn is written as ``<|turn:ROLE|>\n CONTENT \n<|end|>\n`` (without the blanks). A visitor
flattens a turn's parts in order: text is written escaped, every image, audio clip and
document becomes a placeholder ``<|KIND:N|>``, N counting the turn's attachments from 0,
and leaves a record of its reference and of the tokens that it will expand to.

Escaping is reversible: in text a backslash is doubled and ``<|`` becomes ``<\|``, so no
text can form a control string; in roles every ``|`` is escaped as well. The loss mask is a
list of code-point spans of the written turn: the text parts of assistant turns.

Formatting is a map over turns, so a conversation of any length spreads over all tasks.
Only the digests of a whole conversation need its turns in order; they are streamed through
sorted partitions with nothing held but the two running digests.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import shuffle_parts, written

PART_SCHEMA = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENT_SCHEMA = "array<struct<ordinal:int,kind:string,ref:string,tokens:long>>"
FORMATTED_SCHEMA = f"formatted string, loss_spans array<struct<start:long,stop:long>>, attachments {ATTACHMENT_SCHEMA}, text_chars long, attachment_tokens long"

HEAD = re.compile(r"<\|turn:((?:[^|\\]|\\.)*)\|>\n", re.DOTALL)
PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")
TAIL = "\n<|end|>\n"
ESCAPED = re.compile(r"\\([\\|])")
LEARNED_ROLES = frozenset({"assistant"})


@dataclass(frozen=True)
class Expansion:
    """Tokens that attachments expand to."""

    image_patch: int = 28
    image_extra: int = 2
    audio_per_second: float = 25.0
    document_per_page: int = 1024

    def image(self, width: int | None, height: int | None) -> int:
        return ceil((width or 0) / self.image_patch) * ceil((height or 0) / self.image_patch) + self.image_extra

    def audio(self, seconds: float | None) -> int:
        return ceil((seconds or 0.0) * self.audio_per_second)

    def document(self, pages: int | None) -> int:
        return (pages or 0) * self.document_per_page


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("|", "\\|")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


@dataclass
class PartVisitor:
    """Writes one turn; ``visit`` is called for each part in order."""

    role: str
    expansion: Expansion = field(default_factory=Expansion)

    def __post_init__(self):
        self.out = [f"<|turn:{escape_role(self.role)}|>\n"]
        self.at = len(self.out[0])
        self.spans: list[dict] = []
        self.attachments: list[dict] = []
        self.text_chars = 0

    def visit(self, part: dict) -> None:
        kind = part.get("kind") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown kind of content part: {kind!r}")
        method(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.text_chars += len(text)
        start = self.at
        self._write(escape(text))
        if self.role in LEARNED_ROLES and self.at > start:
            self.spans.append({"start": start, "stop": self.at})

    def visit_image(self, part: dict) -> None:
        self._attach("image", part, self.expansion.image(part.get("width"), part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, self.expansion.audio(part.get("seconds")))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, self.expansion.document(part.get("pages")))

    def close(self) -> str:
        self._write(TAIL)
        return "".join(self.out)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        number = len(self.attachments)
        self.attachments.append({"ordinal": number, "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        self._write(f"<|{kind}:{number}|>")

    def _write(self, text: str) -> None:
        if not text:
            return
        # "<" at the end of one text part and "|" at the start of the next must not meet as a control string
        if text.startswith("|") and self.out[-1].endswith("<"):
            text = "\\" + text
        self.out.append(text)
        self.at += len(text)


def format_turn(role: str | None, parts: Iterable[dict], expansion: Expansion = Expansion()) -> PartVisitor:
    """The visitor after all parts, closed; its ``out`` is the written turn. A null role is the empty string."""
    visitor = PartVisitor(role or "", expansion)
    for part in parts or ():
        visitor.visit(part or {})
    visitor.close()
    return visitor


def parse_turn(written_turn: str) -> tuple[str, list[str | tuple[str, int]]]:
    """Role, and the content as texts and (kind, ordinal) placeholders in order."""
    head = HEAD.match(written_turn)
    if not head or not written_turn.endswith(TAIL):
        raise ValueError("not a written turn")
    content, at, out = written_turn[head.end() : -len(TAIL)], 0, []
    for m in PLACEHOLDER.finditer(content):
        if m.start() > at:
            out.append(unescape(content[at : m.start()]))
        out.append((m.group(1), int(m.group(2))))
        at = m.end()
    if at < len(content):
        out.append(unescape(content[at:]))
    return unescape(head.group(1)), out


def format_turns(turns: DataFrame, expansion: Expansion = Expansion()) -> DataFrame:
    """Rows of role and parts (see PART_SCHEMA) with the written turn, its loss spans and its attachments; other columns stay."""
    others = [c for c in turns.columns if c not in ("role", "parts")]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                done = [format_turn(r.as_py(), p.as_py(), expansion) for r, p in zip(part.column(len(others)), part.column(len(others) + 1), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[: len(others)],
                        pa.array(["".join(v.out) for v in done], pa.string()),
                        pa.array([v.spans for v in done], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                        pa.array([v.attachments for v in done], pa.list_(pa.struct([("ordinal", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))),
                        pa.array([v.text_chars for v in done], pa.int64()),
                        pa.array([sum(a["tokens"] for a in v.attachments) for v in done], pa.int64()),
                    ],
                    [*others, "formatted", "loss_spans", "attachments", "text_chars", "attachment_tokens"],
                )

    fields = "".join(f"`{c}` {turns.schema[c].dataType.simpleString()}, " for c in others)
    return turns.select(*others, "role", F.col("parts").cast(PART_SCHEMA).alias("parts")).mapInArrow(run, fields + FORMATTED_SCHEMA)


class _Digest:
    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, written_turn: str, spans: list[dict]) -> None:
        role, content = parse_turn(written_turn)
        self.turns += 1
        self.chars += len(written_turn)
        self.all.update(f"{role}\n".encode())
        for text in content:
            if isinstance(text, str):
                self.all.update(text.encode())
        self.all.update(b"\n")
        for span in spans or ():
            text = unescape(written_turn[span["start"] : span["stop"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self, key: int | None) -> tuple:
        return key, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest_conversations(formatted: DataFrame, order: list[str]) -> DataFrame:
    """One row per conv_id from its written turns in the given order, read back from them."""

    def run(batches):
        key, state, rows = None, None, []
        for batch in batches:
            for conv_id, text, spans in zip(*batch.columns[:3], strict=True):
                now = conv_id.as_py()
                if state is None or now != key:
                    if state is not None:
                        rows.append(state.row(key))
                    key, state = now, _Digest()
                state.add(text.as_py(), spans.as_py())
            if rows:
                yield _batch(rows)
                rows = []
        if state is not None:
            yield _batch([state.row(key)])

    def _batch(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [*"abcdef"])

    parts = shuffle_parts(formatted.sparkSession)
    keys = [F.col("conv_id").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order]]
    dealt = formatted.select("conv_id", "formatted", "loss_spans", *order).repartition(parts, "conv_id").sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Write rows of conv_id, turn, role, text as turns, and digest each conversation from what was written.

    Turns are ordered by turn (null first), ties by role and written text; null text and
    null role are empty; rows without a conv_id form one conversation; repeated rows are
    repeated turns. An empty table gives an empty result.
    """
    turns = conversations.select("conv_id", "turn", F.col("role").alias("_role"), "role", F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))])).alias("parts"))
    return digest_conversations(written(format_turns(turns), "chat"), ["turn", "_role", "formatted"])


#: A conversation whose texts hold strings that look like controls, formatted along with the others.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def with_probe(conversations: DataFrame) -> DataFrame:
    rows = conversations.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(rows)

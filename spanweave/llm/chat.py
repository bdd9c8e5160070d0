"""Chat formatting with typed content parts.

A turn is `<turn ROLE>` line feed, its content, `</turn>` line feed. The characters that control strings are made of are
escaped inside roles and texts, so nothing that a text says can end a turn, open one or stand for an attachment, and
reading back restores every code point. Content is a list of typed parts; a visitor flattens text, image, audio and document parts
into one string with ordered placeholders `<image 0>`, records each attachment's reference and counts the tokens that the
placeholder will expand to.

Turns are formatted in a stream of rows sorted by conversation and turn, one row out for one row in, so a conversation of
any length takes bounded memory.

Defined results: a null text is empty, a null role is the empty role, a null turn sorts first, rows that tie on turn are
ordered by role and text; a null conversation id is a conversation of its own; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.session import ship_package

_ESCAPES = {"\\": "\\\\", "<": "\\l", ">": "\\g", "#": "\\h"}
_BACK = {v: k for k, v in _ESCAPES.items()}
_ESCAPED, _WRITTEN = re.compile(r"[\\<>#]"), re.compile(r"\\.", re.S)


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _WRITTEN.sub(lambda m: _BACK[m[0]], text)


@dataclass
class Flattened:
    """What the visitor has gathered of one turn."""

    text: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    expanded_tokens: int = 0


class PartVisitor:
    """Flattens parts {"type": ..., ...} in order; first is the number of the conversation's next attachment."""

    def __init__(self, first: int = 0, patch: int = 28, audio_tokens_a_second: float = 12.5, tokens_a_page: int = 256):
        self.first, self.patch, self.rate, self.page = first, patch, audio_tokens_a_second, tokens_a_page
        self.out = Flattened()

    def visit(self, parts: list[dict]) -> Flattened:
        for part in parts:
            handler = getattr(self, f"visit_{part.get('type')}", None)
            if handler is None:
                raise ValueError(f"unknown content part {part.get('type')!r}")
            handler(part)
        return self.out

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        if not isinstance(text, str | None):
            raise TypeError(f"the text of a part is a {type(text).__name__}")
        self.out.text.append(escape(text or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil((part.get(k) or self.patch) / self.patch) for k in ("width", "height"))
        self._attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.rate))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 1) * self.page)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        number = self.first + len(self.out.attachments)
        self.out.text.append(f"<{kind} {number}>")
        self.out.attachments.append({"number": number, "kind": kind, "ref": str(part.get("ref") or ""), "tokens": tokens})
        self.out.expanded_tokens += tokens


def parts_of(content: str) -> list[dict]:
    """The parts of a JSON list of objects; any other content is one part of plain text."""
    try:
        found = json.loads(content)
    except ValueError:
        found = None
    if isinstance(found, list) and all(isinstance(x, dict) for x in found):
        return found
    return [{"type": "text", "text": content}]


SCHEMA = "conv_id bigint, formatted string, begin bigint, loss_begin bigint, loss_end bigint, attachments array<struct<number:int,kind:string,ref:string,tokens:bigint>>, expanded_tokens bigint, error string"
_ARROW = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("begin", pa.int64()), ("loss_begin", pa.int64()), ("loss_end", pa.int64()), ("attachments", pa.list_(pa.struct([("number", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), ("expanded_tokens", pa.int64()), ("error", pa.string())])


def flattened(content: str, first: int = 0) -> tuple[Flattened, str, str | None]:
    """What a visitor gathers of a JSON list of parts, its string, and an error: content whose parts can't be taken is plain text with one."""
    try:
        flat = PartVisitor(first).visit(parts_of(content))
        text = "".join(flat.text)
        # a lone surrogate of a JSON string is no text
        for x in (text, *[a["ref"] for a in flat.attachments]):
            x.encode()
        return flat, text, None
    except (ValueError, TypeError, AttributeError, OverflowError, RecursionError) as e:
        flat = PartVisitor(first).visit([{"type": "text", "text": content}])
        return flat, "".join(flat.text), f"{type(e).__name__}: {e}"[:200].encode("ascii", "backslashreplace").decode()


def format_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text", parts_json: bool = False, loss_role: str = "assistant") -> DataFrame:
    """One row a turn, in order within a conversation: its formatted string, where that begins in the conversation's and the
    loss mask (begin and end in the conversation's string, null where the role gets no loss). parts_json: the content is a
    JSON list of parts rather than a plain text; what is not such a list counts as plain text, and so does a list with a part of unknown type, a
    text that is none, a lone surrogate or too deep a nesting, with an error in the row."""
    kept = turns.select(F.col(id_col).cast("long").alias("c"), F.col(turn_col).alias("n"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("r"), F.coalesce(F.col(content_col).cast("string"), F.lit("")).alias("t"))
    ordered = kept.repartition("c").sortWithinPartitions("c", "n", "r", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, attached, last = 0, 0, object()
        for batch in batches:
            rows = []
            for conv, role, text in zip(batch.column("c").to_pylist(), batch.column("r").to_pylist(), batch.column("t"), strict=True):
                if conv != last:
                    at, attached, last = 0, 0, conv
                raw = text.as_py()
                flat, content, error = flattened(raw, attached) if parts_json else (Flattened(), escape(raw), None)
                head = f"<turn {escape(role)}>\n"
                whole = f"{head}{content}</turn>\n"
                loss = (at + len(head), at + len(head) + len(content)) if role == loss_role else (None, None)
                rows.append({"conv_id": conv, "formatted": whole, "begin": at, "loss_begin": loss[0], "loss_end": loss[1], "attachments": flat.attachments, "expanded_tokens": flat.expanded_tokens, "error": error})
                at += len(whole)
                attached += len(flat.attachments)
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return ordered.mapInArrow(run, SCHEMA)


_TURN = re.compile(r"<turn ([^<>]*)>\n(.*?)</turn>\n", re.S)


class _Reader:
    """Parses the turns of one conversation out of its string, which comes in pieces of any size; holds one turn and a piece."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n, self.at, self.buffer = conv_id, 0, 0, ""
        self.turns, self.loss, self.chars = hashlib.sha256(), hashlib.sha256(), 0
        self.mask: deque[tuple[int, int]] = deque()

    def feed(self, text: str, begin: int | None, end: int | None) -> None:
        """A piece of the string, and the loss mask's next stretch, if there is one."""
        self.buffer += text
        if begin is not None:
            self.mask.append((begin, end))
        # the last turn waits for what follows: only the string itself tells where it ends
        self._parse(False)

    def _parse(self, over: bool) -> None:
        done = 0
        while (m := _TURN.match(self.buffer, done)) and (over or m.end() < len(self.buffer)):
            self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            self.n += 1
            while self.mask and self.mask[0][1] <= self.at + m.end():
                begin, end = self.mask.popleft()
                masked = unescape(self.buffer[begin - self.at : end - self.at])
                self.chars += len(masked)
                self.loss.update(masked.encode())
            done = m.end()
        self.buffer = self.buffer[done:]
        self.at += done

    def closed(self) -> dict:
        self._parse(True)
        if self.buffer or self.mask:
            raise ValueError(f"conversation {self.conv_id} is no row of turns from {self.at} on")
        return {"conv_id": self.conv_id, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.at}


def read_back(formatted: DataFrame) -> DataFrame:
    """One row a conversation, from format_turns' rows in their order: its turns and loss parsed from the conversation's string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: _Reader | None = None
        for batch in batches:
            rows = []
            for conv, text, a, b in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_begin", "loss_end")), strict=True):
                if reader is None or conv != reader.conv_id:
                    rows += [reader.closed()] if reader else []
                    reader = _Reader(conv)
                reader.feed(text, a, b)
            yield pa.RecordBatch.from_pylist(rows, schema)
        if reader:
            yield pa.RecordBatch.from_pylist([reader.closed()], schema)

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    return formatted.select("conv_id", "formatted", "loss_begin", "loss_end").mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    return read_back(format_turns(turns.unionByName(added)))


OP6_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<>#]', '', 'g')) + length(role) + length('<turn >') + 1 + length('</turn>') + 1 AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       cast(sum(chars) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

"""Chat formatting of typed content parts.

A turn's content is an ordered list of parts: text, image, audio or document. A visitor flattens them into one
string, text escaped and every attachment as an ordered placeholder, and records each attachment's
reference, place and expanded token count. A turn is written as ``<|turn|>role\\n content <|end|>`` and a newline.

Escaping is reversible: a backslash is doubled, and one is put after the first character of every
control string (``<|``, ``|>``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``), overlapping ones too, so no text can
contain a control string. Turns are formatted one by one, without a shuffle; ``digests`` streams the formatted
turns of a conversation in order, so its memory does not follow the length of a conversation.

Defined results for odd input: null text and null parts count as empty; a null role counts as empty; unknown part
types are an error; rows of a conversation are ordered by turn (null first), role, text; a null conversation id is a
conversation of its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismflow import storage
from prismflow.llm import textkit as tk

#: Fixed expansion rules: pixels per image token side, audio tokens a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 12.5, 1024
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHMENT = "struct<kind:string,ordinal:int,ref:string,start:long,end:long,tokens:long>"
FORMATTED = f"conv_id long, turn long, role string, formatted string, loss_start long, loss_end long, attachments array<{ATTACHMENT}>"


def escape(text: str) -> str:
    return re.sub(r"\\|<(?=\||s>|/s>)|\[(?=/?INST\])|\|(?=>)", lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\)?", lambda m: m[1] or "", text)


class Attachment(NamedTuple):
    kind: str
    ordinal: int
    ref: str | None
    start: int
    end: int
    tokens: int


class Flattener:
    """Visits the parts of one turn in order."""

    def __init__(self, offset: int):
        self.out: list[str] = []
        self.at, self.attachments = offset, []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type']}", self.unknown)(part)

    def unknown(self, part: dict) -> None:
        raise ValueError(f"unknown content part: {part['type']!r}")

    def _write(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def visit_text(self, part: dict) -> None:
        self._write(escape(part.get("text") or ""))

    def _attach(self, part: dict, tokens: int) -> None:
        start, ordinal = self.at, len(self.attachments)
        self._write(f"<|{part['type']} {ordinal}|>")
        self.attachments.append(Attachment(part["type"], ordinal, part.get("ref"), start, self.at, tokens))

    def visit_image(self, part: dict) -> None:
        self._attach(part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict) -> None:
        self._attach(part, math.ceil((part.get("seconds") or 0) * AUDIO_RATE))

    def visit_document(self, part: dict) -> None:
        self._attach(part, (part.get("pages") or 0) * PAGE_TOKENS)


def format_turn(role: str | None, parts: list[dict] | None) -> tuple[str, int, int, list[Attachment]]:
    """The turn's string, start and end of its content, its attachments."""
    head = f"<|turn|>{escape(role or '').replace(chr(10), '<|nl|>')}\n"
    visitor = Flattener(len(head))
    for part in parts or []:
        if part is not None:
            visitor.visit(part)
    return head + "".join(visitor.out) + "<|end|>\n", len(head), visitor.at, visitor.attachments


def parse_turn(formatted: str) -> tuple[str, list[tuple[str, str]]]:
    """Role and parts (kind, text or ordinal) of a formatted turn."""
    match = re.fullmatch(r"<\|turn\|>([^\n]*)\n(.*)<\|end\|>\n", formatted, re.S)
    if not match:
        raise ValueError("not a formatted turn")
    parts = []
    for piece in re.split(r"(<\|(?:image|audio|document) \d+\|>)", match[2]):
        if placed := re.fullmatch(r"<\|(\w+) (\d+)\|>", piece):
            parts.append((placed[1], placed[2]))
        elif piece:
            parts.append(("text", unescape(piece)))
    return unescape(match[1].replace("<|nl|>", "\n")), parts


def text_parts(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Plain texts as single text parts in column ``parts``."""
    nothing = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    part = F.struct(F.lit("text").alias("type"), F.col(text_col).alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in nothing.items()))
    return rows.withColumn("parts", F.array(part))


def formatted_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", learned: str = "assistant") -> DataFrame:
    """One row per turn: its string, the span under the loss mask (null for other roles), its attachments."""
    storage.bounded_batches(rows.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("ordinal", pa.int32()), ("ref", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("tokens", pa.int64())]))
        for batch in batches:
            done = [format_turn(role, parts) for role, parts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            mask = [role == learned for role in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(3)),
                    pa.array([d[0] for d in done], pa.string()),
                    pa.array([d[1] if m else None for d, m in zip(done, mask, strict=True)], pa.int64()),
                    pa.array([d[2] if m else None for d, m in zip(done, mask, strict=True)], pa.int64()),
                    pa.array([[a._asdict() for a in d[3]] for d in done], kind),
                ],
                ["conv_id", "turn", "role", "formatted", "loss_start", "loss_end", "attachments"],
            )

    chosen = rows.select(F.col(conv_col).cast("long"), F.col(turn_col).cast("long"), F.col(role_col), F.col(parts_col).cast(f"array<{PART}>"))
    return chosen.mapInArrow(tk.tidy(emit), FORMATTED)


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted turns: turns, digests and sizes."""
    ordered = turns.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, now = False, None
        done: list[tuple] = []

        def close() -> None:
            done.append((now, n, every.hexdigest(), loss_chars, loss.hexdigest(), chars))

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for conv, formatted, start, end in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if not started or conv != now:
                    if started:
                        close()
                    started, now = True, conv
                    n, every, loss_chars, loss, chars = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                role, parts = parse_turn(formatted)
                text = "".join(x for kind, x in parts if kind == "text")
                n += 1
                chars += len(formatted)
                every.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    under = "".join(x for kind, x in parse_turn("<|turn|>\n" + formatted[start:end] + "<|end|>\n")[1] if kind == "text")
                    loss_chars += len(under)
                    loss.update(under.encode("utf-8", "surrogatepass"))
            if len(done) > 1000:
                yield batch_of()
                done.clear()
        if started:
            close()
            yield batch_of()

    return ordered.mapInArrow(tk.tidy(read), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

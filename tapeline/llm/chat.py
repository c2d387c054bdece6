r"""Chat formatting: typed content parts to one training text, reversibly, with a loss mask.

A visitor flattens the parts of a turn (text, image, audio, document) into text with ordered placeholders, records the
attachments, and adds up expanded token counts. A turn is written as ``<s>role\n`` + body + ``</s>``, where the body of
a user turn stands in ``[INST]`` and ``[/INST]``. Control strings and backslashes inside roles and texts get a backslash
before them, so the output can be parsed back. Beside it goes the loss mask: the spans of the formatted text (code
points, end exclusive) that are trained on, the bodies of assistant turns. What is read back is cut out by that mask.

Conversations are dealt by id and sorted by turn; a task folds the turns of a conversation as they stream by and keeps
only running digests, so a conversation of any length needs constant memory. Defined results: null text or role counts as empty;
null conversation ids form one conversation; turns that tie are ordered by role and text, and repeated rows are separate
turns; null turns come first; a part of another type becomes the placeholder ``<|other|>`` and an attachment of kind
``other`` that expands to no tokens, unless it says so; a null part is an empty text; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END, INST, INST_END = "<s>", "</s>", "[INST]", "[/INST]"
# The strings with a meaning in the template.
CONTROL = re.compile(r"\\|</?s>|\[/?INST\]|<\|(?:image|audio|document|other)\|>|\n")
TRAINED = "assistant"
ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str, line: bool = False) -> str:
    """``line``: also line ends, for a role."""
    return CONTROL.sub(lambda m: m[0] if m[0] == "\n" and not line else "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


@dataclass
class PartVisitor:
    """Flattens typed parts in order; ``text`` parts are escaped, others become placeholders."""

    #: Tokens that one attachment expands to, where the part does not say.
    expands: dict[str, int] = field(default_factory=lambda: {"image": 576, "audio": 750, "document": 1024, "other": 0})
    pieces: list[str] = field(default_factory=list)
    attachments: list[tuple[int, str, str]] = field(default_factory=list)
    tokens: int = 0

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.pieces.append(escape(text))
        self.tokens += len(text.split())

    def _attach(self, kind: str, part: dict) -> None:
        self.pieces.append(f"<|{kind}|>")
        self.attachments.append((len(self.attachments), kind, part.get("ref") or ""))
        self.tokens += part.get("tokens") or self.expands[kind]

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)

    def visit_other(self, part: dict) -> None:
        self._attach("other", part)


def write_turn(role: str, body: str) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turn and its loss mask; ``body`` is escaped already."""
    inner = INST + body + INST_END if role == "user" else body
    start = BEGIN + escape(role, line=True) + "\n"
    return start + inner + END, [(len(start), len(start) + len(inner))] if role == TRAINED and inner else []


TOKEN = re.compile(r"\\.|<s>|</s>|\[INST\]|\[/INST\]|\n", re.DOTALL)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, escaped body) of each turn of a formatted text."""
    role, start = None, 0
    for m in TOKEN.finditer(formatted):
        if m[0] == BEGIN:
            role, start = None, m.end()
        elif m[0] == "\n" and role is None:
            role, start = unescape(formatted[start : m.start()]), m.end()
        elif m[0] == INST:
            start = m.end()
        elif m[0] == INST_END:
            yield role, formatted[start : m.start()]
            start = None
        elif m[0] == END:
            if start is not None:
                yield role, formatted[start : m.start()]


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """conv_id, turn, role, formatted, loss (spans of ``formatted``), attachments, n_tokens of every row.

    ``parts_col``: array<struct<type, text, ref, tokens>>; without it a turn is one text part.
    """
    schema = "conv_id long, turn long, role string, formatted string, loss array<struct<start:int,end:int>>, attachments array<struct<place:int,kind:string,ref:string>>, n_tokens long"
    parts = F.col(parts_col) if parts_col else F.array(F.struct(F.lit("text").alias("type"), F.col(text_col).alias("text")))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "turn", "role", "formatted", "loss", "attachments", "n_tokens"]
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), span, pa.list_(pa.struct([("place", pa.int32()), ("kind", pa.string()), ("ref", pa.string())])), pa.int64()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for conv, turn, role, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                visitor = PartVisitor()
                for part in content or ():
                    visitor.visit(part or {})
                found = [{"place": p, "kind": k, "ref": r} for p, k, r in visitor.attachments]
                text, mask = write_turn(role, "".join(visitor.pieces))
                for column, value in zip(out, (conv, turn, role, text, [{"start": a, "end": b} for a, b in mask], found, visitor.tokens), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from ``formatted`` and ``loss`` alone: counts, digests of its turns, and of the text under the loss mask, unescaped."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    rows = formatted.select("conv_id", "turn", "role", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state: list | None = None  # conv_id, turns, digest, loss characters, loss digest, characters

        def row() -> tuple:
            return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

        def pack(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], kinds[i]) for i in range(len(names))], names=names)

        for batch in batches:
            done = []
            for conv, text, mask in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[5] += len(text)
                for role, body in read_turns(text):
                    plain = unescape(body)
                    state[1] += 1
                    state[2].update(f"{role}\n{plain}\n".encode())
                for span in mask or ():
                    plain = unescape(text[span["start"] : span["end"]])
                    state[3] += len(plain)
                    state[4].update(plain.encode())
            if done:
                yield pack(done)
        if state is not None:
            yield pack([row()])

    return rows.mapInArrow(run, schema)

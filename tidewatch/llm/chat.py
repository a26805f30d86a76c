"""Chat formatting: typed content parts, turn marks, reversible escapes, a loss mask.

A turn is `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. Inside roles and texts every `<`, then any
number of `\\`, then `|` gets one more `\\`, so that no control string can arise; one fewer
on the way back. A role's newlines and backslashes are written `\\n` and `\\\\`.

A message's content is plain text or a list of typed parts. A visitor flattens the parts in
order into text and placeholders, and records each attachment's reference and the number of
tokens that it expands to.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of one 28-pixel patch row or column, of a second of sound, of a page.
PATCH, SOUND_TOKENS, PAGE_TOKENS = 28, 25, 512


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text) if "<" in text else text


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


@dataclass
class Attachment:
    kind: str
    ref: str
    tokens: int
    place: int


def amount(part: dict, name: str, default: float) -> float:
    """A finite number above 0 of a part, else the default."""
    x = part.get(name)
    return x if isinstance(x, int | float) and not isinstance(x, bool) and 0 < x < 1e9 else default


def content_of(text: str | None):
    """The parts that a JSON text holds; a text that is no JSON is itself the content."""
    if not text:
        return text
    try:
        return json.loads(text)
    except ValueError:
        return text


@dataclass
class Visitor:
    """Flattens content parts; `text` is escaped, placeholders are control strings."""

    text: list[str] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)

    def visit(self, part) -> None:
        """Parts in order, lists within lists included. What is no part (a number, say) counts as its text."""
        waiting = [part]
        while waiting:  # no recursion, so depth is no limit
            x = waiting.pop()
            if isinstance(x, list):
                waiting.extend(reversed(x))
            elif isinstance(x, dict):
                getattr(self, f"visit_{x.get('type') or 'text'}" if x.get("type") in (None, "", "text", "image", "audio", "document") else "visit_other")(x)
            elif x is not None:
                self.text.append(escape(x if isinstance(x, str) else json.dumps(x)))

    def visit_text(self, part: dict) -> None:
        said = part.get("text")
        self.text.append(escape(said if isinstance(said, str) else "" if said is None else json.dumps(said)))

    def visit_image(self, part: dict) -> None:
        self.attach("image", part, math.prod(max(1, math.ceil(amount(part, x, PATCH) / PATCH)) for x in ("width", "height")))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, max(1, math.ceil(amount(part, "seconds", 0) * SOUND_TOKENS)))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, max(1, int(amount(part, "pages", 1))) * PAGE_TOKENS)

    def visit_other(self, part: dict) -> None:
        self.attach(escape(str(part.get("type"))), part, 1)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.text.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append(Attachment(kind, str(part.get("ref") or ""), tokens, len(self.attachments)))


def format_turn(role: str | None, content) -> tuple[str, list[Attachment]]:
    """The turn as written, and what it attaches. Null role or content: empty."""
    visitor = Visitor()
    visitor.visit(content)
    return f"{START}{escape_role(role or '')}\n{''.join(visitor.text)}{END}\n", visitor.attachments


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, read back from what was written."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        out.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return out


def loss_spans(formatted: str, trained: str = "assistant") -> list[tuple[int, int]]:
    """Places of the texts that count in the loss: those of the trained role."""
    out, at = [], 0
    while (at := formatted.find(START, at)) >= 0:
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        if unescape_role(formatted[at + len(START) : line]) == trained:
            out.append((line + 1, end))
        at = end
    return out


TURN_COLUMNS = "role_key string, formatted string, mask array<struct<start:int,end:int>>, attachments array<struct<kind:string,ref:string,tokens:long,place:int>>, extra_tokens long"


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", parts: bool = False) -> DataFrame:
    """Each row formatted: `formatted`, its loss mask, attachments and their tokens. `parts`: content is JSON of typed parts.

    A conversation is its rows' `formatted` by turn; ties by role, then text; nulls first.
    Mask places are within the row. Rows need no others, so no conversation is gathered. Null
    roles and contents are empty, repeated rows are turns of their own, texts may have any length,
    and other columns of `df` don't matter. With `parts`, a text that is no JSON is plain text, a
    part that is no object is its text, and sizes that are no numbers above 0 count as the least.
    """
    schema = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn")).schema
    schema = T.StructType([*schema, *T.DataType.fromDDL(TURN_COLUMNS)])
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    attached = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64()), ("place", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, masks, attachments = [], [], []
            for r, c in zip(batch.column("role").to_pylist(), batch.column("content").to_pylist(), strict=True):
                text, found = format_turn(r, content_of(c) if parts else c)
                texts.append(text)
                masks.append([{"start": a, "end": b} for a, b in loss_spans(text)])
                attachments.append([vars(x) for x in found])
            extra = [sum(x["tokens"] for x in a) for a in attachments]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("turn"), batch.column("role"), pa.array(texts, pa.string()), pa.array(masks, span), pa.array(attachments, attached), pa.array(extra, pa.int64())], schema.names)

    return df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content")).mapInArrow(run, schema)


def digests(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation, read back from `formatted`: turns, digests, characters under the mask, attachments and the tokens they expand to.

    Rows are dealt by conversation and sorted; a task streams over them with running digests,
    so that the longest conversation takes no more memory than a batch.
    """
    name = "formatted"
    rows = turns.select("conv", "turn", "role_key", name, "mask", F.size("attachments").alias("attached"), "extra_tokens")
    rows = rows.repartition(F.col("conv")).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in ("conv", "turn", "role_key", name)))
    schema = turns.select(F.col("conv").alias(key)).schema
    for column, kind in (("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long"), ("n_attachments", "long"), ("extra_tokens", "long")):
        schema = schema.add(column, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        done: list[tuple] = []

        def close() -> None:
            done.append((current[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))

        for batch in batches:
            for conv, text, mask, attached, extra in zip(*(batch.column(c).to_pylist() for c in ("conv", name, "mask", "attached", "extra_tokens")), strict=True):
                if current is None or current[0] != conv:
                    if current is not None:
                        close()
                    current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, said in parse_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in mask:
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
                state[5] += attached
                state[6] += extra
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], arrow_schema)
                done = []
        if current is not None:
            close()
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], arrow_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow_schema = to_arrow_schema(schema)
    return rows.mapInArrow(run, schema)

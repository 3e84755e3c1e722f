"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and its reply, which alone is
trainable. Turns behind the last assistant turn, or a conversation without one, make one example without a target, so
that no turn is lost. A turn is `<|im_start|>role\\ntext<|im_end|>\\n`; inside roles and texts a backslash is doubled and
`<|` becomes `<\\|`, in roles a newline becomes `\\n`, so that control strings in them are text and can be read back.

A conversation's rows are read in order of turn (then role and text), streamed; what is held is one example, which is as
long as its conversation by the method. Equal rows are turns of their own.

Cases: null text and null role: empty; null turn: first; rows with a null conv_id are one conversation with a null id; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"

_escaped = re.compile(r"\\(.)", re.S)


class Example(NamedTuple):
    conv_id: int | None
    example: int
    text: str
    #: The trainable code points of text.
    loss_start: int
    loss_length: int


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return _escaped.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def expand(rows: Iterator[tuple]) -> Iterator[Example]:
    """Examples of rows (conv_id, role, text) sorted by conversation and turn."""
    last, text, number, open_ = object(), "", 0, False
    for conv, role, content in rows:
        if conv != last:
            if open_:
                yield Example(last, number, text, len(text), 0)
            last, text, number, open_ = conv, "", 0, False
        head = f"{START}{escape_role(role or '')}\n"
        body = escape(content or "")
        begin = len(text) + len(head)
        text = f"{text}{head}{body}{END}\n"
        open_ = True
        if (role or "") == TRAINED:
            yield Example(conv, number, text, begin, len(body))
            number, open_ = number + 1, False
    if open_:
        yield Example(last, number, text, len(text), 0)


def read_turns(text: str, begin: int = 0) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns that an example shows from a place on."""
    while begin < len(text):
        if not text.startswith(START, begin):
            raise ValueError(f"no turn begins at {begin}")
        line = text.index("\n", begin)
        end = text.index(END + "\n", line)
        yield unescape_role(text[begin + len(START) : line]), unescape(text[line + 1 : end])
        begin = end + len(END) + 1


def digest(examples: Iterator[Example]) -> Iterator[tuple]:
    """A row a conversation, read back from its examples, which come in order.

    Each example repeats what the one before it shows, so that its turns are read from there on.
    """
    last, row = object(), None
    for e in examples:
        if e.conv_id != last or row is None:
            if row:
                yield _digested(last, row)
            last, row = e.conv_id, {"turns": 0, "sha": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "read": 0}
        for role, content in read_turns(e.text, row["read"]):
            row["turns"] += 1
            row["sha"].update(f"{role}\n{content}\n".encode())
        row["read"] = len(e.text)
        reply = unescape(e.text[e.loss_start : e.loss_start + e.loss_length])
        row["loss"].update(reply.encode())
        row["loss_chars"] += len(reply)
        row["chars"] += len(e.text)
    if row:
        yield _digested(last, row)


def _digested(conv, row: dict) -> tuple:
    return conv, row["turns"], row["sha"].hexdigest(), row["loss_chars"], row["loss"].hexdigest(), row["chars"]


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in zip(*batch.columns, strict=True):
            yield tuple(x.as_py() for x in row)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most about `most` characters, or one row."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= most or len(held) >= 5_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def format_examples(conversations: DataFrame) -> DataFrame:
    """One row an example: conv_id, example, text, loss_start, loss_length (in code points)."""
    schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(expand(_rows(batches)), schema, lambda e: len(e.text))

    return _ordered(conversations).mapInArrow(run, "conv_id long, example long, text string, loss_start long, loss_length long")


def digests(conversations: DataFrame) -> DataFrame:
    """One row a conversation, read back from its examples as they are made: the quadratic text is never stored."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(digest(expand(_rows(batches))), schema, lambda row: 200)

    return _ordered(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -1, whose texts hold control strings."""
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(-1, 0, "user", said), (-1, 1, TRAINED, said)]
    probe = conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)

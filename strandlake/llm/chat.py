"""Chat formatting with a grammar round trip.

    turn := "<|im_start|>" role "\\n" text "<|im_end|>\\n"

Every turn is rendered as it is and read by the parser. If the parser doesn't give
the same role and text back, the turn is rendered with escapes: one backslash more
between "<" and "|" of a control string in a text (however many it has), and
backslash sequences in a role. The parser takes exactly one such backslash away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: The control strings.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
ROLE_ESCAPES = {"\\": "\\\\", "\n": "\\n", "|": "\\p"}
ROLE_MEANS = {"\\": "\\", "n": "\n", "p": "|"}
#: The role whose texts are learnt.
LEARNT = "assistant"


def escape_text(text: str) -> str:
    return CONTROL.sub(r"<\\\1|\2|>", text)


def unescape_text(text: str) -> str:
    return ESCAPED.sub(r"<\1|\2|>", text)


def render(role: str, text: str) -> tuple[str, bool]:
    """The rendered turn, and whether it had to be escaped."""
    plain = f"{START}{role}\n{text}{END}\n"
    if parse(plain) == [(role, text)]:
        return plain, False
    safe = f"{START}{re.sub(r'[\\\n|]', lambda m: ROLE_ESCAPES[m[0]], role)}\n{escape_text(text)}{END}\n"
    if parse(safe) != [(role, text)]:
        raise ValueError("a turn can't be told apart from the template")
    return safe, True


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered text; None if it isn't one."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            return None
        line = rendered.find("\n", at)
        end = rendered.find(END, at)
        if line < 0 or end < line or not rendered.startswith("\n", end + len(END)):
            return None
        role, text = rendered[at + len(START) : line], rendered[line + 1 : end]
        if START in role or START in text or re.search(r"\\(?![\\np])", re.sub(r"\\\\", "", role)):
            return None
        turns.append((re.sub(r"\\([\\np])", lambda m: ROLE_MEANS[m[1]], role), unescape_text(text)))
        at = end + len(END) + 1
    return turns


def format_turns(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) to a row per turn: conv_id, turn, rendered,
    loss_start, loss_end (code points of `rendered` that are learnt; equal if none), escaped.

    A conversation's text is its rendered turns, in order of turn and then of rendered
    text. Null roles and texts count as empty; null turns come first; repeated rows stay;
    a null conv_id is a conversation; other columns are ignored; an empty table gives none.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("rendered", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("escaped", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for role, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                shown, escaped = render(role, text)
                end = len(shown) - len(END) - 1
                for column, value in zip(out, (shown, shown.index("\n") + 1 if role == LEARNT else end, end, escaped), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, f.type) for c, f in zip(out, list(schema)[2:], strict=True))], schema=schema)

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.mapInArrow(tidy(run), "conv_id long, turn long, rendered string, loss_start long, loss_end long, escaped boolean")


def digests(formatted: DataFrame) -> DataFrame:
    """What the parser reads back from format_turns(): conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Turns stream through in order, so a conversation of any length needs one turn's memory.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple] = []

        def close() -> None:
            if state is not None:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for conv, shown, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_end")), strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(shown):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                learnt = unescape_text(shown[start:end])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
                state[4] += len(shown)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = formatted.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "rendered")
    return ordered.select("conv_id", "rendered", "loss_start", "loss_end").mapInArrow(tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

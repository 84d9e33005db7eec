"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation: turns, one after the other. A turn is `### `, the role, `:` and a line
feed, the text, a line feed, `</turn>` and a line feed. Inside roles and texts a control string (`### `,
`</turn>`, in roles also `:` and the line feed) may follow backslashes; one backslash more than the content
has stands before it. So a parser reads content up to the first control string without a backslash.

Turns are written and proven one by one: what the parser recovers is compared with the source, and conflicting
content is escaped until both are equal. Whole conversations are then joined and read back as streams.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, END = "### ", "</turn>"
_TEXT_CONFLICT = re.compile(r"(\\*)(### |</turn>)")
_ROLE_CONFLICT = re.compile(r"(\\*)(### |</turn>|:|\n)")


class ParseError(ValueError):
    pass


def _plain(content: str, conflict: re.Pattern) -> str:
    """Takes one backslash from each escaped control string."""
    return conflict.sub(lambda m: m[1][1:] + m[2], content)


def parse(text: str, at: int = 0) -> Iterator[tuple[str, str, int]]:
    """(role, text, end) of each turn from `at` on; deterministic, one way to read any input."""
    while at < len(text):
        if not text.startswith(HEAD, at):
            raise ParseError(f"a turn must begin at {at}")
        role, start = _until(text, at + len(HEAD), ":\n")
        content, stop = _until(text, start, "\n" + END + "\n")
        for raw, conflict in ((role, _ROLE_CONFLICT), (content, _TEXT_CONFLICT)):
            if any(not m[1] for m in conflict.finditer(raw)):
                raise ParseError(f"a control string stands free in the turn at {at}")
        yield _plain(role, _ROLE_CONFLICT), _plain(content, _TEXT_CONFLICT), stop
        at = stop


def _until(text: str, at: int, end: str) -> tuple[str, int]:
    """Content up to the first end, and where the end stops. Escaped content holds none: a backslash parts it."""
    stop = text.find(end, at)
    if stop < 0:
        raise ParseError(f"nothing ends what begins at {at}")
    return text[at:stop], stop + len(end)


def written(role: str, text: str) -> str:
    return f"{HEAD}{role}:\n{text}\n{END}\n"


def format_turn(role: str, text: str) -> str:
    """A turn that the parser reads back as exactly this role and text."""
    shown, said = role, text
    while True:
        out = written(shown, said)
        try:
            read = [(r, t) for r, t, _ in parse(out)]
        except ParseError:
            read = []
        if read == [(role, text)]:
            return out
        escaped = _ROLE_CONFLICT.sub(r"\1\\\2", role), _TEXT_CONFLICT.sub(r"\1\\\2", text)
        if (shown, said) == escaped:
            raise ParseError("escaped content doesn't read back")
        shown, said = escaped


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        turns = [format_turn(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
        yield pa.record_batch([*batch.columns, pa.array(turns, pa.string())], names=[*batch.schema.names, "formatted"])


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, formatted): every turn written and proven where it lies, without a shuffle.

    Null role or text: empty. Other columns are left out.
    """
    own = turns.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    return own.mapInArrow(_format, "conv_id bigint, turn bigint, role string, text string, formatted string")


class _Reader:
    """Reads the formatted turns of one conversation back and sums up what the parser recovers."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.chars, self.loss = conv_id, 0, 0, 0
        self.whole, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        self.chars += len(formatted)
        for role, text, _ in parse(formatted):
            self.turns += 1
            self.whole.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                self.loss += len(text)
                self.masked.update(text.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.whole.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


_DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = None

    def done(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                               names=[c.split()[0] for c in _DIGESTS.split(", ")])

    for batch in batches:
        rows = []
        for conv_id, formatted in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
            if reader is None or reader.conv_id != conv_id:
                if reader:
                    rows.append(reader.row())
                reader = _Reader(conv_id)
            reader.add(formatted)
        yield done(rows)
    if reader:
        yield done([reader.row()])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, from its formatted turns in order: what the parser recovers of it.

    Turns go by `turn`, nulls first, ties by role and text. The text under the loss mask is that of turns
    whose role is `assistant`. A conversation streams through its task; a digest of all its text in order
    has to be taken in one place, but never needs more than a turn in memory. Rows without conv_id are one
    conversation. An empty table gives no rows; repeated rows are turns like others.
    """
    own = formatted.select("conv_id", "turn", "role", "text", "formatted")
    order = ["conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    dealt = own.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "formatted").mapInArrow(_read, _DIGESTS)

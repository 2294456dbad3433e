"""Chat formatting with a template that is only called, never read.

Successive prefixes of a conversation are rendered; where one output continues the output
before it, the new part is the span of the new turn, and where it doesn't, the template
rewrites history and the turn is marked. Rendering the last turn once more with an empty
text and with a probe shows which part of the span is the text; those of the chosen roles
are under the loss mask.

Turns arrive sorted and are handled one after the other, and the template is always given all
turns up to the one at hand; its last output is kept for the next turn. A conversation must fit
into memory, and its rendering takes time with the square of its length. For a template that is
declared stateless (what it gives for a turn depends on the last ``WINDOW`` turns at most) only
these are rendered at each turn; one rendering of the whole conversation is then compared with
the joined spans, and where they differ, all turns are done again on true prefixes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]
#: Turns before a turn that a template declared stateless is shown with it.
WINDOW = 16
#: Code points of spans handed on at a time, at least.
CHUNK = 1_000_000
PROBE = "\ufdd0"
TURNS = (
    "conv long, position long, span string, text_start long, text_end long, "
    "in_loss boolean, rewrites boolean"
)
DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long, rewrites boolean"
)

OPEN, CLOSE, BREAK = "<|im_start|>", "<|im_end|>\n", "<|break|>"


def escape(text: str) -> str:
    """The text without a control string: a backslash goes into every ``<|``, and one more
    wherever backslashes are there already, so that :func:`unescape` restores it."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _marked_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape(role).replace(chr(10), BREAK)}\n{escape(text)}{CLOSE}"


#: Turns stay the same from prefix to prefix. So many, of so many code points at most, are kept as they are marked.
KEPT_TURNS, KEPT_CHARS = 20_000, 2000
_kept_turn = lru_cache(KEPT_TURNS)(_marked_turn)


def marked_turns(turns: Sequence[Turn]) -> str:
    """The template in use: marks turns, and escapes control strings inside roles and texts."""
    return "".join(
        [(_kept_turn if len(role) + len(text) <= KEPT_CHARS else _marked_turn)(role, text) for role, text in turns]
    )


def read_turns(formatted: str) -> tuple[list[Turn], str]:
    """The turns at the start of formatted text, and the rest that is no whole turn yet."""
    turns, at = [], 0
    while (end := formatted.find(CLOSE, at)) >= 0:
        head, _, text = formatted[at + len(OPEN) : end].partition("\n")
        turns.append((unescape(head.replace(BREAK, "\n")), unescape(text)))
        at = end + len(CLOSE)
    return turns, formatted[at:]


def locate(render: Template, before: Sequence[Turn], turn: Turn, old: str | None = None) -> tuple[str, int, int, bool]:
    """The span that a turn adds, where in it the turn's text starts and ends, and whether the
    turn makes the template rewrite what it gave before (``old``, if known). A text that isn't
    found (the template changes it, or history is rewritten) has an empty place at the end of
    the span."""
    if old is None:
        old = render(before) if before else ""
    return _located(render, before, turn, old, render([*before, turn]))


def shared(a: str, b: str) -> int:
    """Length of the common prefix, found by halves, so that long equal parts are compared as a whole."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _located(render: Template, before: Sequence[Turn], turn: Turn, old: str, new: str) -> tuple[str, int, int, bool]:
    if not new.startswith(old):
        return new[shared(old, new) :], 0, 0, True
    span = new[len(old) :]
    bare = render([*before, (turn[0], "")])
    probed = render([*before, (turn[0], PROBE)])
    head = bare[: shared(bare, probed)]
    tail = bare[len(head) :]
    if len(head) < len(old) or not (probed == head + PROBE + tail and new.startswith(head) and new.endswith(tail)):
        return span, len(span), len(span), False
    return span, len(head) - len(old), len(span) - len(tail), False


def by_prefixes(render: Template, turns: Sequence[Turn]) -> Iterator[tuple[str, int, int, bool]]:
    """What :func:`locate` gives for each turn of a conversation, each prefix rendered once."""
    old = ""
    for i, turn in enumerate(turns):
        new = render(turns[: i + 1])
        yield _located(render, turns[:i], turn, old, new)
        old = new


def by_window(render: Template, turns: Sequence[Turn]) -> list[tuple[str, int, int, bool]]:
    """The same for a template declared stateless, each turn seen with ``WINDOW`` turns before it; by
    prefixes if the joined spans are not the rendering of the whole conversation, or if the
    template refuses a window with a ``ValueError``. A rewrite that a later turn undoes is not seen."""
    if len(turns) <= WINDOW + 1:
        return list(by_prefixes(render, turns))
    try:
        found = [locate(render, turns[max(0, i - WINDOW) : i], turn) for i, turn in enumerate(turns)]
    except ValueError:
        return list(by_prefixes(render, turns))
    if any(f[3] for f in found) or "".join(f[0] for f in found) != render(turns):
        return list(by_prefixes(render, turns))
    return found


def format_turns(
    conversations: DataFrame,
    render: Template = marked_turns,
    loss_roles: Sequence[str] = ("assistant",),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    stateless: bool = False,
) -> DataFrame:
    """One row per turn, a conversation's rows behind each other and in order inside a partition:
    its position (from 0), the span it adds to the formatted text, the place of its text in
    the span (code points), whether this is under the loss mask, and whether the template
    rewrote history (then the spans don't add up to the final text).

    Turns with equal or null numbers are ordered by role and text, null numbers first. A null
    role or text counts as empty. A row without a conversation id is a conversation of its own; such rows are
    dealt over all tasks. Repeated rows are turns of their own. No rows give no rows.

    ``stateless`` declares that the template gives for a turn what depends on the turn and the
    ``WINDOW`` turns before it only: a long conversation then takes time with its length, and is
    held against one rendering of the whole.
    """
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    lone = F.when(F.col("conv").isNull(), F.xxhash64(F.monotonically_increasing_id()))
    turns = turns.withColumn("lone", lone)
    turns = turns.repartition("conv", "lone").sortWithinPartitions("conv", "lone", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for conv, said in _conversations(batches):
            found = by_window(render, said) if stateless else by_prefixes(render, said)
            for position, ((role, _), (span, start, end, rewrites)) in enumerate(zip(said, found, strict=True)):
                rows.append((conv, position, span, start, end, role in loss_roles, rewrites))
                size += len(span)
                if len(rows) == BATCH_ROWS or size > CHUNK:
                    yield _rows(rows, TURNS)
                    rows, size = [], 0
        if rows:
            yield _rows(rows, TURNS)

    return turns.select("conv", "role", "text").mapInArrow(run, TURNS)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Whole conversations of sorted rows."""
    conv, said = None, []
    for batch in batches:
        for key, role, text in zip(*(batch[c].to_pylist() for c in ("conv", "role", "text")), strict=True):
            if said and (key != conv or key is None):
                yield conv, said
                said = []
            conv = key
            said.append((role, text))
    if said:
        yield conv, said


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read from the output of :func:`format_turns` with
    ``marked_turns``, whose partitions and order are kept: turns and their hash, parsed from
    the formatted text, and length and hash of the unescaped text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader: _Reader | None = None
        for batch in batches:
            rows = []
            columns = ("conv", "position", "span", "text_start", "text_end", "in_loss", "rewrites")
            for conv, position, *rest in zip(*(batch[c].to_pylist() for c in columns), strict=True):
                if position == 0:
                    rows += [reader.row()] if reader else []
                    reader = _Reader(conv)
                reader.take(*rest)
            yield _rows(rows, DIGESTS)
        if reader:
            yield _rows([reader.row()], DIGESTS)

    return formatted.mapInArrow(run, DIGESTS)


class _Reader:
    """Reads one conversation's spans in order."""

    def __init__(self, conv: int | None):
        self.conv, self.open, self.turns, self.chars, self.loss_chars = conv, "", 0, 0, 0
        self.turn_hash, self.loss_hash, self.rewrites = hashlib.sha256(), hashlib.sha256(), False

    def take(self, span: str, start: int, end: int, in_loss: bool, rewrites: bool) -> None:
        self.chars += len(span)
        self.rewrites |= rewrites
        found, self.open = read_turns(self.open + span)
        self.turns += len(found)
        for role, text in found:
            self.turn_hash.update(f"{role}\n{text}\n".encode())
        if in_loss:
            text = unescape(span[start:end])
            self.loss_chars += len(text)
            self.loss_hash.update(text.encode())

    def row(self) -> tuple:
        return (
            self.conv, self.turns, self.turn_hash.hexdigest(), self.loss_chars,
            self.loss_hash.hexdigest(), self.chars, self.rewrites,
        )


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    fields = [f.split() for f in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    arrays = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])

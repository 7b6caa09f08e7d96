"""Conversations as training texts: turn-aligned windows within a token budget.

A conversation becomes one or more windows. Prefix sums of its turns' tokens
choose each window's span of new turns; the system turn comes first in every
window, a limited history of earlier turns is repeated before the new ones, and
the loss mask covers new assistant turns only, so each is a target once.

The template marks turns with control strings. Where a text holds a control
string, one backslash goes after its first character (and one more where
backslashes stand there already), so no text can end or open a turn, and
``unescape`` gives back the text exactly.

Defined results: turns are ordered by turn, role and text, nulls first; repeated
rows are turns again; a null text or role is empty; rows with a null conv_id
form one conversation; a turn longer than the budget stays whole, in a window of
its own turns only (``oversize``); an empty table gives no rows; other columns
are not looked at. A conversation streams through one task in bounded memory:
only the turns that may still be repeated or share a window are held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import map_rows, partitions
from .tokens import tokenizer

# fixed values: the template's control strings
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, TEXT, END = "[ROLE]", "[TEXT]", "[/ROLE]"

_NAMES = r"/?(?:INST|SYS|ROLE)\]|TEXT\]"
_ESCAPE = re.compile(rf"(\[(?=\\*(?:{_NAMES}))|<(?=\\*/?s>))")
_UNESCAPE = re.compile(rf"(\[)\\(?=\\*(?:{_NAMES}))|(<)\\(?=\\*/?s>)")
_OPENING = re.compile(r"\[SYS\]|\[INST\]|<s>|\[ROLE\]")
_CLOSING = {opening: (role, closing) for role, (opening, closing) in MARKS.items()}

#: tokens that a turn's marks count for
MARK_TOKENS = 4
#: turns planned together; more of a long conversation are planned in the next step
PLAN_TURNS = 1024

WINDOWS = "conv_id long, window long, text string, n_repeated int, n_turns int, loss_start array<long>, loss_end array<long>, n_tokens long, oversize boolean"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1] or m[2], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template has it, and where its text lies in that."""
    if role in MARKS:
        opening, closing = MARKS[role]
    else:
        opening, closing = ROLE + escape(role) + TEXT, END
    inner = escape(text)
    return opening + inner + closing, len(opening), len(opening) + len(inner)


def parse(window: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    turns, at = [], 0
    while at < len(window):
        opening = _OPENING.match(window, at)
        if not opening:
            raise ValueError(f"no turn opens at {at}")
        at = opening.end()
        if opening[0] == ROLE:
            cut = window.index(TEXT, at)
            role, closing, at = unescape(window[at:cut]), END, cut + len(TEXT)
        else:
            role, closing = _CLOSING[opening[0]]
        end = window.index(closing, at)
        turns.append((role, unescape(window[at:end])))
        at = end + len(closing)
    return turns


class _Conversation:
    """Plans the windows of one conversation as its turns arrive."""

    def __init__(self, conv_id: int | None, budget: int, history: int) -> None:
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple[str, str, int] | None = None
        self.seen = self.window = 0
        self.past: list[tuple[str, str, int]] = []  # turns that may be repeated
        self.new: list[tuple[str, str, int]] = []

    def add(self, role: str, text: str, tokens: int) -> Iterator[dict]:
        turn = (role, text, tokens + MARK_TOKENS)
        if not self.seen and role == "system":
            self.system = turn
        self.seen += 1
        self.new.append(turn)
        if len(self.new) >= PLAN_TURNS:
            yield from self.plan(last=False)

    def plan(self, last: bool) -> Iterator[dict]:
        """Cut windows from the new turns; the last one waits for more turns unless none come."""
        ends = np.cumsum([t[2] for t in self.new])
        at = 0
        while at < len(self.new):
            first = not self.window
            system = 0 if first or self.system is None else self.system[2]
            repeated: list[tuple[str, str, int]] = []
            room = min(self.history, self.budget - system - self.new[at][2])
            for turn in reversed(self.past):
                room -= turn[2]
                if room < 0:
                    break
                repeated.append(turn)
            repeated = ([self.system] if system else []) + repeated[::-1]
            used = sum(t[2] for t in repeated)
            before = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + self.budget - used, "right")))
            if stop >= len(self.new) and not last:
                break
            yield self.format(repeated, self.new[at:stop], used + int(ends[stop - 1]) - before)
            self.past = self.kept(self.past + self.new[at:stop])
            at = stop
        self.new = self.new[at:]

    def kept(self, turns: list[tuple[str, str, int]]) -> list[tuple[str, str, int]]:
        """The latest turns that fit the history; the system turn is not one of them."""
        room, out = self.history, []
        for turn in reversed(turns):
            room -= turn[2]
            if room < 0 or turn is self.system:
                break
            out.append(turn)
        return out[::-1]

    def format(self, repeated: list, new: list, tokens: int) -> dict:
        parts, at, starts, ends = [], 0, [], []
        for k, (role, text, _) in enumerate(repeated + new):
            turn, a, b = render(role, text)
            if k >= len(repeated) and role == "assistant":
                starts.append(at + a)
                ends.append(at + b)
            parts.append(turn)
            at += len(turn)
        self.window += 1
        values = (self.conv_id, self.window - 1, "".join(parts), len(repeated), len(repeated) + len(new), starts, ends, tokens, tokens > self.budget)
        return dict(zip(("conv_id", "window", "text", "n_repeated", "n_turns", "loss_start", "loss_end", "n_tokens", "oversize"), values))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 512) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def windows(turns: DataFrame, path: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> WINDOWS, a conversation's windows in order within a partition."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T._parse_datatype_string(WINDOWS)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def planned() -> Iterator[dict]:
            now = None
            for conv_id, role, text, n_tokens in _rows(batches):
                if now is None or now.conv_id != conv_id:
                    if now:
                        yield from now.plan(last=True)
                    now = _Conversation(conv_id, budget, history)
                yield from now.add(role, text, n_tokens)
            if now:
                yield from now.plan(last=True)

        yield from _batches(planned(), arrow, 128)

    def count(chunks: Iterator[list[list]]) -> Iterator[dict]:
        encode = tokenizer(path, plain_specials=True).encode
        for conv_ids, numbers, roles, texts in chunks:
            yield {"conv_id": conv_ids, "turn": numbers, "role": roles, "text": texts, "n_tokens": [len(ids) // 4 for ids in encode([t.encode() for t in texts])]}

    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    plain = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    # tokenised where they are read; only the plan of a conversation is made in one task
    counted = map_rows(plain, plain.columns, count, "conv_id long, turn long, role string, text string, n_tokens long", "tokens")
    dealt = counted.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text", "n_tokens").mapInArrow(run, out)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the windows' texts and masks alone."""
    import hashlib

    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T._parse_datatype_string("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[dict]:
            now, row, turns, loss = object(), None, None, None

            def closed() -> dict:
                return row | {"turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}

            for conv_id, window, text, repeated, starts, ends in _rows(batches):
                if row is None or window == 0:
                    if row:
                        yield closed()
                    row, turns, loss = {"conv_id": conv_id, "n_turns": 0, "loss_chars": 0, "formatted_chars": 0}, hashlib.sha256(), hashlib.sha256()
                new = parse(text)[repeated:]
                row["n_turns"] += len(new)
                row["formatted_chars"] += len(text)
                for role, said in new:
                    turns.update(f"{role}\n{said}\n".encode())
                for a, b in zip(starts, ends):
                    said = unescape(text[a:b])
                    row["loss_chars"] += len(said)
                    loss.update(said.encode())
            if row:
                yield closed()

        yield from _batches(digests(), arrow)

    ship(formatted.sparkSession)
    # windows of a conversation lie together and in order, as ``windows`` makes them
    return formatted.select("conv_id", "window", "text", "n_repeated", "loss_start", "loss_end").mapInArrow(run, out)

"""Chat formatting: a finite-state machine over roles and a declarative template with per-segment loss flags."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """marks: role -> (what stands before a text, what stands after it, loss on the text).

    A role without marks is written out between `role_marks`. A control string inside a text or a role is broken
    up by a backslash after its first character and a backslash is doubled, so no control string is left in it
    and reading back is exact.
    follows: role -> the states it may follow ("" is the start); the FSM's transitions.
    """

    begin: str = "<s>"
    marks: dict = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("[ANS] ", "</s>", True)})
    role_marks: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")
    follows: dict = field(default_factory=lambda: {"system": ("",), "user": ("", "system", "assistant"), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    @property
    def controls(self) -> tuple[str, ...]:
        own = [x.strip() for before, after, _ in self.marks.values() for x in (before, after)]
        return tuple(sorted({self.begin, *own, *self.role_marks}, key=lambda x: (-len(x), x)))

    def escape(self, text: str) -> str:
        return re.sub("|".join(map(re.escape, ("\\", *self.controls))), lambda m: m[0][0] + "\\" + m[0][1:], text)

    def turn(self, role: str, text: str) -> list[tuple[str, bool]]:
        """Segments of one turn with their loss flags."""
        before, after, loss = self.marks.get(role, (f"{self.role_marks[0]}{self.escape(role)}{self.role_marks[1]}", self.role_marks[2], False))
        return [(before, False), (self.escape(text), loss), (after, False)]


def step(template: Template, state: str, role: str) -> tuple[str, bool]:
    """The FSM's next state and whether the turn order allows it."""
    return role, state in template.follows.get(role, ())


class Reader:
    """Reads formatted segments back; it knows only the template. Holds one turn at a time."""

    def __init__(self, template: Template):
        self.t = template
        self.role_of = {b: r for r, (b, _, _) in template.marks.items()}
        opens = [*self.role_of, template.role_marks[0]]
        self.open = re.compile("|".join(map(re.escape, sorted(opens, key=len, reverse=True))))
        self.plain = re.compile(r"\\(.)", re.S)
        self.held, self.flags, self.started = "", [], False

    def until(self, stop: str, at: int) -> int:
        """Where an unescaped `stop` begins from `at`; -1 if it has not come."""
        found = re.compile(r"(?:\\.|(?!" + re.escape(stop) + r")[^\\])*", re.S).match(self.held, at)
        return found.end() if self.held.startswith(stop, found.end()) else -1

    def feed(self, text: str, loss: bool) -> Iterator[tuple[str, str, str]]:
        """(role, text, text under the loss mask) of each turn that is now whole."""
        self.held += text
        self.flags.append((len(text), loss))
        while self.held:
            at = 0
            if not self.started:
                if not self.held.startswith(self.t.begin):
                    return
                at = len(self.t.begin)
            if not (m := self.open.match(self.held, at)):
                return
            if m[0] in self.role_of:
                role, begin, stop = self.role_of[m[0]], m.end(), self.t.marks[self.role_of[m[0]]][1]
            else:
                if (end := self.until(self.t.role_marks[1], m.end())) < 0:
                    return
                role, begin, stop = self.plain.sub(r"\1", self.held[m.end() : end]), end + len(self.t.role_marks[1]), self.t.role_marks[2]
            if (end := self.until(stop, begin)) < 0:
                return
            whole, spans, pos = end + len(stop), [], 0
            for n, flag in self.flags:
                if flag:
                    spans.append(self.held[pos : min(pos + n, whole)])
                pos += n
            out = self.plain.sub(r"\1", self.held[begin:end]), self.plain.sub(r"\1", "".join(spans))
            self.started, rest = True, whole
            while rest and self.flags:
                n, flag = self.flags.pop(0)
                if n > rest:
                    self.flags.insert(0, (n - rest, flag))
                rest -= min(n, rest)
            self.held = self.held[whole:]
            yield role, *out


SEGMENTS = "conv_id long, seg int, text string, loss boolean, valid boolean, last boolean"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)))


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= most or size >= chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def _formatter(template: Template):
    schema = pa.schema([("conv_id", pa.int64()), ("seg", pa.int32()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_()), ("last", pa.bool_())])

    def segments(batches):
        now, state, valid, seg, held = (), "", True, 0, None
        for conv, role, text in _rows(batches):
            if now != (conv,):
                if held:
                    yield *held, valid and state in template.ends, True
                now, state, valid, seg = (conv,), "", True, 1
                held = conv, 0, template.begin, False
            role, text = role or "", text or ""
            state, fits = step(template, state, role)
            valid = valid and fits
            for piece, loss in template.turn(role, text):
                yield *held, valid, False
                held, seg = (conv, seg, piece, loss), seg + 1
        if held:
            yield *held, valid and state in template.ends, True

    return lambda batches: _batched(segments(batches), schema)


def format_chats(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments (conv_id, seg, text, loss, valid, last) of every conversation, in order within its partition.

    Joined by seg they are the formatted conversation. `valid` on the `last` segment says whether the
    machine accepted the whole turn order; conversations that it rejects are formatted all the same.
    Turns are ordered by turn (nulls first), then role, then text; a null text or role is empty; rows
    of a null conv_id are one conversation. Rows stream, so a conversation may be of any length. Rows that repeat
    another are turns of their own; an empty table gives no rows; other columns are not read.
    """
    c = conversations.select("conv_id", "turn", "role", "text")
    c = c.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return c.select("conv_id", "role", "text").mapInArrow(_formatter(template), SEGMENTS)


def digest_chats(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Digests of what a reader of the formatted segments gets back, a row per conversation."""
    schema = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())]
    )

    def digests(batches):
        reader = None
        for conv, seg, text, loss, valid, last in _rows(batches):
            if seg == 0:
                reader, turns, lost, n, chars, size = Reader(template), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            size += len(text)
            for role, said, masked in reader.feed(text, loss):
                n += 1
                turns.update(f"{role}\n{said}\n".encode())
                lost.update(masked.encode())
                chars += len(masked)
            if last:
                if reader.held not in ("", template.begin):
                    raise ValueError(f"conversation {conv} can't be read back")
                yield conv, n, turns.hexdigest(), chars, lost.hexdigest(), size, valid

    return segments.select("conv_id", "seg", "text", "loss", "valid", "last").mapInArrow(
        lambda b: _batched(digests(b), schema), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    )

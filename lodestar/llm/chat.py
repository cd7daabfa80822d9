"""Conversations as training text.

A template declares the roles' marks, the states of a finite-state machine over roles, and whose text is learned. A
conversation's rows are read by turn; the machine says of each whether its role may stand there, and each becomes three
segments: the role's mark, the text, and the end mark. Only the text of learned roles has its loss flag set. The output is
the segments' concatenation, and :func:`read_back` gives roles and texts again from segments alone.

Control strings inside texts are escaped: the backslashes before one are doubled and one more is put in front; backslashes
at a text's end are doubled. Everything else stays. The template refuses marks of which one holds another or runs into
another's beginning, so the marks of an output are known without doubt.

Rows are shuffled once by conversation and walked in order; a task holds some batches of rows, however long a conversation
is. Reading back keeps the one turn that it is in.

Defined results. A null text is empty and a null role is the role of no name. A role that the template does not name gets
the mark ``other``, its own name and ``role_end``; the machine never expects it and stays where it is. Out of order, a
turn is flagged (``expected`` false) and formatted all the same; the machine goes on from that role. Turns that are equal
stand in the order of role and text, null turns first, repeated rows each. Rows with a null conversation id are one
conversation. Empty and very long texts are formatted whole. Only ``conv_id``, ``turn``, ``role`` and ``text`` are read. No
rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 4096  # segments or turns of a batch that a task puts out


@dataclass(frozen=True)
class Template:
    """``marks``: what stands before a role's text. ``after``: for each state (``""`` at the beginning, then the last known
    role) the roles that may follow. ``learned``: roles whose text bears loss."""

    marks: dict[str, str]
    after: dict[str, frozenset[str]]
    learned: frozenset[str]
    end: str
    between: str = "\n"
    other: str = "### Role "
    role_end: str = "<role/>"
    _known: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        controls = [*self.marks.values(), self.end, self.other, self.role_end]
        if len(set(controls)) < len(controls) or not all(c and "\\" not in c for c in controls):
            raise ValueError("marks must be different, not empty and without backslash")
        for x in controls:
            for y in controls:
                inside = x != y and y in x
                runs_on = any(x.endswith(y[:k]) for k in range(1, min(len(x), len(y)) + (x != y)) if x != y or k < len(x))
                if inside or runs_on:
                    raise ValueError(f"{x!r} and {y!r} overlap")
        object.__setattr__(self, "_known", re.compile(r"(\\*)(" + "|".join(map(re.escape, controls)) + ")"))

    def escape(self, text: str) -> str:
        some = self._known.sub(lambda m: m[1] * 2 + "\\" + m[2], text)
        bare = some.rstrip("\\")
        return some + some[len(bare) :]

    def header(self, role: str) -> str:
        return self.marks.get(role) or self.other + self.escape(role) + self.role_end

    def expects(self, state: str, role: str) -> bool:
        return role in self.after.get(state, ())


#: A template of headings; a system turn may open, then user and assistant take turns.
HEADINGS = Template(
    marks={"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "},
    after={"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})},
    learned=frozenset({"assistant"}),
    end="</turn>",
)

_SEGMENT = "turn_no long, part string, text string, loss boolean, expected boolean"
_PARTS = ("mark", "text", "end")


def _in_order(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            yield from zip(*(some.column(c).to_pylist() for c in columns), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``ROWS`` rows, and of about ``most`` characters of text."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= ROWS or size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _type(batch_of: DataFrame, column: str) -> tuple[str, pa.DataType]:
    """Spark's and Arrow's name of a column's type: whole numbers and strings."""
    kind = dict(batch_of.dtypes)[column]
    return kind, {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string()}[kind]


def segments(conversations: DataFrame, template: Template = HEADINGS) -> DataFrame:
    """Rows ``conv_id``, ``turn_no`` (from 0), ``part`` (``mark``, ``text`` or ``end``), ``text``, ``loss`` and ``expected``
    (the machine allows the role there). A conversation's rows are in one partition and in order, for :func:`read_back`
    and writers that follow without a shuffle."""
    kind, arrow = _type(conversations, "conv_id")
    schema = pa.schema([("conv_id", arrow), ("turn_no", pa.int64()), ("part", pa.string()), ("text", pa.string()), ("loss", pa.bool_()), ("expected", pa.bool_())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, state, n = object(), "", 0
        for conv, role, text in _in_order(batches, "conv_id", "role", "text"):
            if conv != last:
                last, state, n = conv, "", 0
            expected = template.expects(state, role)
            state = role if role in template.marks else state
            for part, of in zip(_PARTS, (template.header(role), template.escape(text), template.end + template.between), strict=True):
                yield conv, n, part, of, part == "text" and role in template.learned, expected
            n += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batched(made(batches), schema)

    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select("conv_id", "turn", of("role"), of("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {kind}, {_SEGMENT}")


class _Reader:
    """Takes an output apart, piece by piece: ``feed`` gives the turns that a piece ends, as role, text and learned text. A
    mark stands in one piece; the backslashes that escape it may stand in the piece before."""

    def __init__(self, template: Template):
        self.template, self.roles = template, {m: r for r, m in template.marks.items()}
        self.role: str | None = None
        self.naming = False
        self.parts: list[tuple[str, bool]] = []
        self.held, self.held_loss = "", False

    def feed(self, piece: str, loss: bool) -> Iterator[tuple[str, str, str]]:
        t, before = self.template, len(self.held)
        text, at = self.held + piece, 0
        for m in t._known.finditer(text):
            if m.start() < at:
                raise ValueError("a mark inside what stands between turns")
            escaped, slashes = len(m[1]) % 2 == 1, "\\" * (len(m[1]) // 2)
            self._add(text, at, m.start(), before, loss)
            self.parts.append((slashes + m[2] * escaped, self.held_loss if m.start() < before else loss))
            at = m.end()
            if escaped:
                continue
            if m[2] == t.end and self.role is not None:
                yield self.role, self._text(), "".join(p for p, learned in self.parts if learned)
                self.role, self.parts = None, []
                at += len(t.between) * text.startswith(t.between, at)
            elif m[2] == t.role_end and self.naming:
                self.role, self.parts, self.naming = self._text(), [], False
            elif m[2] in self.roles and self.role is None and not self.naming:
                self.role, self.parts = self.roles[m[2]], []
            elif m[2] == t.other and self.role is None and not self.naming:
                self.naming, self.parts = True, []
            else:
                raise ValueError(f"{m[2]!r} where a turn does not allow it")
        rest = max(at, len(text.rstrip("\\")))
        self._add(text, at, rest, before, loss)
        self.held, self.held_loss = text[rest:], loss

    def _add(self, text: str, start: int, end: int, before: int, loss: bool) -> None:
        cut = min(max(start, before), end)
        self.parts += [(text[start:cut], self.held_loss), (text[cut:end], loss)]

    def _text(self) -> str:
        return "".join(p for p, _ in self.parts)


def read_back(made: DataFrame, template: Template = HEADINGS) -> DataFrame:
    """``conv_id``, ``turn_no``, ``role``, ``text`` and ``learned`` (what of the text bears loss) from the rows of
    :func:`segments`, of which only ``text`` and ``loss`` are looked at. No shuffle: the rows must be as ``segments`` gives them."""
    kind, arrow = _type(made, "conv_id")
    schema = pa.schema([("conv_id", arrow), ("turn_no", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("learned", pa.string())])

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, reader, n = object(), _Reader(template), 0
        for conv, text, loss in _in_order(batches, "conv_id", "text", "loss"):
            if conv != last:
                last, reader, n = conv, _Reader(template), 0
            for turn in reader.feed(text, loss):
                yield conv, n, *turn
                n += 1

    return made.select("conv_id", "text", "loss").mapInArrow(lambda batches: _batched(turns(batches), schema), f"conv_id {kind}, turn_no long, role string, text string, learned string")


def digests(made: DataFrame, template: Template = HEADINGS) -> DataFrame:
    """One row a conversation of :func:`segments`, read back from its output: ``n_turns``, ``turns_sha256`` (role, line end,
    text, line end of each turn), ``loss_chars`` and ``loss_sha256`` of the learned texts, ``formatted_chars`` of the whole
    output, and ``unexpected`` (turns that the machine does not allow). A digest is fed turn by turn."""
    kind, arrow = _type(made, "conv_id")
    names = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "unexpected": pa.int64()}
    schema = pa.schema([("conv_id", arrow), *names.items()])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        last, begun = None, False
        for conv, text, loss, expected, part in _in_order(batches, "conv_id", "text", "loss", "expected", "part"):
            if not begun or conv != last:
                if begun:
                    yield last, n, turns.hexdigest(), chars, learned.hexdigest(), whole, unexpected
                last, begun, reader, turns, learned = conv, True, _Reader(template), hashlib.sha256(), hashlib.sha256()
                n = chars = whole = unexpected = 0
            whole += len(text)
            unexpected += part == "mark" and not expected
            for role, of, own in reader.feed(text, loss):
                turns.update(f"{role}\n{of}\n".encode())
                learned.update(own.encode())
                n, chars = n + 1, chars + len(own)
        if begun:
            yield last, n, turns.hexdigest(), chars, learned.hexdigest(), whole, unexpected

    return made.select("conv_id", "text", "loss", "expected", "part").mapInArrow(lambda batches: _batched(rows(batches), schema), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, unexpected long")

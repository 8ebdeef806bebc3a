"""Chat formatting by incremental black-box rendering.

A template is any function from turns ``(role, text)`` to one string. Nothing about it is parsed: each conversation's
successive prefixes are rendered and consecutive outputs compared. What a turn adds is its piece; a turn after
which the earlier output is no prefix any more shows a template that rewrites history. Such a turn begins a new sample, whose
first piece is the rendering of the whole prefix, so every answer bears loss once, in the form it had when it was
given. Where a turn's own text stands is found by two probes: the prefix is rendered with two texts that differ in
their first and last character, and what both renderings share before and after is the turn's frame.

Turns are dealt by conversation, sorted, and read as a stream. A template that says how far it looks back
(``context`` turns) is rendered from a window: a conversation of any length then takes memory and time in
proportion to ``WINDOW``, not to its own length. That a turn's piece is the same from the shorter window is checked each time the window
moves; where it isn't, all of the conversation is kept. Without ``context`` a conversation's time grows with the square of its turns.
A conversation is one task's stream in any case, as its digest is a chain; it is never held as a group.

Defined results: null text and null role are empty; turns go by ``turn`` (null first), then role, then text; repeated rows
are turns of their own; rows of a null key are one conversation; empty tables give empty tables; texts of any
length are rendered whole; other columns don't take part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

#: Roles whose texts bear loss; turns of a window; characters of a batch of results.
BEARS = ("assistant",)
WINDOW = 64
BATCH = 1 << 20
PIECES = "pos bigint, sample bigint, role string, piece string, start bigint, loss_start bigint, loss_end bigint, rewrote boolean"

_CONTROL = re.compile(r"\\|</?turn>|###")
_NAME = re.compile(r"\\|</?turn>|###|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn>### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def marked(turns: Sequence[Turn]) -> str:
    """The template of the query: turns between marks; marks, heads and backslashes inside texts get a backslash before them."""
    return "".join(f"<turn>### {_NAME.sub(_escape, role)}: {_CONTROL.sub(_escape, text)}</turn>\n" for role, text in turns)


def _escape(found: re.Match) -> str:
    return "\\" + found[0]


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Reader:
    """Turns read back from formatted text that comes in pieces, cut anywhere."""

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str) -> Iterator[Turn]:
        self.rest += piece
        at = 0
        while found := _TURN.match(self.rest, at):
            yield unescaped(found[1]), unescaped(found[2])
            at = found.end()
        self.rest = self.rest[at:]


def shared_prefix(a: str, b: str) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def frame(template: Template, before: Sequence[Turn], role: str) -> tuple[str, str]:
    """What a turn's text stands between in the output of a prefix that ends with it."""
    a, b = (template([*before, (role, probe)]) for probe in ("a", "b"))
    head = shared_prefix(a, b)
    tail = shared_prefix(a[head:][::-1], b[head:][::-1])
    return a[:head], a[len(a) - tail :]


class Rendering:
    """One conversation, turn by turn."""

    def __init__(self, template: Template, bears: Sequence[str] = BEARS, context: int | None = None, window: int = WINDOW):
        self.template, self.bears, self.context, self.window = template, bears, context, window
        self.turns: list[Turn] = []
        self.out, self.pos, self.sample, self.length, self.moved = "", 0, 0, 0, False

    def feed(self, role: str, text: str) -> tuple:
        """The row of the next turn: ``PIECES``. Loss is given by places in the piece's sample."""
        now = self.template([*self.turns, (role, text)])
        rewrote = not now.startswith(self.out)
        if rewrote:
            if self.moved:
                raise ValueError("the template rewrites turns before its context")
            self.sample, self.length = self.sample + 1, 0
        piece = now if rewrote else now[len(self.out) :]
        lo = hi = None
        if role in self.bears:
            head, tail = frame(self.template, self.turns, role)
            if not (now.startswith(head) and now.endswith(tail) and len(now) >= len(head) + len(tail)):
                raise ValueError("the template frames a text by what it says")
            first = len(now) - len(piece)
            lo, hi = (self.length + x - first for x in (len(head), len(now) - len(tail)))
        row = (self.pos, self.sample, role, piece, self.length, lo, hi, rewrote)
        self.turns.append((role, text))
        self.out, self.pos, self.length = now, self.pos + 1, self.length + len(piece)
        if self.context is not None and len(self.turns) > max(self.window, self.context + 1) and not rewrote:
            self._move(piece)
        return row

    def _move(self, piece: str) -> None:
        near = self.turns[-self.context - 1 :]
        out = self.template(near)
        before = self.template(near[:-1]) if self.context else ""
        if out.startswith(before) and out[len(before) :] == piece:
            self.turns, self.out, self.moved = near, out, True
        else:
            self.context = None


def render(turns: DataFrame, template: Template = marked, context: int | None = None, bears: Sequence[str] = BEARS, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(key, pos, sample, role, piece, start, loss_start, loss_end, rewrote)``: a row for each turn.

    A sample's pieces, joined by ``pos``, are its text; ``start`` is the piece's place there, as are the ends of the loss (null: none).
    Rows of a conversation follow one another in order, within one partition.
    """
    rows = turns.select(F.col(key).alias("k"), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"), F.coalesce(text, F.lit("")).alias("x"))
    dealt = rows.repartition("k").sortWithinPartitions("k", F.asc_nulls_first("t"), "r", "x")
    kind = dict(turns.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, of = None, None, pa.int64()
        held: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            k, pos, sample, who, piece, start, lo, hi, new = zip(*held, strict=True)
            long = pa.int64()
            return pa.RecordBatch.from_arrays([pa.array(k, of), pa.array(pos, long), pa.array(sample, long), pa.array(who, pa.string()), pa.array(piece, pa.string()), pa.array(start, long), pa.array(lo, long), pa.array(hi, long), pa.array(new)], names=[key, *(x.split()[0] for x in PIECES.split(", "))])

        for part in pieces(batches, 3):
            of = part.schema.field(0).type
            for k, r, x in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                if now is None or k != last:
                    last, now = k, Rendering(template, bears, context, window)
                held.append((k, *now.feed(r, x)))
                size += len(held[-1][4])
                if size > BATCH:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    return dealt.mapInArrow(run, f"`{key}` {kind}, {PIECES}")


def texts(rendered: DataFrame, key: str = "conv_id") -> DataFrame:
    """``(key, sample, text, loss, rewrote)``: the samples as whole texts, for conversations that fit a row; ``loss``: places ``[start, end)``."""
    got = rendered.groupBy(key, "sample").agg(F.sort_array(F.collect_list(F.struct("pos", "piece", "loss_start", "loss_end"))).alias("p"), F.max("rewrote").alias("rewrote"))
    loss = F.transform(F.filter("p", lambda x: x["loss_start"].isNotNull()), lambda x: F.struct(x["loss_start"].alias("start"), x["loss_end"].alias("end")))
    return got.select(key, "sample", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("text"), loss.alias("loss"), "rewrote")


def digest(rendered: DataFrame, key: str = "conv_id") -> DataFrame:
    """What the output of ``marked`` says when it is read back, a row for each conversation; conversations are read as they stand in ``rendered``."""
    kind = dict(rendered.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, names = pa.int64(), [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        state: list = []
        done: list[tuple] = []

        def finish() -> None:
            k, reader, n, turns, chars, loss, total = state
            if reader.rest:
                raise ValueError("text that is no turn")
            done.append((k, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def rows() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            kinds = [of, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            of = batch.schema.field(0).type
            for k, piece, start, lo, hi in zip(*(batch.column(c).to_pylist() for c in (0, 4, 5, 6, 7)), strict=True):
                if not state or state[0] != k:
                    if state:
                        finish()
                    state = [k, Reader(), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in state[1].feed(piece):
                    state[2] += 1
                    state[3].update(f"{role}\n{text}\n".encode())
                if lo is not None:
                    under = unescaped(piece[lo - start : hi - start])
                    state[4] += len(under)
                    state[5].update(under.encode())
                state[6] += len(piece)
            if done:
                yield rows()
                done = []
        if state:
            finish()
            yield rows()

    return rendered.mapInArrow(run, f"`{key}` {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")

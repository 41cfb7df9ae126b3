"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) turns to a string. Turn by turn,
the conversation so far is rendered again and compared with the rendering before: what
was added is the span of the new turn. A rendering that does not begin with the one
before shows a template that rewrites history; it has no spans and is reported.

Rows stream through tasks sorted by conversation and turn. A template is given all turns
so far, each time, so time grows with the square of a conversation's turns. Only a
template that declares itself turn-local (``template.turn_local = True``: what a turn
adds depends on no other turn) is given a window: after ``WINDOW`` turns a new one
starts with the last two, and must render the second of them as before, so memory and
time stay in proportion to single turns however long a conversation is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basewise.llm.common import slices

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

WINDOW = 32
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


class RewritesHistory(ValueError):
    """The template changed what it had rendered for earlier turns."""


def escape(text: str) -> str:
    r"""Text without any control string: ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    """A role on one line: as text, with ``\\n`` for a line feed."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def marked(turns: list[Turn]) -> str:
    """The template of this package: each turn between markers, its role on the first line."""
    return "".join(f"{OPEN}{escape_role(role)}\n{escape(text)}{CLOSE}" for role, text in turns)


marked.turn_local = True


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns read back from the output of ``marked``: role, text, and the place of the escaped text."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn starts at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line + 1)
        out.append((unescape_role(formatted[at + len(OPEN):line]), unescape(formatted[line + 1:end]), line + 1, end))
        at = end + len(CLOSE)
    return out


@dataclass
class Span:
    """What a turn added: its text in the output, and where that starts."""

    role: str
    start: int
    added: str


class Renderer:
    """Spans of the turns of one conversation, given one by one; ``window`` counts for turn-local templates only."""

    def __init__(self, template: Template, window: int = WINDOW) -> None:
        self.template, self.window = template, window if getattr(template, "turn_local", False) else None
        self.turns: list[Turn] = []
        self.before, self.length, self.last = template([]), 0, ""
        self.head = self.before

    def add(self, role: str, text: str) -> Span:
        if self.window and len(self.turns) >= self.window:
            self._slide()
        self.turns.append((role, text))
        now = self.template(self.turns)
        if not now.startswith(self.before):
            raise RewritesHistory(f"turn {len(self.turns)} changed earlier output")
        added, self.before, self.last = now[len(self.before):], now, now[len(self.before):]
        if not self.length:
            added = self.head + added
        span = Span(role, self.length, added)
        self.length += len(added)
        return span

    def _slide(self) -> None:
        """Goes on from the last two turns; the later one must come out as it did in the whole."""
        two = self.turns[-2:]
        one, both = self.template(two[:1]), self.template(two)
        if not both.startswith(one) or both[len(one):] != self.last:
            raise RewritesHistory("a turn renders differently without the turns before")
        self.turns, self.before = two, both


def render(turns: list[Turn], template: Template = marked) -> list[Span]:
    """The spans of a whole conversation."""
    renderer = Renderer(template)
    return [renderer.add(role, text) for role, text in turns]


def rewrites(turns: list[Turn], template: Template) -> bool:
    """Whether the template changes what it rendered before for these turns."""
    try:
        render(turns, template)
    except RewritesHistory:
        return True
    return False


def _sorted_turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = df.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def format_turns(
    df: DataFrame, template: Template = marked, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``conv_id, position, role, start, added``: each turn's stretch of the formatted conversation, in order.

    Turns go by ``turn`` (null first, then role and text for equal ones); repeated rows
    are turns of their own; null roles and texts are empty; a null ``conv_id`` is one
    conversation. Joined in order, ``added`` is the formatted conversation. An empty
    table gives no rows; other columns are never read. A template that rewrites history
    stops the job with ``RewritesHistory``. Unless the template is turn-local, it renders
    every prefix of a conversation in full, and the task holds the conversation.
    """
    schema = T.StructType([
        T.StructField("conv_id", df.schema[conv_col].dataType), T.StructField("position", T.LongType()), T.StructField("role", T.StringType()),
        T.StructField("start", T.LongType()), T.StructField("added", T.StringType()),
    ])
    names, types = schema.fieldNames(), [pa.int64(), pa.string(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, renderer, current, position = None, None, None, 0

        for batch in slices(batches):
            kind, out = batch.column("conv_id").type, []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if renderer is None or conv != current:
                    renderer, current, position = Renderer(template), conv, 0
                span = renderer.add(role, text)
                out.append((conv, position, role, span.start, span.added))
                position += 1
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *types])], names=names)

    return _sorted_turns(df, conv_col, turn_col, role_col, text_col).mapInArrow(run, schema)


class _Digest:
    """What is read back from one formatted conversation, a span at a time."""

    def __init__(self, conv: object) -> None:
        self.conv, self.turns, self.chars, self.loss = conv, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()
        self.renderer = Renderer(marked)

    def add(self, role: str, text: str) -> None:
        added = self.renderer.add(role, text).added
        self.chars += len(added)
        for found, body, start, end in parse(added):
            self.turns += 1
            self.all.update(f"{found}\n{body}\n".encode())
            if found == "assistant":
                # The loss mask covers the escaped text between the markers.
                own = unescape(added[start:end])
                self.loss += len(own)
                self.masked.update(own.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def digest_table(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation, read back from its formatted output, with the rules of ``format_turns``.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.
    """
    schema = T.StructType([
        T.StructField("conv_id", df.schema[conv_col].dataType), T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ])
    names, types = schema.fieldNames(), [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, kind = None, None

        def batch_of(done: list[_Digest]) -> pa.RecordBatch:
            columns = list(zip(*(d.row() for d in done))) if done else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *types])], names=names)

        for batch in slices(batches):
            kind, done = batch.column("conv_id").type, []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if digest is None or conv != digest.conv:
                    done += [digest] if digest else []
                    digest = _Digest(conv)
                digest.add(role, text)
            yield batch_of(done)
        if digest:
            yield batch_of([digest])

    return _sorted_turns(df, conv_col, turn_col, role_col, text_col).mapInArrow(run, schema)

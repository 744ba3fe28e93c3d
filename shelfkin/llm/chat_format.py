"""Conversations as training text, with the loss mask found by rendering prefixes.

The template is a black box: a function from turns to text.  Each conversation is rendered after
every turn, and consecutive outputs are compared: what a turn adds is its span.  A render that
does not begin with the one before has rewritten history, and is reported as such.  Where the
turn's own text lies in its span is found the same way: rendering the turn as still open gives
what comes before the text, rendering it with no text gives what comes after.

The shipped template brackets the role and closes the turn; control strings inside a text are
broken up by one backslash after their first character (one more where there are some already),
so that no control string appears but the template's own, and every text can be had back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfkin.llm.common import shared_path

# The control strings of the template.
ROLE_OPEN, ROLE_CLOSE, TURN_CLOSE = "[INST]", "[/INST]", "</s>"
CONTROL = re.compile(r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])")
ESCAPED = re.compile(r"(<)\\(\\*)(/?s>)|(\[)\\(\\*)(/?INST\])")
WRITTEN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.DOTALL)


class Turn(NamedTuple):
    role: str
    text: str


Template = Callable[[Sequence[Turn], str | None], str]


def escape(text: str) -> str:
    """`text` without any control string; `unescape` gives it back."""
    return CONTROL.sub(lambda m: f"{m[1] or m[4]}\\{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: f"{m[1] or m[4]}{m[2] or m[5] or ''}{m[3] or m[6]}", text)


def template(turns: Sequence[Turn], open_role: str | None = None) -> str:
    """`[INST]role[/INST]text</s>` for each turn, then the opening of a turn of `open_role`."""
    out = "".join(f"{ROLE_OPEN}{escape(t.role)}{ROLE_CLOSE}{escape(t.text)}{TURN_CLOSE}" for t in turns)
    return out if open_role is None else f"{out}{ROLE_OPEN}{escape(open_role)}{ROLE_CLOSE}"


def parse(formatted: str) -> list[Turn]:
    """The turns of a text that `template` wrote."""
    return [Turn(unescape(r), unescape(t)) for r, t in WRITTEN.findall(formatted)]


class Formatted(NamedTuple):
    text: str
    spans: list[tuple[int, int]]  # of each turn
    mask: list[tuple[int, int]]  # of what the loss is taken over
    rewrites: list[int]  # turns after which earlier output had changed


def render(
    turns: Sequence[Turn],
    box: Template = template,
    learn: Iterable[str] = ("assistant",),
    context: int | None = None,
) -> Formatted:
    """Render successive prefixes with `box` and compare consecutive outputs.

    Whole prefixes cost the square of the number of turns.  A template may declare that a turn's
    output depends on no more than `context` turns before it; then each prefix is cut to those,
    and the pieces put together are compared with one render of the whole.  Where they differ
    (the declaration is wrong, or the template rewrites history) whole prefixes are rendered.

    A turn that rewrites history gets the span from where the outputs part, and nothing of its
    conversation is put under the mask, as earlier offsets no longer hold.
    """
    learn = frozenset(learn)
    if context is not None:
        pieces = _render(turns, box, learn, context)
        if not pieces.rewrites and pieces.text == box(turns, None):
            return pieces
    return _render(turns, box, learn, len(turns))


def _render(turns: Sequence[Turn], box: Template, learn: frozenset[str], context: int) -> Formatted:
    before = box(turns[:0], None)
    pieces, at = [before], len(before)  # what stands so far, and its length
    spans, mask, rewrites = [], [], []
    for i, turn in enumerate(turns):
        prior = turns[max(0, i - context) : i]
        if i > context:
            before = box(prior, None)
        after = box([*prior, turn], None)
        shift = at - len(before)
        if after.startswith(before):
            spans.append((at, shift + len(after)))
            pieces.append(after[len(before) :])
            if turn.role in learn:
                opened = box(prior, turn.role)
                blank = box([*prior, Turn(turn.role, "")], None)
                end = len(after) - (len(blank) - len(opened))
                if after.startswith(opened) and blank.startswith(opened) and after[end:] == blank[len(opened) :]:
                    mask.append((shift + len(opened), shift + end))
        else:
            rewrites.append(i)
            spans.append((shift + _common(before, after), shift + len(after)))
            pieces = [after]
        at, before = shift + len(after), after
    return Formatted("".join(pieces), spans, [] if rewrites else mask, rewrites)


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def conversations_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[Turn]]]:
    """Conversations from batches sorted by conv_id; one is held at a time."""
    now: tuple | None = None
    turns: list[Turn] = []
    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))
        for conv, role, text in zip(*columns):
            if now is None or now[0] != conv:
                if now is not None:
                    yield now[0], turns
                now, turns = (conv,), []
            turns.append(Turn(role, text))
    if now is not None:
        yield now[0], turns


_PAIRS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SCHEMA = (
    "conv_id long, formatted string, spans array<struct<start:long,end:long>>, "
    "mask array<struct<start:long,end:long>>, rewrites array<int>"
)


TEMPLATE_CONTEXT = 1  # what `template` declares as `context`


def format_conversations(turns: DataFrame, box: Template = template, context: int | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans, mask, rewrites.

    Turns are taken in the order of `turn`, ties by role and text; null roles and texts count as
    empty, null turns come first, rows without conv_id form one conversation, repeated rows are
    turns of their own, other columns are not read, and an empty table gives an empty result.
    Rows are dealt by conversation and sorted outside memory; a task holds one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            conv, text, spans, mask, rewrites = zip(*rows)
            pairs = [pa.array([[{"start": s, "end": e} for s, e in x] for x in y], _PAIRS) for y in (spans, mask)]
            arrays = [pa.array(conv, pa.int64()), pa.array(text, pa.string()), *pairs, pa.array(rewrites, pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(arrays, ["conv_id", "formatted", "spans", "mask", "rewrites"])

        for conv, talk in conversations_of(batches):
            rows.append((conv, *render(talk, box, context=context)))
            size += len(rows[-1][1])
            if size > 1 << 22:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    tidy = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = tidy.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, _SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of a formatted table, from its texts and masks alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = (batch.column(n).to_pylist() for n in ("conv_id", "formatted", "mask"))
            for conv, text, mask in zip(*columns):
                turns = parse(text)
                whole = "".join(f"{t.role}\n{t.text}\n" for t in turns)
                under = "".join(unescape(text[m["start"] : m["end"]]) for m in mask)
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, under)]
                rows.append((conv, len(turns), digests[0], len(under), digests[1], len(text)))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return formatted.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def write_formatted(turns: DataFrame, box: Template = template, context: int | None = None) -> str:
    """Format and write as Parquet in the shared folder; the path."""
    path = shared_path(turns.sparkSession, "chats")
    format_conversations(turns, box, context).write.parquet(path)
    return path

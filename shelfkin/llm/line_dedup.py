"""Deletes runs of lines that stand elsewhere earlier, found by winnowing.

A text is a sequence of lines; a line is parted further at blanks after sentence ends, as a
passage often starts in the middle of a line.  Lines of white space alone do not count.  A window is the shortest run of lines, from a given one, with at
least `min_words` words.  Of each window the line with the smallest hash is selected (winnowing),
where the first bits of a hash are set by its number of words, so that long lines, which seldom
recur by chance, come first.  Equal windows select equal lines, so every repeated run of
`min_words` words is sure to hold a selected line that occurs twice.  Only such lines are followed up: their positions are joined,
and from each the match is extended both ways over all windows that selected it, which are
compared by 128-bit keys.  Of equal windows the one that comes first, by doc_id and position,
stays; the lines of all others are deleted.  So longer repeated runs go as a whole.

Whole lines, from one line end to the next, of at least `line_words` words are looked at one by
one beside the windows, as the most repeated lines stand alone.  They are counted by the same
pass and compared by 128-bit keys of their text.

Passages may also begin and end inside a line.  So the same is done word by word, whatever parts
the words: of the hashes of `GRAM_WORDS` words in each window of `PASSAGE_WORDS` words the
smallest is selected, windows whose selected one occurs twice are compared by 128-bit keys, and
all but the first of equal windows go.  Neighbouring windows that select the same place are compared
as one group first; only where groups with equal selected words differ, at the ends of passages,
are the windows of the first of each kind of group compared one by one.  Words are hashed over the
bytes of a text at once.

Selected lines that occur once, nearly all, leave after one count of hashes.  No pairs are
formed: each window is compared with the first of its kind only, whatever their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfkin.llm.common import parts_of, passing_tables, stored, text_of

MIN_WORDS = 25
LINE_WORDS = 4
PASSAGE_WORDS = 50  # every repeated run of so many words goes, wherever it begins
GRAM_WORDS = 25
BETWEEN = re.compile(r"\n+|(?<=[.!?]) +")
WORD = re.compile(r"[^\t-\r ]+")
# What `str.strip` takes besides what parts words.
RARE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
SEED = 42
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the two window keys
ROWS_HANDED_ON = 1 << 14
PART_BYTES = 1 << 18  # of text worked on at once
HASHED_BYTES = 1 << 16
FIRST_ID = -(1 << 63)  # where rows without doc_id come


def _mod(value: int) -> np.uint64:
    return np.uint64(value & ((1 << 64) - 1))


def windows_of(hashes: np.ndarray, words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last line of each window, and the place of its smallest hash (the first, if several)."""
    ends = np.cumsum(words)
    last = np.searchsorted(ends, ends - words + min_words)
    last = last[last < len(words)]
    first = np.arange(len(last))
    if not len(first):
        return first, last, first
    order = ((15 - np.minimum(words, 15)).astype(np.uint64) << np.uint64(60)) | (hashes >> np.uint64(4))
    levels = [np.arange(len(hashes))]  # places of the smallest hash of 1, 2, 4, ... lines
    longest = int((last - first).max()) + 1
    while 2 << (len(levels) - 1) <= longest:
        below, half = levels[-1], 1 << (len(levels) - 1)
        a, b = below[:-half], below[half:]
        levels.append(np.where(order[a] <= order[b], a, b))
    level = np.log2(last - first + 1).astype(np.int64)
    place = np.empty(len(first), np.int64)
    for i, places in enumerate(levels):
        here = np.flatnonzero(level == i)
        a, b = places[first[here]], places[last[here] - (1 << i) + 1]
        place[here] = np.where(order[a] <= order[b], a, b)
    return first, last, place


def _made_powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    base = BASES[which]
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _mod(b))]) for b in (base, pow(base, -1, 1 << 64)))
    return up, down


_kept_powers = lru_cache(maxsize=8)(_made_powers)


def _powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The first `n` powers, or more, of a base and of its inverse; only short tables are kept."""
    size = max(1 << 16, 1 << n.bit_length())
    return _kept_powers(size, which) if size <= 1 << 18 else _made_powers(n, which)


def _sums(values: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the values, each times its power of the inverse; and powers of the base."""
    up, down = _powers(len(values) + 1, which)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * down[: len(values)], out=sums[1:])
    return sums, up


def keys_of(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit keys of each window, which depend on its hashes and their order only."""
    out = []
    for which, values in enumerate((hashes, (hashes ^ (hashes >> np.uint64(29))) * _mod(0xBF58476D1CE4E5B9))):
        sums, up = _sums(values, which)
        out.append((sums[last + 1] - sums[first]) * up[first])
    return out


def _edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of True begins and ends."""
    change = np.empty(len(inside) + 1, bool)
    change[0], change[-1] = inside[:1].any(), inside[-1:].any()
    np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
    edges = np.flatnonzero(change)
    return edges[::2], edges[1::2]


def _gaps(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches before and between ascending places that are not empty."""
    start = np.r_[0, places[:-1] + 1][: len(places)]
    some = np.flatnonzero(start < places)
    return start[some], places[some]


def _blank(raw: np.ndarray) -> np.ndarray:
    """Which bytes part words: tab to carriage return, and the blank."""
    return (raw == 32) | (raw - np.uint8(9) < 5)


def _words_in(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word, some `HASHED_BYTES` at a time."""
    start, end = _edges(~_blank(raw))
    hashes, done = np.empty(len(start), np.uint64), 0
    while done < len(start):
        stop = max(done + 1, int(np.searchsorted(end, start[done] + HASHED_BYTES, side="right")))
        base, here = start[done], slice(done, stop)
        sums, up = _sums(raw[base : end[stop - 1]] + np.uint64(1), 0)
        hashes[here] = (sums[end[here] - base] - sums[start[here] - base]) * up[start[here] - base]
        done = stop
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        hashes = (hashes ^ (hashes >> np.uint64(shift))) * _mod(factor)
    return start, end, hashes ^ (hashes >> np.uint64(32))


def words_of(text: bytes) -> np.ndarray:
    """Hash of each word, as `WORD` finds them."""
    return _words_in(np.frombuffer(text, np.uint8))[2]


def grams_of(words: np.ndarray, passage: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `gram` words, and which of them each window of `passage` words selects."""
    sums, up = _sums(words, 0)
    grams = (sums[gram:] - sums[:-gram]) * up[: max(0, len(words) - gram + 1)]
    grams = (grams ^ (grams >> np.uint64(31))) * _mod(0x94D049BB133111EB)
    return grams, smallest_of(grams, passage - gram + 1)


def smallest_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest hash (the first, if several) in each window of `width` hashes."""
    low, place, size = hashes >> np.uint64(4), np.arange(len(hashes)), 1
    if len(hashes) < width:
        return place[:0]
    while size < width:
        step = min(size, width - size)
        here, there = slice(None, -step), slice(step, None)
        place = np.where(low[here] <= low[there], place[here], place[there])
        low = np.minimum(low[here], low[there])
        size += step
    return place


class Texts:
    """Several texts one after another, a line end after each, and where their words stand."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join([*texts, b""])
        self.raw = np.frombuffer(self.data, np.uint8)
        self.size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.r_[0, np.cumsum(self.size + 1)]

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        return cls([text or b"" for text in column.cast(pa.binary()).to_pylist()])

    def text_at(self, places: np.ndarray) -> np.ndarray:
        """In which text each of some ascending places is."""
        return np.repeat(np.arange(len(self.size)), np.diff(np.searchsorted(places, self.begin)))

    def spans(self, starts: np.ndarray, text: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of the things that begin at `starts` those from `first` to before `stop`, with what parts them from the next.

        A span is one number, its start and end in bytes; spans of a text are in order of their starts.
        """
        text = text[first]
        end = np.minimum(np.r_[starts, len(self.data)][stop], self.begin[text + 1] - 1)
        return ((starts[first] - self.begin[text]) << 32) | (end - self.begin[text])

    def content(self) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of what `str.strip` leaves begin and end."""
        raw, white = self.raw, _blank(self.raw)
        at = np.flatnonzero((raw - np.uint8(0x1C) < 4) | (raw == 0xC2) | (raw - np.uint8(0xE1) < 3))
        first, then = raw[at], raw[at + 1]  # the last byte is a line end
        may = (first < 0x20) | ((first == 0xC2) & ((then == 0x85) | (then == 0xA0))) | ((first == 0xE1) & (then == 0x9A))
        may |= ((first == 0xE2) & ((then == 0x80) | (then == 0x81))) | ((first == 0xE3) & (then == 0x80))
        for place in at[may].tolist():
            found = RARE.match(self.data, place)
            if found:
                white[place : found.end()] = True
        return _edges(~white)

    def stripped(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of some runs are not blank, and where these begin and end without white space around."""
        before = np.searchsorted(self.filled[0], start)
        after = np.searchsorted(self.filled[0], end)
        some = np.flatnonzero(before < after)
        return some, self.filled[0][before[some]], self.filled[1][after[some] - 1]

    def find_lines(self) -> None:
        """`lines`: where lines begin, as `BETWEEN` parts them; `whole`: the same of whole lines, and their ends."""
        raw, self.filled = self.raw, self.content()
        parted = raw == 10
        whole = _gaps(np.flatnonzero(parted))
        self.blanks = np.r_[np.int32(0), np.cumsum(raw == 32, dtype=np.int32)]
        stop = np.flatnonzero((raw == 46) | (raw == 33) | (raw == 63))
        after = stop[raw[stop + 1] == 32] + 1
        parted[after] = True
        if (raw[after + 1] == 32).any():
            first, last = _edges(raw == 32)
            again = np.searchsorted(first, after)
            some = np.flatnonzero(last[again] - after > 1)
            for a, b in zip(after[some].tolist(), last[again[some]].tolist()):
                parted[a:b] = True
        start, end = _gaps(np.flatnonzero(parted))
        some, self.lines_from, self.lines_to = self.stripped(start, end)
        self.lines = start[some]
        some, self.whole_from, self.whole_to = self.stripped(*whole)
        self.whole = whole[0][some], whole[1][some]

    def words_between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.blanks[end] - self.blanks[start] + 1

    def hashed(self, start: np.ndarray, end: np.ndarray, digest) -> list:
        data = self.data
        return [digest(data[a:b], SEED) for a, b in zip(start.tolist(), end.tolist())]


def _without(texts: Texts, text: np.ndarray, span: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The texts without some spans, and the deleted spans of each in code points."""
    start, end = (x + texts.begin[text] for x in (span >> 32, span & 0xFFFFFFFF))
    order = np.argsort(start, kind="stable")
    text, start, end = text[order], start[order], np.maximum.accumulate(end[order])
    ahead = np.flatnonzero(start[1:] > end[:-1]) + 1  # spans that touch are one
    first = np.r_[0, ahead]
    text, start, end = text[first], start[first], end[np.r_[ahead, len(end)] - 1]
    change = np.zeros(len(texts.raw), np.int8)
    change[start] = 1
    change[end] = -1
    kept = np.cumsum(change, dtype=np.int8) == 0
    kept[texts.begin[1:] - 1] = False
    left = texts.size - np.bincount(text, end - start, len(texts.size)).astype(np.int64)
    ends = np.r_[0, np.cumsum(left)].astype(np.int32)
    changed = pa.Array.from_buffers(pa.string(), len(left), [None, pa.py_buffer(ends), pa.py_buffer(texts.raw[kept])])
    where = [at - texts.begin[text] for at in (start, end)]
    if not texts.data.isascii():
        points = np.r_[0, np.cumsum((texts.raw & 0xC0) != 0x80)]
        where = [points[at] - points[texts.begin[text]] for at in (start, end)]
    gone = pa.StructArray.from_arrays([pa.array(at) for at in where], ["start", "end"])
    places = np.searchsorted(text, np.arange(len(left) + 1)).astype(np.int32)
    return changed, pa.ListArray.from_arrays(pa.array(places), gone)


def cut(text: str, runs: list[tuple[int, int]], passages: list[tuple[int, int]] = ()) -> tuple[str, list[tuple[int, int]]]:
    """`text` without runs of lines and of words (first, last), and the deleted spans in code points.

    What parts a line or word from the next goes with it.
    """
    texts = Texts([text.encode()])
    texts.find_lines()
    spans = [np.empty(0, np.int64)]
    for starts, some in ((texts.lines, runs), (_edges(~_blank(texts.raw))[0], passages)):
        first, last = np.array(some, np.int64).reshape(-1, 2).T
        spans.append(texts.spans(starts, np.zeros(len(starts), np.int64), first, last + 1))
    spans = np.concatenate(spans)
    if not len(spans):
        return text, []
    changed, gone = _without(texts, np.zeros(len(spans), np.int64), spans)
    return changed[0].as_py(), [(d["start"], d["end"]) for d in gone[0].as_py()]


_KEY = ("ord", "mark")


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with what identifies and orders documents: doc_id (null first) and a hash of the text."""
    return docs.withColumns(
        {
            "ord": F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)),
            "mark": F.xxhash64(F.coalesce("text", F.lit(""))),
        }
    )


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The values in lists of so many."""
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values))


def _binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The bytes of so many values each."""
    ends = np.r_[0, np.cumsum(counts)] * (values.nbytes // max(1, len(values)))
    buffers = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))]
    return pa.Array.from_buffers(pa.binary(), len(counts), buffers)


def _values(column: pa.Array, kind: type, width: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of binaries, and how many each row has."""
    stores = [b.as_buffer() for b in column]
    counts = np.fromiter((len(b) for b in stores), np.int64, len(stores)) // (np.dtype(kind).itemsize * width)
    values = np.frombuffer(b"".join(stores), kind)
    return (values if width == 1 else values.reshape(-1, width)), counts


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and the row of each."""
    counts = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), counts)


def _own(batch: pa.RecordBatch, row: np.ndarray) -> list[np.ndarray]:
    """What identifies the documents of some rows."""
    return [batch.column(k).to_numpy()[row] for k in _KEY]


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _hashed(df: DataFrame) -> DataFrame:
    """The right side of a join, held as a hash table, so that the larger left side need not be sorted.

    It must have its keys once: then the shuffle deals it evenly, whatever the left side has.
    """
    return df.hint("shuffle_hash")


def _twice(chosen: DataFrame) -> DataFrame:
    """The `h` that occur twice."""
    # A repeated row is one document: what it has is counted twice here, which only adds candidates.
    return stored(chosen.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "twice")


def _firsts(windows: DataFrame, *more: str) -> DataFrame:
    """Of `windows` with equal keys the first, and how many there are (`n`)."""
    names = [*_KEY, "span", *more]
    earliest = windows.groupBy("k1", "k2").agg(F.min(F.struct(*names)).alias("e"), F.count(F.lit(1)).alias("n"))
    return earliest.select("k1", "k2", "e.*", "n").toDF("k1", "k2", *(f"{name}0" for name in names), "n")


def _later(windows: DataFrame, firsts: DataFrame | None = None) -> DataFrame:
    """(ord, mark, span) of `windows` but for the first of those with equal keys."""
    firsts = stored(_firsts(windows).filter("n > 1"), "firsts") if firsts is None else firsts.filter("n > 1")
    later = windows.join(_hashed(firsts), ["k1", "k2"]).filter("ord <> ord0 OR mark <> mark0 OR span <> span0")
    return later.select(*_KEY, "span")


def _texts(docs: DataFrame) -> DataFrame:
    return _keyed(docs.select("doc_id", text_of())).select(*_KEY, "text")


def _handed_on(rows: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns of many documents in batches of about `ROWS_HANDED_ON` rows."""
    held: list[list[np.ndarray]] = []
    size = 0
    for columns in rows:
        held.append(columns)
        size += len(columns[0])
        if size >= ROWS_HANDED_ON:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)
            held, size = [], 0
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names)


def repeated_passages(docs: DataFrame, passage: int = PASSAGE_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """(ord, mark, passages): for each document with something to delete, spans of runs of words."""

    def groups_in(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            for part in parts_of(batch, PART_BYTES):
                texts = Texts.of(part.column("text"))
                starts, _, words = _words_in(texts.raw)
                text = texts.text_at(starts)
                grams, place = grams_of(words, passage, gram)
                at = np.flatnonzero(text[: len(place)] == text[len(text) - len(place) :])  # inside one text
                place = place[at]
                new = np.flatnonzero(np.diff(place, prepend=-1))
                first, last = at[new], at[np.r_[new[1:], len(at)][: len(new)] - 1]
                span = texts.spans(starts, text, first, last + passage)
                keys = keys_of(words, first, last + passage - 1)
                yield [*(k.view(np.int64) for k in (*keys, grams[place[new]])), *_own(part, text[first]), span]

    def windows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in batches:
            for part in parts_of(batch, PART_BYTES):
                texts = Texts.of(part.column("text"))
                starts, _, words = _words_in(texts.raw)
                text = texts.text_at(starts)
                group, row = _listed(part.column("groups"))
                first, stop = (np.searchsorted(starts, x + texts.begin[row]) for x in (group >> 32, group & 0xFFFFFFFF))
                n = stop - first - passage + 1
                first = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                span = texts.spans(starts, text, first, first + passage)
                keys = keys_of(words, first, first + passage - 1)
                yield [*(k.view(np.int64) for k in keys), *_own(part, text[first]), span]

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _handed_on(groups_in(batches), ["k1", "k2", "h", *_KEY, "span"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _handed_on(windows_in(batches), ["k1", "k2", *_KEY, "span"])

    texts = _texts(docs)
    kind = "k1 long, k2 long, h long, ord long, mark long, span long"
    groups = stored(texts.mapInArrow(select, kind), "grams")
    groups = stored(groups.join(_hashed(_twice(groups)), "h"), "groups")
    firsts = stored(_firsts(groups, "h"), "firsts")
    later = _later(groups, firsts)
    # Equal windows select equal words: where all groups around these are equal, theirs are too.
    kinds = firsts.toDF("k1", "k2", *_KEY, "span", "h", "n")
    apart = kinds.join(_hashed(_twice(kinds)), "h").groupBy(*_KEY).agg(F.collect_list("span").alias("groups"))
    split = texts.join(_hashed(stored(apart, "apart")), list(_KEY)).select(*_KEY, "text", "groups")
    windows = split.mapInArrow(extend, "k1 long, k2 long, ord long, mark long, span long")
    windows = _later(stored(windows, "windows"))
    return later.unionByName(windows).groupBy(*_KEY).agg(F.collect_set("span").alias("passages"))


def repeated_runs(docs: DataFrame, min_words: int, line_words: int | None) -> DataFrame:
    """(ord, mark, runs): for each document with something to delete, spans of runs of lines."""
    columns = [*_KEY, "hashes", "words", "starts", "line_keys", "line_spans"]

    def windows(hashes: np.ndarray, words: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
        found = windows_of(hashes, words.astype(np.int64), min_words)
        inside = text[found[0]] == text[found[1]]
        return [x[inside] for x in found]

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, PART_BYTES):
                yield sequences_of(part, Texts.of(part.column("text")))

    def sequences_of(part: pa.RecordBatch, texts: Texts) -> pa.RecordBatch:
        texts.find_lines()
        text = texts.text_at(texts.lines)
        per_text = np.arange(len(texts.size) + 1)
        hashes = np.array(texts.hashed(texts.lines_from, texts.lines_to, xxhash.xxh64_intdigest), np.uint64)
        words = texts.words_between(texts.lines_from, texts.lines_to).astype(np.int32)
        place = np.unique(windows(hashes, words, text)[2])
        starts = (np.r_[texts.lines] - texts.begin[text]).astype(np.int32)
        n = texts.words_between(texts.whole_from, texts.whole_to)
        long = np.flatnonzero(n >= line_words if line_words else np.zeros(len(n), bool))
        keys = texts.hashed(texts.whole_from[long], texts.whole_to[long], xxhash.xxh3_128_digest)
        keys = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        first, stop = (np.searchsorted(texts.lines, edge[long]) for edge in texts.whole)
        spans = texts.spans(texts.lines, text, first, stop)
        per_line, per_whole = (np.bincount(t, minlength=len(texts.size)) for t in (text, text[first]))
        chosen = np.r_[hashes[place].view(np.int64), keys[:, 0]]
        owner = np.r_[text[place], text[first]]
        order = np.argsort(owner, kind="stable")
        arrays = [
            *(part.column(k) for k in _KEY),
            *(_binaries(x, per_line) for x in (hashes, words, starts)),
            *(_binaries(x, per_whole) for x in (keys, spans)),
            pa.array(texts.size),
            _lists(chosen[order], np.bincount(owner, minlength=len(texts.size))),
        ]
        return pa.RecordBatch.from_arrays(arrays, [*columns, "size", "chosen"])

    kind = (
        "ord long, mark long, hashes binary, words binary, starts binary, line_keys binary, line_spans binary, "
        "size long, chosen array<long>"
    )
    runs = stored(_texts(docs).mapInArrow(sequences, kind).filter(F.size("chosen") > 0), "runs")
    chosen = runs.select(*_KEY, F.explode("chosen").alias("h"))
    hits = chosen.join(_hashed(_twice(chosen)), "h").groupBy(*_KEY).agg(F.collect_set("h").alias("hits"))

    def windows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for batch in _slices(batches):
            # What is a hit in one document is one in every document that has it.
            wanted = np.unique(batch.column("hits").flatten().to_numpy(zero_copy_only=False))
            (hashes, counts), (words, _) = _values(batch.column("hashes"), np.uint64), _values(batch.column("words"), np.int32)
            starts = _values(batch.column("starts"), np.int32)[0].astype(np.int64)
            text = np.repeat(np.arange(batch.num_rows), counts)
            first, last, place = windows(hashes, words, text)
            near = np.isin(hashes[place].view(np.int64), wanted)
            first, last = first[near], last[near]
            at = np.cumsum(counts)[text[first]]  # where the next document's lines begin
            end = np.where(last + 1 < at, np.r_[starts, 0][last + 1], batch.column("size").to_numpy()[text[first]])
            line_keys, n = _values(batch.column("line_keys"), np.int64, 2)
            again = np.flatnonzero(np.isin(line_keys[:, 0], wanted))
            spans = _values(batch.column("line_spans"), np.int64)[0][again]
            keys = zip((k.view(np.int64) for k in keys_of(hashes, first, last)), line_keys[again].T)
            row = np.r_[text[first], np.repeat(np.arange(batch.num_rows), n)[again]]
            yield [*(np.r_[a, b] for a, b in keys), *_own(batch, row), np.r_[(starts[first] << 32) | end, spans]]

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _handed_on(windows_in(batches), ["k1", "k2", *_KEY, "span"])

    found = runs.drop("chosen").join(_hashed(stored(hits, "hits")), list(_KEY))
    found = found.select(*columns, "size", "hits").mapInArrow(extend, "k1 long, k2 long, ord long, mark long, span long")
    return _later(stored(found, "windows")).groupBy(*_KEY).agg(F.collect_set("span").alias("runs"))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def dedup_lines(docs: DataFrame, min_words: int | None = None, line_words: int | None = None) -> DataFrame:
    """`docs` with repeated runs deleted from `text`, and `deleted` (start, end) in code points.

    A run has at least `min_words` blank-separated words, a whole line that goes alone at least
    `line_words`; runs of `PASSAGE_WORDS` words go wherever they begin and end.  Bounds not given are `MIN_WORDS` and `LINE_WORDS`; with `min_words` only, no
    line goes alone.  Order is by doc_id (null first), then
    by a hash of the text.  Rows equal in doc_id and text are one document: each gets the same
    result.  Null and empty texts stay as they are, with nothing deleted.  All other columns are
    kept; columns named `deleted`, `ord`, `mark`, `runs` or `passages` are replaced or dropped.  An empty
    table gives an empty result.
    """
    line_words = LINE_WORDS if min_words is None and line_words is None else line_words
    min_words = MIN_WORDS if min_words is None else min_words
    plain = docs.drop("deleted", "runs", "passages", *_KEY)
    with passing_tables(docs.sparkSession):
        passages = stored(repeated_passages(plain), "passages", lasting=True)
    with passing_tables(docs.sparkSession):
        runs = stored(repeated_runs(plain, min_words, line_words), "line_runs")
        found = stored(runs.join(passages, list(_KEY), "full"), "deletions", lasting=True)
    joined = _keyed(plain).join(_hashed(found), list(_KEY), "left").select(*plain.columns, "runs", "passages")
    names = plain.columns
    at = names.index("text")

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, PART_BYTES):
                spans, rows = (np.concatenate(x) for x in zip(*map(_listed, part.columns[len(names) :])))
                columns, old = part.columns[: len(names)], part.column(at)
                gone = pa.array([[]] * part.num_rows, _SPANS)
                if len(spans):
                    texts, gone = _without(Texts.of(old), rows, spans.astype(np.int64))
                    columns[at] = pc.if_else(old.is_valid(), texts.cast(old.type), pa.scalar(None, old.type))
                yield pa.RecordBatch.from_arrays([*columns, gone.cast(_SPANS)], [*names, "deleted"])

    span = T.StructType().add("start", T.LongType()).add("end", T.LongType())
    return joined.mapInArrow(delete, T.StructType([*plain.schema, T.StructField("deleted", T.ArrayType(span))]))


def digest(docs: DataFrame, min_words: int | None = None, line_words: int | None = None) -> DataFrame:
    """(doc_id, deleted, n_deleted_chars, kept_sha256): deletions as start:end, joined by commas."""
    done = dedup_lines(docs.select("doc_id", text_of()), min_words, line_words)
    shown = F.transform("deleted", lambda d: F.concat_ws(":", d.start.cast("string"), d.end.cast("string")))
    chars = F.aggregate("deleted", F.lit(0).cast("long"), lambda n, d: n + d.end - d.start)
    return done.select(
        "doc_id",
        F.array_join(shown, ",").alias("deleted"),
        chars.alias("n_deleted_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )

"""Benchmark items inside documents, also with other numbers, names and units.

Texts become templates: words are lowered and stripped of punctuation, and numbers, units and
names (capitalised inside a sentence) are replaced by a placeholder of their kind.  Windows of
`window` template words are hashed.  A document holds an item when at least `share` of the item's
windows stand in it, aligned, with consistent slots: within one alignment the same value of the
item always meets the same value of the document, and different ones different ones.  So a
re-parameterised question is caught, and a chance likeness of form is not.

An item that has `share` of its n windows in a document has one of its n - ceil(share n) + 1
rarest there.  Only these are joined by hash, so windows that many items and documents have form
no pairs.  Document windows pass a Bloom filter of fixed size first; what it lets through by
chance is dropped by the join, so a large benchmark makes it slower and never wrong.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfkin.llm.common import map_batches, passing_tables, stored, text_of

WINDOW = 5
SHARE = 0.8
LEAST_LITERALS = 2  # words of a window that are no placeholder
FILTER_BITS = 1 << 24
PROBES = 4
FIRST_ID = -(1 << 63)

# Words for numbers and units.
NUMBERS = frozenset(
    """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
    seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million
    billion""".split()
)
UNITS = frozenset(
    """mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces
    pound pounds lb lbs ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour
    hours day days week weeks month months year years cent cents dollar dollars euro euros meter meters metre
    metres kilometer kilometers kilometre kilometres percent degree degrees mph kmh kph celsius fahrenheit""".split()
)
NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:%|st|nd|rd|th)?")
MEASURE = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*([^\W\d_]+)")
EDGES = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")

# A word's code has its kind in the last four bits.
NAME, SLOT, ENDS, SKIP = 1, 2, 4, 8  # may be a name; is a placeholder; ends a sentence; no word
CODE = np.uint64(0xFFFFFFFFFFFFFFF0)
PRIME = np.uint64(0x9E3779B97F4A7C15)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text, 42) & 0xFFFFFFFFFFFFFFF0


NUMBER_CODE, UNIT_CODE, MEASURE_CODE, NAME_CODE = map(_hash, ("<number>", "<unit>", "<measure>", "<name>"))


def value_of(word: str) -> str:
    """A word as compared in slots: without punctuation around it, lowered."""
    return EDGES.sub("", word).lower()


class Codes(dict):
    """Code of each word as it stands in a text, computed when first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        core = EDGES.sub("", word)
        low = core.lower()
        ends = ENDS if word.rstrip("\"')]}»”’*!").endswith((".", "?")) or "!" in word else 0
        if not any(c.isalnum() for c in core):
            code = SKIP
        elif low in NUMBERS or NUMBER.fullmatch(low):
            code = NUMBER_CODE | SLOT
        elif low in UNITS:
            code = UNIT_CODE | SLOT
        elif (m := MEASURE.fullmatch(low)) and m[1] in UNITS:
            code = MEASURE_CODE | SLOT
        else:
            code = _hash(low) | (NAME if core[0].isupper() and core[1:].islower() else 0)
        self[word] = code | ends
        return code | ends


class Template:
    """A text as a sequence of template words."""

    def __init__(self, text: str, codes: Codes, window: int) -> None:
        self.words = text.split()
        raw = np.fromiter(map(codes.__getitem__, self.words), np.uint64, len(self.words))
        kept = (raw & np.uint64(SKIP)) == 0
        self.places = None if kept.all() else np.flatnonzero(kept)  # of template words among the words
        raw = raw[kept]
        inside = np.r_[False, (raw[:-1] & np.uint64(ENDS)) == 0] if len(raw) else np.zeros(0, bool)
        name = ((raw & np.uint64(NAME)) > 0) & inside
        code = np.where(name, np.uint64(NAME_CODE), raw & CODE)
        self.slot = name | ((raw & np.uint64(SLOT)) > 0)
        n = max(0, len(raw) - window + 1)
        hashes = np.zeros(n, np.uint64)
        for i in range(window):
            hashes = hashes * PRIME + code[i : i + n]
        hashes ^= hashes >> np.uint64(31)
        self.hashes = hashes * np.uint64(0xBF58476D1CE4E5B9)
        literals = np.r_[0, np.cumsum(~self.slot)]
        self.usable = literals[window : window + n] - literals[:n] >= min(LEAST_LITERALS, window)

    def word(self, i: int) -> str:
        return self.words[i if self.places is None else int(self.places[i])]


class Bloom:
    """A set of hashes in a number of bits; may also hold what was not put in."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.size = bits, np.uint64(8 * len(bits))

    def _at(self, hashes: np.ndarray, probe: int) -> np.ndarray:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return ((hashes + step * np.uint64(probe)) % self.size).astype(np.int64)

    def add(self, hashes: np.ndarray) -> None:
        for probe in range(PROBES):
            at = self._at(hashes, probe)
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Where `hashes` may be in the set."""
        left = np.arange(len(hashes))
        for probe in range(PROBES):
            at = self._at(hashes[left], probe)
            left = left[(self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0]
            if not len(left):
                break
        return left


def match(doc: Template, item: Template, window: int) -> tuple[float, int, int]:
    """Share of the item's windows that stand in the document with consistent slots, and the first
    and last template word of the document in them."""
    wanted = np.unique(item.hashes[item.usable])
    if not len(wanted):
        return 0.0, -1, -1
    at = np.flatnonzero(doc.usable & np.isin(doc.hashes, wanted))
    places: dict[int, list[int]] = {}
    for i in np.flatnonzero(item.usable).tolist():
        places.setdefault(int(item.hashes[i]), []).append(i)
    aligned: dict[int, list[int]] = {}
    for j in at.tolist():
        for i in places[int(doc.hashes[j])]:
            aligned.setdefault(j - i, []).append(j)
    seen: set[int] = set()
    first, last = len(doc.slot), -1
    for shift, starts in aligned.items():
        spots = sorted({k for j in starts for k in range(j, j + window) if doc.slot[k]})
        pairs = {(value_of(item.word(k - shift)), value_of(doc.word(k))) for k in spots}
        if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
            seen.update(int(doc.hashes[j]) for j in starts)
            first, last = min(first, starts[0]), max(last, starts[-1] + window - 1)
    return len(seen) / len(wanted), first, last


_KEY = ("ord", "mark")


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with what identifies a document: doc_id (null: the least number) and a text hash."""
    return docs.withColumns(
        {
            "ord": F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST_ID)),
            "mark": F.xxhash64(F.coalesce("text", F.lit(""))),
        }
    )


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, text): one row per text, with its smallest id."""
    texts = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of())
    return stored(texts.groupBy("text").agg(F.min("item_id").alias("item_id")), "items")


def _rarest(items: DataFrame, window: int, share: float) -> DataFrame:
    """(h, text): the windows of each item one of which every document that holds it must have."""

    def windows(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes = Codes()
        found = [Template(t, codes, window) for t in batch.column("text").to_pylist()]
        hashes = [np.unique(t.hashes[t.usable]).view(np.int64) for t in found]
        return pa.RecordBatch.from_arrays([batch.column("text"), pa.array(hashes, pa.list_(pa.int64()))], ["text", "hs"])

    each = map_batches(items.select("text"), windows, "text string, hs array<long>")
    each = stored(each.select(F.xxhash64("text").alias("item"), F.explode("hs").alias("h")), "item_windows")
    known = each.groupBy("h").agg(F.count(F.lit(1)).alias("items"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("items", "h"))
    total = F.count(F.lit(1)).over(Window.partitionBy("item"))
    ranked = each.join(known, "h").withColumns({"rank": rank, "n": total})
    needed = F.col("n") - F.ceil(F.lit(share) * F.col("n") - 1e-9) + 1
    return stored(ranked.filter(F.col("rank") <= needed).select("h", "item"), "rarest")


def _filter(rarest: DataFrame, size: int) -> Bloom:
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = Bloom(np.zeros(size >> 3, np.uint8))
        for batch in batches:
            bloom.add(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([bloom.bits.tobytes()], pa.binary())], ["bits"])

    rows = rarest.select("h").coalesce(4).mapInArrow(fill, "bits binary").collect()  # 4 of `size` bits
    bits = np.zeros(size >> 3, np.uint8)
    for row in rows:
        bits |= np.frombuffer(row.bits, np.uint8)
    return Bloom(bits)


def _contaminated(docs: DataFrame, benchmark: DataFrame, window: int, share: float) -> DataFrame:
    items = _items(benchmark)
    rarest = _rarest(items, window, share)
    bloom = _filter(rarest, FILTER_BITS)

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            at, hits = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                doc = Template(text, codes, window)
                near = bloom.places(doc.hashes)
                near = near[doc.usable[near]]
                if len(near):
                    at.append(i)
                    hits.append(np.unique(doc.hashes[near]).view(np.int64))
            if at:
                columns = [c.take(pa.array(at)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(hits, pa.list_(pa.int64()))], [*_KEY, "text", "hits"])

    texts = keyed(docs.select("doc_id", text_of())).select(*_KEY, "text")
    near = stored(texts.mapInArrow(suspects, "ord long, mark long, text string, hits array<long>"), "suspects")
    hits = near.select(*_KEY, F.explode("hits").alias("h"))
    pairs = stored(hits.join(rarest, "h").select(*_KEY, "item").distinct(), "pairs")
    named = items.select(F.xxhash64("text").alias("item"), "item_id", F.col("text").alias("item_text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        known: tuple[str, Template] | None = None
        for batch in batches:
            rows = []
            columns = (batch.column(n).to_pylist() for n in (*_KEY, "text", "item_id", "item_text"))
            for o, m, text, item_id, item_text in zip(*columns):
                if known is None or known[0] != text:
                    known = text, Template(text, codes, window)
                found, first, last = match(known[1], Template(item_text, codes, window), window)
                if found >= share - 1e-9:
                    rows.append((o, m, item_id, found, *_span(text, known[1], first, last)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                names = [*_KEY, "item_id", "share", "start", "end"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    unique = near.select(*_KEY, "text").dropDuplicates(list(_KEY))
    to_check = pairs.join(named, "item").join(unique, list(_KEY))
    return stored(
        to_check.select(*_KEY, "text", "item_id", "item_text").mapInArrow(
            verify, "ord long, mark long, item_id long, share double, start long, end long"
        ),
        "contaminated",
        lasting=True,
    )


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(ord, mark, item_id, share, start, end): each item in each document that holds it.

    `start` and `end` are the code points the match spans.  Items with fewer than `window` words,
    or without a window of at least two words that are no placeholder, match nothing.  Null texts
    count as empty and hold nothing.  Benchmark items of equal text are one, under the smallest id.
    """
    with passing_tables(docs.sparkSession):
        return _contaminated(docs, benchmark, window, share)


def _span(text: str, doc: Template, first: int, last: int) -> tuple[int, int]:
    """Code points from template word `first` to `last`."""
    ends = [i if doc.places is None else int(doc.places[i]) for i in (first, last)]
    start = end = 0
    for i, m in enumerate(re.finditer(r"\S+", text)):
        if i == ends[0]:
            start = m.start()
        if i == ends[1]:
            end = m.end()
            break
    return start, end


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """`docs` without the rows that hold a benchmark item; all columns are kept.

    Rows that repeat a doc_id are judged each by their own text; rows without doc_id too.  An
    empty benchmark removes nothing; an empty table gives an empty result.  Columns named `ord` or
    `mark` are dropped.
    """
    plain = docs.drop(*_KEY)
    bad = contaminated(plain, benchmark, window, share).select(*_KEY).distinct()
    return keyed(plain).join(bad, list(_KEY), "left_anti").select(*plain.columns)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE) -> DataFrame:
    """(doc_id, contaminated, n_items, items) for every row of `docs`.

    `items` lists item_id:start:end of each item the document holds, by item_id, comma-joined.
    """
    found = contaminated(docs, benchmark, window, share)
    shown = F.struct("item_id", F.concat_ws(":", "item_id", "start", "end").alias("shown"))
    per_doc = stored(
        found.groupBy(*_KEY).agg(F.sort_array(F.collect_list(shown)).alias("items")), "per_doc", lasting=True
    )  # an item at most once per document: bounded by the benchmark
    listed = F.array_join(F.transform("items", lambda i: i.shown), ",")
    plain = keyed(docs.select("doc_id", "text")).select("doc_id", *_KEY)
    return plain.join(per_doc, list(_KEY), "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(listed, F.lit("")).alias("items"),
    )

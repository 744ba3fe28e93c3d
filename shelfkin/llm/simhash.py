"""Near-duplicates by SimHash, found with a vantage-point tree over Hamming distance.

A fingerprint is 64 bits.  The tree has one vantage point per level, and each level measures
the Hamming distance to its vantage point over its own 64 / levels bits; the children of a node
are the distance shells.  By the triangle bound two fingerprints that differ in r bits lie at
most r shells apart, and as the levels look at disjoint bits, at most r apart summed over all
levels.  So a fingerprint is put into every leaf whose shells are at most ceil(r / 2) away from
its own, summed over the levels: all other branches are pruned, and any two fingerprints within
r bits of each other meet in a leaf, because the leaf half way between them is that near to
both.  With 8 levels and r = 2 these are 17 leaves for each distinct fingerprint, whatever their
number.  The leaves are shards: one shuffle brings the fingerprints of a leaf together, where
the distances are computed exactly.  A crowded leaf is searched by a deeper tree (twice the
levels, down to one bit each) instead of pair by pair.

Equal fingerprints are collapsed first, so copies cost nothing here.  A task hands on only
links that join what it has not joined yet: a group of n near copies leaves O(n) links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfkin.llm.common import components, map_batches, passing_tables, stored, text_of

SEED = 42
LEVELS = 8
CROWDED = 2048  # a leaf with more fingerprints is searched by a deeper tree
CHUNK = 1 << 18  # shingles hashed at a time


def fingerprint(text: str, shingle: int = 3) -> int:
    """64-bit SimHash of a whole text over word shingles, repeats included.

    A-Z are lowered; words are parted by the six ASCII white-space characters.  A text of fewer
    words than `shingle` is one shingle; a text without words has fingerprint zero.
    """
    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII space parts
    if not words:
        return 0
    width = min(shingle, len(words))
    total = len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for start in range(0, total, CHUNK):
        stop = min(start + CHUNK, total)
        columns = [words[start + i : stop + i] for i in range(width)]
        hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*columns)), repeat(SEED))
        packed = np.fromiter(hashes, np.uint64, stop - start).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(packed, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fingerprint as a signed long) for every row of `docs`; a null text counts as empty."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        marks = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
        values = np.array(marks, np.uint64).view(np.int64)
        arrays = [batch.column("doc_id"), batch.column("text_hash"), pa.array(values)]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "fp"])

    text = text_of()
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text)
    return map_batches(narrow, rows, "doc_id long, text_hash long, fp long")


def _vantage(levels: int) -> int:
    return xxhash.xxh64_intdigest(f"vantage {levels}", SEED)


def _steps(levels: int, radius: int) -> list[tuple[int, ...]]:
    """All moves of shell numbers over the levels that cost at most `radius` in sum."""
    moves: list[tuple[int, ...]] = [()]
    for _ in range(levels):
        moves = [
            (*m, d)
            for m in moves
            for d in range(-radius, radius + 1)
            if sum(map(abs, m)) + abs(d) <= radius
        ]
    return moves


def leaves(values: np.ndarray, levels: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, position in `values`) for every leaf that lies within `radius` shells of a value."""
    bits = 64 // levels
    width = bits.bit_length()  # of a shell number, 0 to bits
    apart = values ^ np.uint64(_vantage(levels))
    shells = [
        np.bitwise_count((apart >> np.uint64(bits * j)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        for j in range(levels)
    ]
    base = np.zeros(len(values), np.uint64)
    for j, shell in enumerate(shells):
        base |= shell.astype(np.uint64) << np.uint64(width * j)
    out, at = [], []
    for move in _steps(levels, radius):
        fits = np.ones(len(values), bool)
        leaf = base.copy()
        for j, d in enumerate(move):
            if d:
                fits &= (shells[j] + d >= 0) & (shells[j] + d <= bits)
                leaf += np.uint64((d << (width * j)) % (1 << 64))
        where = np.flatnonzero(fits)
        out.append(leaf[where])
        at.append(where)
    return np.concatenate(out), np.concatenate(at)


class Forest:
    """Union-find over the fingerprints seen so far; keeps links that join two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def joins(self, a: int, b: int) -> bool:
        ra, rb = self.root(a), self.root(b)
        if ra == rb:
            return False
        self.parent[max(ra, rb)] = min(ra, rb)
        return True


def _search(leaf: np.ndarray, value: np.ndarray, reach: int, levels: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (as arrays of both ends) that connect all values within `reach` bits in each leaf.

    `leaf` is sorted.  Small leaves are compared at once, by distance in the array; in larger
    ones each value is compared with those not reached yet; crowded ones go one tree deeper.
    """
    starts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
    sizes = np.diff(np.r_[starts, len(leaf)])
    small = np.repeat(sizes <= 16, sizes)
    here = np.flatnonzero(small)
    for gap in range(1, 16):
        here = here[here + gap < len(leaf)]
        here = here[leaf[here] == leaf[here + gap]]
        if not len(here):
            break
        near = here[np.bitwise_count(value[here] ^ value[here + gap]) <= reach]
        if len(near):
            yield value[near], value[near + gap]
    for start, size in zip(starts[sizes > 16].tolist(), sizes[sizes > 16].tolist()):
        members = value[start : start + size]
        if size > CROWDED and levels < 64:
            deeper, at = leaves(members, levels * 2, (reach + 1) // 2)
            order = np.argsort(deeper, kind="stable")
            yield from _search(deeper[order], members[at[order]], reach, levels * 2)
            continue
        left = members
        queue: list[np.ndarray] = []
        while len(left):
            if not queue:
                queue, left = [left[:1]], left[1:]
            one = queue.pop()
            for x in one:
                near = np.bitwise_count(left ^ x) <= reach
                if near.any():
                    found = left[near]
                    left = left[~near]
                    queue.append(found)
                    yield np.full(len(found), x, np.uint64), found


def links(values: DataFrame, reach: int = 2, levels: int = LEVELS) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` that connect all within `reach` bits."""

    def scatter(batch: pa.RecordBatch) -> pa.RecordBatch:
        value = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        leaf, at = leaves(value, levels, (reach + 1) // 2)
        arrays = [pa.array(leaf.view(np.int64)), pa.array(value[at].view(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, ["leaf", "fp"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        leaf, value = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

        def found(leaf: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b in _search(leaf, value, reach, levels):
                kept = [(x, y) for x, y in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist()) if forest.joins(x, y)]
                if kept:
                    ends = [pa.array(e, pa.int64()) for e in zip(*kept)]
                    yield pa.RecordBatch.from_arrays(ends, ["a", "b"])

        for batch in batches:  # sorted by leaf; the last leaf may go on in the next batch
            if not batch.num_rows:
                continue
            leaf = np.r_[leaf, batch.column("leaf").to_numpy(zero_copy_only=False).view(np.uint64)]
            value = np.r_[value, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)]
            whole = np.flatnonzero(leaf != leaf[-1])
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield from found(leaf[:cut], value[:cut])
                leaf, value = leaf[cut:], value[cut:]
        if len(leaf):
            yield from found(leaf, value)

    spread = map_batches(values.select("fp"), scatter, "leaf long, fp long")
    return spread.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(gather, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, reach: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id, text_hash, root.

    Fingerprints that differ in at most `reach` bits are linked; `component_id` is the smallest
    doc_id that links lead to.  Null texts count as empty; all texts without words share
    fingerprint zero and so one component.  Rows that repeat a doc_id each get a row.  A null
    doc_id is kept and never names a component (null only if no other id is in it).  `root`, the
    smallest fingerprint of the component as a long, tells components apart in any case, and
    `text_hash` the rows that share a doc_id.  Other columns of `docs` are not read.  An empty
    table gives an empty result.
    """
    marks = stored(fingerprints(docs, shingle), "fingerprints", lasting=True)
    with passing_tables(docs.sparkSession):
        distinct = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
        linked = stored(components(links(distinct, reach)), "linked")
        named = distinct.join(linked, F.col("fp") == F.col("node"))
        lowest = stored(named.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
        joined = stored(linked.join(lowest, "root").select("node", "component_id", "root"), "joined")
        labels = stored(
            distinct.join(joined, F.col("fp") == F.col("node"), "left").select(
                "fp", F.coalesce("component_id", "low").alias("component_id"), F.coalesce("root", "fp").alias("root")
            ),
            "labels",
            lasting=True,
        )
    return marks.join(labels, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "root"
    )


def one_of_each_group(docs: DataFrame, shingle: int = 3, reach: int = 2) -> DataFrame:
    """The row with the smallest doc_id of each component, rows without doc_id last.

    Rows that share a doc_id are told apart by their text: of different texts under one id each
    stays or goes with its own component, and of equal rows one stays.  What is chosen is chosen
    by aggregates, so no group, and not that of the rows without doc_id, is held by one task.
    """
    groups = near_duplicates(docs, shingle, reach)
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    with passing_tables(docs.sparkSession):
        first = stored(groups.groupBy("root").agg(F.min(row).alias("first")), "first")
        least = first.select("root", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))
        chosen = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
        spare = stored(
            groups.join(least, "root").filter(~chosen).select(F.col("doc_id").alias("spare_id"), "text_hash").distinct(),
            "spare",
            lasting=True,
        )
    made = docs.withColumn("row_hash", F.xxhash64(text_of()))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("spare_id")) & (F.col("row_hash") == F.col("spare_hash"))
    kept = made.join(spare.withColumnRenamed("text_hash", "spare_hash"), same, "left_anti")
    return kept.dropDuplicates(["doc_id", "row_hash"]).select(docs.columns)

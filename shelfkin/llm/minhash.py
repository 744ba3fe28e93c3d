"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its distinct word shingles, held as sorted 64-bit hashes.  The whole
signature comes from two permutations of a universe of 2^20 places: the first, sigma, scatters
the shingles over the universe; the second, pi, is read from there on, once for each circular
shift.  Coordinate k of a signature is the least pi[(sigma[x] + k) mod 2^20] over the set, so
the values one shingle gives to all coordinates are one contiguous piece of pi.

Equal sets are collapsed to one representative before anything is compared, so exact copies
cost one row each.  Signatures are cut into bands; equal bands are a bucket.  With 48 bands of 6
coordinates a pair at similarity 0.8 shares no bucket with probability 5e-7.  Links are
confirmed on full sets only, and no bucket is ever written out as all its pairs:

* every member of a bucket is checked against the smallest one, which settles groups of copies
  in as many checks as they have members;
* components that still share a bucket are compared by signature, in tiles of bounded size, and
  put in one group where some members agree in at least 68% of all coordinates (a pair at
  similarity 0.8 falls below that with probability 3e-7);
* the members of a group meet on full sets, again in tiles of bounded size, each pair of different
  components once.  A task hands on only links that join what it has not joined yet.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfkin.llm.common import components, map_batches, parts_of, passing_tables, stored, text_of

SEED = 42
UNIVERSE = 1 << 20  # places that the two permutations permute
BANDS, ROWS = 48, 6
AGREE = 0.68  # share of coordinates that must agree before full sets are compared
TILE_MEMBERS = 512  # members of a bucket or group in one block of a tile
TILE_SHINGLES = 1 << 22  # shingles of one block, about
CHUNK = 1 << 10  # shingles whose pieces of pi are held at a time
FOLD = np.uint64(0x9E3779B97F4A7C15)  # an odd number, 2^64 over the golden ratio
PART_BYTES = 4 << 20  # text handled at a time
FILTER_BITS = 1 << 25  # of the filter for texts whose sets are wanted: 4 MB


@lru_cache(maxsize=1)
def _permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """sigma, and a view of pi whose row s holds pi[s], pi[s + 1], ... for every coordinate."""
    draw = np.random.default_rng(SEED)
    sigma = draw.permutation(UNIVERSE).astype(np.int32)
    pi = draw.permutation(UNIVERSE).astype(np.uint32)
    around = np.concatenate([pi, pi[: coordinates - 1]])
    return sigma, np.lib.stride_tricks.sliding_window_view(around, coordinates)


def shingle_set(text: bytes, width: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text in UTF-8.

    A-Z are lowered; words are parted by the six ASCII white-space characters.  A text of fewer
    words than `width` is one shingle; one without words gives the empty set.
    """
    words = text.lower().split()  # bytes: only A-Z are lowered, only ASCII space parts
    if not words:
        return np.zeros(0, np.uint64)
    width = min(width, len(words))
    each = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    total = len(words) - width + 1
    shingles = each[:total].copy()
    for i in range(1, width):  # the hash of a shingle folds those of its words, in order
        shingles *= FOLD
        shingles += each[i : total + i]
        shingles ^= shingles >> np.uint64(29)
    return np.unique(shingles)


def signature(hashes: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The least value of every shifted permutation over a set that is not empty."""
    sigma, pieces = _permutations(coordinates)
    place = np.unique(sigma[(hashes & np.uint64(UNIVERSE - 1)).astype(np.int64)])
    least = np.full(coordinates, UNIVERSE, np.uint32)
    for start in range(0, len(place), CHUNK):
        np.minimum(least, pieces[place[start : start + CHUNK]].min(axis=0), out=least)
    return least


def _bucket_keys(least: np.ndarray, bands: int) -> list[int]:
    """One signed 64-bit key for each band of a signature."""
    rows = least.reshape(bands, -1)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), SEED + band) for band, row in enumerate(rows)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


MARKS = "doc_id long, text_key long, text_key2 long, high long, low long, n_shingles long, bands array<long>, brief binary"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, the text (null as empty) and 128 bits that tell texts apart."""
    text = text_of()
    keys = [F.xxhash64(F.lit(salt), text).alias(name) for salt, name in ((1, "text_key"), (2, "text_key2"))]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keys, text)


def _binary(column: pa.Array) -> Iterator[bytes]:
    return (value.as_py() for value in column.cast(pa.binary()))


def marks(docs: DataFrame, width: int = 2, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The digest of every document's set (128 bits), its bucket keys and a brief signature.

    `brief` keeps eight bits of each coordinate.  An empty set has no bands.
    """

    def one(text: bytes) -> tuple:
        members = shingle_set(text, width)
        digest = xxhash.xxh3_128_digest(members.tobytes(), SEED)
        high, low = np.frombuffer(digest, np.int64).tolist()
        if not len(members):
            return high, low, 0, [], b""
        least = signature(members, bands * rows)
        return high, low, len(members), _bucket_keys(least, bands), least.astype(np.uint8).tobytes()

    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    names = [c.split()[0] for c in MARKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, PART_BYTES) if batch.num_rows else ():
                made = zip(*map(one, _binary(part.column("text"))))
                arrays = [pa.array(values, kind) for values, kind in zip(made, types)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *arrays], names)

    return _keyed(docs).mapInArrow(run, MARKS)


def _bitmap(keys: DataFrame) -> bytes:
    """FILTER_BITS bits, those of the keys set: at most FILTER_BITS / 2^15 rows of 4 KB."""
    bit = F.pmod("text_key", F.lit(FILTER_BITS))
    rows = (
        keys.select(bit.alias("bit"))
        .groupBy(F.floor(F.col("bit") / (1 << 15)).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(1 << 15))).alias("bits"))
        .collect()
    )
    whole = bytearray(FILTER_BITS // 8)
    for row in rows:
        whole[row.bucket * 4096 : (row.bucket + 1) * 4096] = row.bits
    return bytes(whole)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int = 2) -> DataFrame:
    """(node, members): the full sets of the wanted texts, `wanted` being (node, text_key, text_key2).

    The sets are made from the texts again, as they would take more room than these.  A filter of
    fixed size keeps most other texts from being parsed and shuffled; what it lets through goes
    in the join.  Copies of a text are parsed once by a task.
    """
    spark = docs.sparkSession
    bitmap = spark.sparkContext.broadcast(_bitmap(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.frombuffer(bitmap.value, np.uint8), set()
        for batch in batches:
            if not batch.num_rows:
                continue
            bit = batch.column("text_key").to_numpy() & (FILTER_BITS - 1)
            passes = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            batch = batch.filter(pa.array(passes))
            for part in parts_of(batch, PART_BYTES):
                fresh = []
                for key in zip(part.column("text_key").to_pylist(), part.column("text_key2").to_pylist()):
                    fresh.append(key not in seen)
                    seen.add(key)
                part = part.filter(pa.array(fresh, pa.bool_()))
                members = [shingle_set(t, width).tobytes() for t in _binary(part.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(members, pa.binary())], ["text_key", "text_key2", "members"]
                )

    made = _keyed(docs).drop("doc_id").mapInArrow(run, "text_key long, text_key2 long, members binary")
    found = made.join(wanted, ["text_key", "text_key2"]).select("node", "members")
    return found.dropDuplicates(["node"])


def _long_enough(a: str, b: str, percent: int):
    """The size filter: sets this different in size cannot reach the similarity."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; `sets` is (node, members)."""

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for left, right in zip(batch.column("left_set"), batch.column("right_set")):
            x, y = (np.frombuffer(side.as_buffer(), np.uint64) for side in (left, right))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        kept = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        return pa.RecordBatch.from_arrays(kept.columns, ["a", "b"])

    left = sets.select(F.col("node").alias("a"), F.col("members").alias("left_set"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("right_set"))
    return map_batches(pairs.join(left, "a").join(right, "b"), check, "a long, b long")


def shared_buckets(members: DataFrame) -> DataFrame:
    """(bucket, node, n_shingles, first, held) of the buckets with several members."""
    first = members.groupBy("bucket").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("held"))
    return members.join(stored(first.filter("held > 1"), "first"), "bucket")


def first_links(shared: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of every member of a bucket with the bucket's smallest node."""
    met = shared.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"), "n_shingles").distinct()
    sizes = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"))
    return met.join(sizes, "a").filter(_long_enough("n_shingles", "n_a", percent)).select("a", "b")


def _tiled(members: DataFrame, key: str, blocks: Column) -> DataFrame:
    """Members of a key in `blocks` blocks; every pair of blocks of a key is a tile."""
    low, high = F.least("block", "other"), F.greatest("block", "other")
    tiled = (
        members.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .withColumn("tile", F.shiftright(high * (high + 1), 1) + low)
        .withColumn("side", (F.col("block") > F.col("other")).cast("int"))
        .withColumnRenamed(key, "of")
    )
    kept = [c for c in members.columns if c != key]
    return tiled.select("of", "tile", "side", *kept).repartition("of", "tile").sortWithinPartitions("of", "tile")


def _each_tile(tiles: DataFrame, links: Callable[[pa.Table], list[tuple[int, int]]]) -> DataFrame:
    """(a, b): the links found in each tile, one tile at a time."""

    def found(waiting: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = links(pa.Table.from_batches(waiting).combine_chunks()) if waiting else ()
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in zip(*pairs)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # the last tile may go on in the next batch
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            of, tile = (batch.column(c).to_numpy() for c in ("of", "tile"))
            cuts = np.flatnonzero((np.diff(of) != 0) | (np.diff(tile) != 0)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for start, stop in zip(edges, edges[1:]):
                if (of[start], tile[start]) != last:
                    yield from found(waiting)
                    waiting = []
                waiting.append(batch.slice(start, stop - start))
                last = of[start], tile[start]
        yield from found(waiting)

    return tiles.mapInArrow(run, "a long, b long")


def _joins(
    root: np.ndarray, side: np.ndarray, compare: Callable[[int, np.ndarray], np.ndarray]
) -> Iterator[tuple[int, int]]:
    """Pairs of rows that join components: `compare(i, others)` tells which others row i is linked to.

    Rows of side 0 meet those of side 1, or each other where there is no side 1; rows that are
    in one component by now are not compared.
    """
    _, now = np.unique(root, return_inverse=True)
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    for at, i in enumerate(left.tolist()):
        others = right if len(right) else left[at + 1 :]
        others = others[now[others] != now[i]]
        if not len(others):
            continue
        for j in others[compare(i, others)].tolist():
            if now[j] != now[i]:
                now[now == now[j]] = now[i]
                yield i, j


def signature_links(members: DataFrame, percent: int, coordinates: int) -> DataFrame:
    """Links (a, b) between components that share a bucket and have members with like signatures.

    `members` is (bucket, held, node, root, n_shingles, brief) of buckets with several components.
    """
    least = math.floor(AGREE * coordinates)

    def links(table: pa.Table) -> list[tuple[int, int]]:
        root, size, side = (table[c].to_numpy() for c in ("root", "n_shingles", "side"))
        brief = np.frombuffer(b"".join(table["brief"].to_pylist()), np.uint8).reshape(len(root), -1)

        def like(i: int, others: np.ndarray) -> np.ndarray:
            near = 100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])
            near[near] = (brief[others[near]] == brief[i]).sum(axis=1) >= least
            return near

        return [(root[i], root[j]) for i, j in _joins(root, side, like)]

    return _each_tile(_tiled(members, "bucket", F.ceil(F.col("held") / TILE_MEMBERS)), links).distinct()


def set_links(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect the members of a group whose full sets reach the similarity.

    `members` is (group, held, shingles, node, root, members) with the group's members and shingles.
    """

    def links(table: pa.Table) -> list[tuple[int, int]]:
        node, root, side = (table[c].to_numpy() for c in ("node", "root", "side"))
        column = table["members"].combine_chunks()
        sets = [np.frombuffer(value.as_buffer(), np.uint64) for value in column]
        size = np.array([len(s) for s in sets])
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        own = np.zeros(int(code.max()) + 1, bool)

        def similar(i: int, others: np.ndarray) -> np.ndarray:
            near = 100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i])
            some = others[near]
            if len(some):
                mine = code[ends[i] - size[i] : ends[i]]
                own[mine] = True
                theirs = np.concatenate([code[ends[j] - size[j] : ends[j]] for j in some])
                first = np.cumsum(size[some]) - size[some]
                both = np.add.reduceat(own[theirs], first, dtype=np.int64)
                own[mine] = False
                near[near] = 100 * both >= percent * (size[some] + size[i] - both)
            return near

        return [(node[i], node[j]) for i, j in _joins(root, side, similar)]

    blocks = F.greatest(F.ceil(F.col("held") / TILE_MEMBERS), F.ceil(F.col("shingles") / TILE_SHINGLES))
    tiled = _tiled(members, "group", F.least(blocks, F.col("held")))
    return _each_tile(tiled, links)


def near_duplicates(
    docs: DataFrame, width: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * intersection >= `percent` * union of their sets of distinct
    shingles of `width` words.  `component_id` is the smallest doc_id that links lead to, itself
    included, and `kept` marks the document that has it.  Null and empty texts and texts without
    words have the empty set, are linked with nothing and stay.  Rows that repeat a doc_id each get
    a row; equal texts among them are linked like any other.  A null doc_id never names a
    component; where no other id is in it, component_id is null and the row is kept.  Other columns
    of `docs` are not read.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    made = marks(docs, width, bands, rows).withColumn("row", F.monotonically_increasing_id())
    table = stored(made, "marks", lasting=True)
    full = table.filter("n_shingles > 0")

    def sets_for(wanted: DataFrame) -> DataFrame:
        keys = nodes.select("node", "text_key", "text_key2").join(wanted.select("node").distinct(), "node", "left_semi")
        return stored(sets_of(docs, stored(keys, "wanted"), width), "sets")

    with passing_tables(spark):
        # One node for each different set: the number of the first row that has it.
        named = full.groupBy("high", "low").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"))
        first = full.select(F.col("row").alias("node"), "n_shingles", "text_key", "text_key2", "bands", "brief")
        nodes = stored(named.join(first, "node"), "nodes")
        members = stored(nodes.select("node", "n_shingles", F.explode("bands").alias("bucket")), "members")
        shared = stored(shared_buckets(members), "shared")
        pairs = stored(first_links(shared, nodes, percent), "pairs")
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
        stars = stored(confirmed(pairs, sets_for(ends), percent), "stars")
        roots = stored(components(stars), "roots")
        settled = shared.drop("first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        several = settled.groupBy("bucket").agg(F.min("root").alias("low_root"), F.max("root").alias("high_root"))
        several = stored(several.filter("low_root <> high_root").select("bucket"), "several")
        unsettled = stored(settled.join(several, "bucket"), "unsettled")
        briefs = unsettled.join(nodes.select("node", "brief"), "node")
        like = stored(signature_links(briefs, percent, bands * rows), "like")
        linked = roots
        if not like.isEmpty():
            groups = stored(components(like), "groups").select(F.col("node").alias("root"), F.col("root").alias("group"))
            met = stored(unsettled.select("node", "root", "n_shingles").distinct().join(groups, "root"), "met")
            sizes = met.groupBy("group").agg(F.count(F.lit(1)).alias("held"), F.sum("n_shingles").alias("shingles"))
            full_sets = met.drop("n_shingles").join(stored(sizes, "sizes"), "group").join(sets_for(met), "node")
            more = stored(set_links(full_sets, percent), "more")
            linked = stored(components(stars.unionByName(more)), "linked")
        named = linked.join(nodes.select("node", "least_id"), "node")
        lowest = stored(named.groupBy("root").agg(F.min("least_id").alias("component_id")), "lowest")
        joined = stored(linked.join(lowest, "root").select("node", "component_id"), "joined")
        labels = stored(
            nodes.join(joined, "node", "left").select(
                "high", "low", F.coalesce("component_id", "least_id").alias("component_id")
            ),
            "labels",
            lasting=True,
        )
    copies = table.filter("n_shingles > 0").select("doc_id", "n_shingles", "high", "low").join(labels, ["high", "low"])
    alone = table.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    result = copies.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

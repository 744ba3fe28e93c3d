"""The trie of conversation prefixes, from sorted conversations and their common prefixes.

Conversations are cut into segments of a fixed number of turns, each keyed by the prefix before
it, and sorted globally by key, turns and conversation.  In that order the conversations that
begin alike stand together, so a node of the trie is an interval.  A task reads its sorted rows in
blocks: it takes the length of the common prefix (LCP) of each two neighbours, builds a sparse
table of range minima over them, and for each candidate prefix (every end of a segment and every
LCP) searches the left and the right end of the interval by halving steps, one candidate
independent of the other.  An interval stands for all depths between the LCPs at its borders and
its own; there is no stack and no walk over the tree.

A prefix is known by the exclusive or of 128-bit hashes of its turns, each with its position.
What an interval has on both sides of a block's border is added up by that key, so blocks,
partitions and groups of equal conversations may be cut anywhere.  A conversation that holds most
of all turns is many segments.

Sums over subtrees come from owners: a node is owned by its smallest member, the nodes of an owner
are the lower end of its path, and so the subtree of a node holds all nodes owned by its members,
but for what its own owner has above it.  A second pass over the same intervals adds those up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfkin.llm.common import passing_tables, stored

FAMILY = 5  # conversations of one family share the beginning of the family's first
BORROWED = 9  # fewer than so many turns are taken over
SEGMENT = 16  # turns of a segment
BLOCK_ROWS = 1 << 16  # segments a task holds at a time
RUN = 1 << 12  # rows of one key whose running total is made in one task
CHUNK_IDS = 512  # ids written as one piece of text
SORTED = ("root_hi", "root_lo", "segment", "toks", "conv_id")
NO_IDS = hashlib.sha256(b"").hexdigest()


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, c1, c2, size): turns numbered from 1, their content hash and UTF-8 bytes of text.

    Turns are in order of turn (null first), role and text.  They are sorted over all partitions
    and numbered inside them, so a conversation of any length is never in one task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            start = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            local = np.arange(1, len(ids) + 1) - np.repeat(start, np.diff(np.r_[start, len(ids)]))
            if ids[0] == last:
                local[ids == last] += seen
            last, seen = ids[-1], int(local[-1])
            arrays = [*batch.columns, pa.array(np.full(len(ids), part, np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "c1", "c2", "size", "part", "local"])

    spark = conversations.sparkSession
    known = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    ranged = known.repartitionByRange(_parts(spark), "conv_id", "turn", "role", F.substring("text", 1, 32))
    hashes = [F.xxhash64(F.lit(salt), "role", "text").alias(f"c{salt}") for salt in (1, 2)]
    narrow = ranged.sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", *hashes, F.octet_length("text").cast("long").alias("size")
    )
    turns = stored(
        narrow.mapInArrow(count, "conv_id long, c1 long, c2 long, size long, part int, local long"), "turns"
    )
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("held"))
    moved = held.withColumn("offset", F.sum("held").over(before)).filter("offset > 0").drop("held")
    # Only the first conversation of a partition can have begun before it: a row per partition.
    return turns.join(F.broadcast(moved), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("local") + F.coalesce("offset", F.lit(0))).alias("at"), "c1", "c2", "size"
    )


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations with their number of rebuilt turns, rebuilt turns).

    Conversation c takes the first h turns of the first of its family, c - c % FAMILY, and goes on
    with its own turns after its first h; h = crc32(c in decimal) % BORROWED.
    """
    lengths = stored(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")), "lengths")
    borrowed = F.crc32(F.col("conv_id").cast("string")) % BORROWED
    family = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family")
    firsts = lengths.withColumnsRenamed({"conv_id": "family", "own": "first_own"})
    convs = stored(
        lengths.select("conv_id", "own", family, borrowed.alias("h"))
        .join(firsts, "family", "left")
        .withColumn("taken", F.least("h", F.coalesce("first_own", F.lit(0))))
        .withColumn("total", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
        .select("conv_id", "family", "h", "taken", "total"),
        "convs",
    )
    rest = turns.join(convs, "conv_id").filter("at > h")
    rest = rest.select("conv_id", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "c1", "c2", "size")
    heads = turns.filter(F.col("at") < BORROWED).withColumnRenamed("conv_id", "family")
    head = convs.select("conv_id", "family", "taken").join(heads, "family").filter("at <= taken")
    head = head.select("conv_id", F.col("at").alias("depth"), "c1", "c2", "size")
    return convs, head.unionByName(rest)


def running(df: DataFrame, key: str, at: str, totals: dict[str, tuple[Callable, str]]) -> DataFrame:
    """Adds, for each (name: aggregate, column), the aggregate over the rows of `key` before `at`.

    Made in blocks of `at` and over the blocks' totals, so a key with most rows is many groups.
    Aggregates must combine with themselves; nothing before gives null.
    """
    blocked = df.withColumn("block", F.floor(F.col(at) / RUN))
    inner = Window.partitionBy(key, "block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy(key, "block").agg(*[agg(c).alias(f"{n}_all") for n, (agg, c) in totals.items()])
    offsets = sums.select(key, "block", *[agg(f"{n}_all").over(outer).alias(f"{n}_off") for n, (agg, _) in totals.items()])
    within = blocked.withColumns({n: agg(c).over(inner) for n, (agg, c) in totals.items()})
    return within.join(offsets.filter("block > 0"), [key, "block"], "left").drop("block")


def segments(convs: DataFrame, turns: DataFrame, width: int) -> DataFrame:
    """(conv_id, segment, root_hi, root_lo, toks, sizes, end_hi, end_lo): pieces of `width` turns.

    `root` is the key of the prefix before the segment, `end` that of the whole conversation, null
    but in its last segment.  A conversation without turns is one empty segment.
    """
    tok = [F.xxhash64(F.lit(salt), "depth", "c1", "c2").alias(name) for salt, name in ((1, "hi"), (2, "lo"))]
    one = F.struct("depth", *tok, "size")
    grouped = (
        turns.withColumn("segment", F.floor((F.col("depth") - 1) / width))
        .groupBy("conv_id", "segment")
        .agg(F.sort_array(F.collect_list(one)).alias("held"), *[F.bit_xor(t).alias(f"own_{n}") for t, n in zip(tok, ("hi", "lo"))])
    )
    empty = convs.filter("total = 0").select("conv_id", F.lit(0).cast("long").alias("segment"))
    grouped = grouped.unionByName(empty, allowMissingColumns=True)
    keyed = running(
        stored(grouped, "pieces"), "conv_id", "segment", {"hi": (F.bit_xor, "own_hi"), "lo": (F.bit_xor, "own_lo")}
    )

    def joined(*columns: str) -> Column:
        out = F.lit(0).cast("long")
        for c in columns:
            out = out.bitwiseXOR(F.coalesce(c, F.lit(0).cast("long")))
        return out

    keyed = keyed.join(convs.select("conv_id", "total"), "conv_id")
    last = F.col("segment") == F.greatest(F.floor((F.col("total") - 1) / width), F.lit(0))
    held = F.coalesce("held", F.array().cast(grouped.schema["held"].dataType))
    return keyed.select(
        "conv_id",
        "segment",
        joined("hi", "hi_off").alias("root_hi"),
        joined("lo", "lo_off").alias("root_lo"),
        F.transform(held, lambda t: F.struct(t["hi"].alias("hi"), t["lo"].alias("lo"))).alias("toks"),
        F.transform(held, lambda t: t["size"]).alias("sizes"),
        F.when(last, joined("hi", "hi_off", "own_hi")).alias("end_hi"),
        F.when(last, joined("lo", "lo_off", "own_lo")).alias("end_lo"),
    )


class RangeMin:
    """Sparse table: level k holds the least of each 2^k neighbours."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            before = self.levels[-1]
            self.levels.append(np.minimum(before[:-width], before[width:]))
            width *= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least value from `first` to `last`, both included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level):
            at = level == k
            table = self.levels[k]
            out[at] = np.minimum(table[first[at]], table[last[at] - (1 << int(k)) + 1])
        return out

    def reach(self, start: np.ndarray, bar: np.ndarray, forward: bool) -> np.ndarray:
        """How many values in a row, from `start` on (or before it, backwards), are at least `bar`."""
        far = np.zeros(len(start), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            width, table = 1 << k, self.levels[k]
            at = start + far if forward else start - far - width
            fits = (at >= 0) & (at < len(table))
            fits[fits] = table[at[fits]] >= bar[fits]
            far[fits] += width
        return far


def intervals(length: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, top, depth) of every different prefix of sorted rows.

    `common[i]` is the LCP of rows i - 1 and i, -1 where they have not even the root in common; it
    has one more entry than there are rows, the first and last being -1.  An interval is the rows
    left to right, which have the prefixes of depth top to `depth` and no others in common.
    """
    n = len(length)
    row = np.r_[np.arange(n), np.flatnonzero(common[:n] >= 0)]
    depth = np.r_[length, common[:n][common[:n] >= 0]]
    table = RangeMin(common)
    right = row + table.reach(row + 1, depth, True)
    left = row - table.reach(row + 1, depth, False)
    _, first = np.unique(np.stack([left, depth]), axis=1, return_index=True)
    left, right, depth = left[first], right[first], depth[first]
    return left, right, np.maximum(common[left], common[right + 1]) + 1, depth


class _Block:
    """Sorted segments as matrices, with all their distinct prefixes."""

    def __init__(self, table: pa.Table, width: int):
        table = table.combine_chunks()
        self.conv = table["conv_id"].to_numpy()
        segment, hi, lo = (table[c].to_numpy() for c in ("segment", "root_hi", "root_lo"))
        toks, sizes = (table[c].combine_chunks() for c in ("toks", "sizes"))
        length = np.asarray(toks.value_lengths()).astype(np.int64)
        n, inside = len(length), np.arange(width) < length[:, None]
        turns = toks.flatten()
        self.keys = []  # of every prefix of a segment, the empty one first
        same = np.zeros((n - 1, width + 1), bool)
        same[:, :width] = inside[1:] & inside[:-1]
        for root, name in ((hi, "hi"), (lo, "lo")):
            tok = np.zeros((n, width), np.int64)
            tok[inside] = turns.field(name).to_numpy()
            same[:, :width] &= tok[1:] == tok[:-1]
            self.keys.append(np.bitwise_xor.accumulate(np.c_[root, tok], axis=1))
        self.bytes = np.zeros((n, width + 1), np.int64)
        self.bytes[:, 1:][inside] = sizes.flatten().to_numpy()
        one_root = (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1]) & (segment[1:] == segment[:-1])
        common = np.full(n + 1, -1, np.int64)
        common[1:n] = np.where(one_root, same.argmin(axis=1), -1)
        left, right, top, depth = intervals(length, common)
        # The root of a later segment is the last prefix of the one before and counted there.
        top = np.maximum(top, (segment[left] > 0).astype(np.int64))
        levels = np.maximum(depth - top + 1, 0)
        of = np.repeat(np.arange(len(left)), levels)
        ends = np.cumsum(levels)
        self.level = np.arange(len(of)) - np.repeat(ends - levels, levels) + top[of]
        self.left, self.right = left[of], right[of]
        self.depth = segment[self.left] * width + self.level

    def key(self, level: np.ndarray) -> list[np.ndarray]:
        return [key[self.left, level] for key in self.keys]

    def total(self, values: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(values)]
        return sums[self.right + 1] - sums[self.left]


def _node_rows(table: pa.Table, width: int) -> pa.RecordBatch:
    block = _Block(table, width)
    hi, lo = block.key(block.level)
    root = block.level == 0
    up_hi, up_lo = (pa.array(k, mask=root) for k in block.key(np.maximum(block.level - 1, 0)))
    least = RangeMin(block.conv).least(block.left, block.right)
    arrays = [hi, lo, block.depth, up_hi, up_lo, block.right - block.left + 1, least, block.bytes[block.left, block.level]]
    return pa.RecordBatch.from_arrays(
        [pa.array(a) for a in arrays], ["hi", "lo", "depth", "up_hi", "up_lo", "n_convs", "conv_id", "bytes"]
    )


def _sum_rows(table: pa.Table, width: int) -> pa.RecordBatch:
    block = _Block(table, width)
    sums = [block.total(table[c].to_numpy()) for c in ("saved", "leaves")]
    return pa.RecordBatch.from_arrays([pa.array(a) for a in (*block.key(block.level), *sums)], ["hi", "lo", "saved", "leaves"])


def _over_blocks(
    rows: DataFrame, made: Callable[[pa.Table, int], pa.RecordBatch], width: int, schema: str
) -> DataFrame:
    """`made` over the sorted rows of every partition, in blocks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                held += batch.num_rows
            if held >= BLOCK_ROWS:
                yield made(pa.Table.from_batches(waiting), width)
                waiting, held = [], 0
        if held:
            yield made(pa.Table.from_batches(waiting), width)

    return rows.sortWithinPartitions(*SORTED).mapInArrow(run, schema)


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of the conversations (hi, lo, conv_id) that end at each node.

    The ids are sorted over all partitions and written in pieces; the pieces of a node then pass
    through one hash in order, a few at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hi, lo, ids = (batch.column(c).to_numpy() for c in ("hi", "lo", "conv_id"))
            cuts = np.flatnonzero((hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) + 1
            edges = np.r_[0, cuts, len(ids)].tolist()
            rows = [(i, min(i + CHUNK_IDS, b)) for a, b in zip(edges, edges[1:]) for i in range(a, b, CHUNK_IDS)]
            first = np.array([a for a, _ in rows])
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in rows]
            arrays = [pa.array(hi[first]), pa.array(lo[first]), pa.array(ids[first]), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["hi", "lo", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            his, los, digests = zip(*rows)
            arrays = [pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(digests, pa.string())]
            return pa.RecordBatch.from_arrays(arrays, ["hi", "lo", "ends_sha256"])

        for batch in batches:
            done = []
            his, los = (batch.column(c).to_pylist() for c in ("hi", "lo"))
            for here, text in zip(zip(his, los), batch.column("ids")):
                if here != key:
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = here, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(text.as_buffer())
            if done:
                yield out(done)
        if state is not None:
            yield out([(*key, state.hexdigest())])

    parts = _parts(ends.sparkSession)
    ranged = ends.repartitionByRange(parts, "hi", "lo", "conv_id").sortWithinPartitions("hi", "lo", "conv_id")
    written = ranged.mapInArrow(pieces, "hi long, lo long, first long, ids string")
    grouped = written.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "first")
    return grouped.mapInArrow(hashed, "hi long, lo long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see `rebuilt_turns`).

    conv_id: the smallest member, a member being a conversation that begins with the node's turns;
    depth; parent_conv_id: conv_id of the parent, null for the root; n_convs: members; n_children;
    n_leaves: childless nodes of the subtree, itself included; saved_tokens: over the subtree, members
    beyond the first times the UTF-8 bytes of the node's last text; ends_sha256: SHA-256 of the
    ids of the members that end there, ascending, in decimal, parted by commas.

    A null role or text is empty; turns with the same number are in order of role and text, and
    repeated rows are turns of their own.  Rows without conv_id are no conversation.  Other
    columns are not read.  A table without conversations gives no rows, not even a root.
    """
    with passing_tables(conversations.sparkSession):
        turns = stored(numbered_turns(conversations), "numbered")
        convs, rebuilt = rebuilt_turns(turns)
        parts = _parts(conversations.sparkSession)
        pieces = segments(convs, rebuilt, SEGMENT).repartitionByRange(parts, *SORTED)
        sorted_pieces = stored(pieces.withColumn("shard", F.spark_partition_id()), "segments")
        rows = sorted_pieces.drop("end_hi", "end_lo").repartitionById(parts, "shard")
        made = _over_blocks(
            rows.select(*SORTED, "sizes"),
            _node_rows,
            SEGMENT,
            "hi long, lo long, depth long, up_hi long, up_lo long, n_convs long, conv_id long, bytes long",
        )
        nodes = stored(
            made.groupBy("hi", "lo").agg(
                F.max("depth").alias("depth"),
                F.max("up_hi").alias("up_hi"),
                F.max("up_lo").alias("up_lo"),
                F.sum("n_convs").alias("n_convs"),
                F.min("conv_id").alias("conv_id"),
                F.max("bytes").alias("bytes"),
            ),
            "nodes",
        )
        kids = stored(
            nodes.filter("up_hi IS NOT NULL").groupBy("up_hi", "up_lo").agg(F.count(F.lit(1)).alias("n_children")), "kids"
        ).withColumnsRenamed({"up_hi": "hi", "up_lo": "lo"})
        parents = nodes.select(
            F.col("hi").alias("up_hi"), F.col("lo").alias("up_lo"), F.col("conv_id").alias("parent_conv_id")
        )
        weight = (F.col("n_convs") - 1) * F.col("bytes")
        full = stored(
            nodes.join(kids, ["hi", "lo"], "left")
            .join(parents, ["up_hi", "up_lo"], "left")
            .withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "weight": weight})
            .drop("up_hi", "up_lo", "bytes"),
            "full",
        )
        owned = stored(
            full.groupBy("conv_id").agg(
                F.sum("weight").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves")
            ),
            "owned",
        )
        with_sums = (
            sorted_pieces.join(owned, "conv_id", "left")
            .fillna(0, ["saved", "leaves"])
            .repartitionById(parts, "shard")
            .select(*SORTED, "sizes", "saved", "leaves")
        )
        sums = _over_blocks(with_sums, _sum_rows, SEGMENT, "hi long, lo long, saved long, leaves long")
        sums = sums.groupBy("hi", "lo").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("n_leaves"))
        ends = sorted_pieces.filter("end_hi IS NOT NULL").select(
            F.col("end_hi").alias("hi"), F.col("end_lo").alias("lo"), "conv_id"
        )
        above = running(full, "conv_id", "depth", {"above": (F.sum, "weight")})
        both = F.coalesce("above", F.lit(0)) + F.coalesce("above_off", F.lit(0))
        result = (
            above.withColumn("over", both)
            .join(stored(sums, "sums"), ["hi", "lo"])
            .join(stored(digests_of_ends(ends), "ends"), ["hi", "lo"], "left")
            .select(
                "conv_id",
                "depth",
                "parent_conv_id",
                "n_convs",
                F.col("n_children").cast("long").alias("n_children"),
                "n_leaves",
                (F.col("saved") - F.col("over")).alias("saved_tokens"),
                F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
            )
        )
        return stored(result, "trie", lasting=True)

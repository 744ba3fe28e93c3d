"""Exact cosine similarity over a catalogue, computed in balanced tiles.

Rows are hashed by id into blocks of bounded size, and every pair of blocks meets in one
tile, grouped by the tile number.  Copies of one item spread over the blocks like any other
rows, so no input skew can make a block large.  A tile holds two blocks and works through
them in slices of bounded size; for neighbours, only the best K per row leave it.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfkin.operators import pivots, postings
from shelfkin.operators.tiles import DECIMALS, TILE, Best, Block, blocks_of, fill, mask_self, products, spread
from shelfkin.sources.snapshots import stored

# The tile functions travel to the Python workers by value, see `tiles`.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BYTES = 64 << 20  # one block as a task holds it, with the neighbours it collects
MIN_BLOCK_ROWS = 512
BATCH_COLUMNS = 256  # of a product, given at a time
RUN_COLUMNS = 16  # pairs of a row given in one direction before they are in the other
BANDED_ROWS = 4000  # of a block whose pairs are given in bands: two such blocks have ids of 13 bits
# Bands of similarities, 0.125 wide but for the lowest; at six decimals one dictionary of parquet holds a band's values.
BAND_EDGES = (-np.inf, *np.arange(-0.5, 0.9, 0.125).tolist(), np.inf)
BAND_PAIRS = 1 << 17  # of a band, given at a time
RUN_PAIRS = 64  # of these, given in one direction before they are in the other
LISTED_ROWS = 1 << 16  # of a catalogue whose rows meet by the labels they share, see `postings`
LISTED_SHARE = 16  # this way is taken when rows meet one row in so many first, at most
FURTHER_SHARE = 2  # and kept to when they meet one row in so many after that, at most; else plain blocks meet
CELL_ROWS = 2048  # rows of a cell in a small catalogue; a large one has `pivots.MOST_PIVOTS` cells

NEIGHBOR_SCHEMA = "id bigint, neighbor_id bigint, similarity double"


def l2_normalize(features: DataFrame) -> DataFrame:
    """Unit rows: `unit` for the numeric part and `label_weight` for each label present.

    A zero row stays zero.
    """
    squares = F.aggregate("numeric", F.lit(0.0), lambda acc, x: acc + x * x)
    norm = F.sqrt(squares + F.size("labels"))
    scale = F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0))
    return (
        features.withColumn("scale", scale)
        .select(
            "id",
            F.transform("numeric", lambda x: x / F.col("scale")).alias("unit"),
            "labels",
            (F.lit(1.0) / F.col("scale")).alias("label_weight"),
        )
    )


def _shape(features: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of all their numbers (8) and labels (4), from one aggregation."""
    held = 8 * F.size("numeric") + 4 * F.size("labels") + 8
    row = features.agg(F.count(F.lit(1)).alias("n"), F.sum(held.cast("long")).alias("held")).first()
    return row.n, row.held or 0


def _tasks(df: DataFrame) -> int:
    """Tasks that keep the cluster busy: as many as a shuffle has partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def block_count(rows: int, held: int, tiles: int, kept: int = 0) -> int:
    """Blocks so that each fits its byte budget and there are `tiles` pairs of them, about.

    A row takes what is held of it and the `kept` neighbours (16 bytes each) it collects.  Rows
    are held sparse, so the budget does not depend on the number of labels there are.
    """
    by_size = math.ceil((held + 16 * kept * rows) / BLOCK_BYTES)
    by_tiles = min(math.ceil(math.sqrt(2 * tiles)), math.ceil(rows / MIN_BLOCK_ROWS))
    return max(1, min(rows, max(by_size, by_tiles)))


def _block(blocks: int):
    return F.pmod(F.xxhash64("id"), F.lit(blocks))


def _square_tiles(units: DataFrame, blocks: int) -> DataFrame:
    """Each row once per tile its block takes part in; `side` tells the two blocks apart.

    The tiles are the lower triangle of block pairs, numbered row by row.
    """
    low, high = F.least("block", "other"), F.greatest("block", "other")
    tiled = (
        units.withColumn("block", _block(blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1))))
        .withColumn("tile", (F.shiftright(high * (high + 1), 1) + low))
        .withColumn("side", (F.col("block") > F.col("other")).cast("int"))
        .drop("block", "other")
    )
    return spread(tiled, blocks * (blocks + 1) // 2)


def _cross_tiles(queries: DataFrame, items: DataFrame, q_blocks: int, i_blocks: int) -> DataFrame:
    """Every block of `queries` (side 0) with every block of `items` (side 1)."""

    def copies(n: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1)))

    left = queries.withColumn("other", copies(i_blocks)).withColumn(
        "tile", _block(q_blocks) * i_blocks + F.col("other")
    )
    right = items.withColumn("other", copies(q_blocks)).withColumn(
        "tile", F.col("other") * i_blocks + _block(i_blocks)
    )
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    return spread(both.drop("other"), q_blocks * i_blocks)


def _tile_best(k: int) -> Callable[[pa.Table], pa.Table]:
    """The best k of each row of both blocks within a tile, at or above its bar if it has one."""

    def best(table: pa.Table) -> pa.Table:
        left, right, diagonal = blocks_of(table)
        of_left, of_right = (Best(b.ids, k, b.bar) for b in (left, right))
        fill(left, right, of_left, None if diagonal else of_right)
        return of_left.table() if diagonal else pa.concat_tables([of_left.table(), of_right.table()])

    return best


def _pair_batch(ids: np.ndarray, neighbors: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(ids), pa.array(neighbors), pa.array(value)]
    return pa.RecordBatch.from_arrays(arrays, names=["id", "neighbor_id", "similarity"])


def _in_runs(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The entries of two tables row by row, a run of one and then the same run of the other."""
    run = RUN_COLUMNS if one.shape[1] % RUN_COLUMNS == 0 else one.shape[1]
    return np.stack([x.reshape(len(x), -1, run) for x in (one, other)], axis=2).ravel()


def _tile_pairs(keep_self: bool, least: float | None = None, one_side: bool = True, both_ways: bool = True):
    """Every pair of a tile in both directions, one slice at a time.

    A tile with one side only is a block with itself, or without `one_side` has no pairs.  Without
    `both_ways` rows of side 0 are neighbours only.  The values of a run of pairs come twice in a
    row, once for each direction, so that whatever writes them compresses the second time.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        if not one_side and pc.count_distinct(table["side"]).as_py() < 2:
            return
        left, right, diagonal = blocks_of(table)
        for rows, cols, product in products(left, right):
            product = np.round(product, DECIMALS) + 0.0  # no negative zeros
            if not keep_self:
                mask_self(product, left.ids[rows], right.ids[cols])
            kept = product > -np.inf if least is None else product >= least
            if diagonal or not both_ways:
                r, c = np.nonzero(kept)
                a, b, value = left.ids[rows][r], right.ids[cols][c], product[r, c]
                yield _pair_batch(*((a, b) if diagonal else (b, a)), value)
                continue
            for start in range(0, product.shape[1], BATCH_COLUMNS):
                some = slice(start, start + BATCH_COLUMNS)
                a, b = np.broadcast_arrays(left.ids[rows][:, None], right.ids[cols][some])
                whole = _in_runs(a, b), _in_runs(b, a), _in_runs(*(product[:, some],) * 2)
                shown = _in_runs(*(kept[:, some],) * 2)
                yield _pair_batch(*(whole if shown.all() else (x[shown] for x in whole)))

    return pairs


def _band_pairs(keep_self: bool, band: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs of a tile in both directions whose similarity, as it is kept, lies in one band.

    A run of pairs in one direction is followed by the same run in the other.
    """
    low, high = (edge - 0.5 * 10.0**-DECIMALS for edge in BAND_EDGES[band : band + 2])  # between two kept values

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, diagonal = blocks_of(pa.Table.from_batches(batches))
        for rows, cols, product in products(left, right, in_order=diagonal):
            if not keep_self:
                mask_self(product, left.ids[rows], right.ids[cols])
            product = product.ravel()
            found = np.flatnonzero((product >= low) & (product < high) & (product > -np.inf))
            for start in range(0, len(found), BAND_PAIRS):
                some = found[start : start + BAND_PAIRS]
                r, c = np.divmod(some, cols.stop - cols.start)
                a, b = left.ids[rows][r], right.ids[cols][c]
                value = np.round(product[some], DECIMALS) + 0.0  # no negative zeros
                if diagonal:
                    own = a == b
                    yield _pair_batch(a[own], b[own], value[own])
                    a, b, value = (x[a < b] for x in (a, b, value))
                yield _pair_batch(*(_turned(*x) for x in ((a, b), (b, a), (value, value))))

    return pairs


def _turned(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """A run of one and then the same run of the other; what is left makes a shorter run."""
    whole = len(one) // RUN_PAIRS * RUN_PAIRS
    runs = np.stack([x[:whole].reshape(-1, RUN_PAIRS) for x in (one, other)], axis=1)
    return np.concatenate([runs.ravel(), one[whole:], other[whole:]])


def _banded_pairs(units: DataFrame, blocks: int, keep_self: bool) -> DataFrame:
    """Every pair in both directions, each tile met once for every band of similarities.

    The result is so large that its bytes count.  Parquet gives a column up to 131,072 values by
    their places in a dictionary (17 bits instead of 64), and a task's pairs of one band have no
    more at six decimals.  All bands read the same shuffled blocks; their products are made anew.
    """
    tiled = _square_tiles(units, blocks).groupBy(*TILE)
    bands = [tiled.applyInArrow(_band_pairs(keep_self, band), NEIGHBOR_SCHEMA) for band in range(len(BAND_EDGES) - 1)]
    return reduce(DataFrame.unionByName, bands)


def all_pairs_cosine(
    features: DataFrame,
    include_self: bool = False,
    min_similarity: float | None = None,
    neighbors: list[int] | None = None,
) -> DataFrame:
    """Cosine of every ordered pair `(id, neighbor_id, similarity)`.

    The result has n squared rows by definition; to serve neighbours use `topk_neighbors`, which
    never forms it.  With `min_similarity` only pairs that reach it leave their task, and only
    rows that can be in one meet those of another cell (see `pivots`), unless cells would leave
    out little and send more copies of the rows than plain blocks.  With `neighbors` only pairs
    whose `neighbor_id` is listed are asked for, and every row meets the listed rows alone.
    """
    rows, held = _shape(features)
    if neighbors is not None:
        listed = features.filter(F.col("id").isin(neighbors))
        l_blocks = block_count(*_shape(listed), 1)
        tiled = _cross_tiles(l2_normalize(listed), l2_normalize(features), l_blocks, block_count(rows, held, _tasks(features) ** 2))
        pairs = _tile_pairs(include_self, min_similarity, one_side=False, both_ways=False)
        return tiled.groupBy(*TILE).applyInArrow(pairs, NEIGHBOR_SCHEMA)
    units, blocks = l2_normalize(features), block_count(rows, held, _tasks(features))
    if min_similarity is None and rows > BANDED_ROWS:
        return _banded_pairs(units, max(block_count(rows, held, 1), math.ceil(rows / BANDED_ROWS)), include_self)
    pairs = _tile_pairs(include_self, min_similarity)
    chosen = None if min_similarity is None else _pivots(units, rows)
    if chosen is None:
        return _square_tiles(units, blocks).groupBy(*TILE).applyInArrow(pairs, NEIGHBOR_SCHEMA)
    placed = stored(pivots.place(units, chosen), "placed")
    cells = pivots.cells_of(placed, chosen.num_rows)
    layout = pivots.lay_out(cells, math.ceil(rows / blocks))
    barred = pivots.with_needs(placed.withColumn("bar", F.lit(float(min_similarity))), cells)
    barred = stored(barred.filter("needs <> 0"), "barred")
    needing = pivots.needed_cells(barred, chosen.num_rows)
    if not pivots.worth_it(cells, layout, needing, rows, blocks):
        return _square_tiles(units, blocks).groupBy(*TILE).applyInArrow(pairs, NEIGHBOR_SCHEMA)
    near = pivots.inside_tiles(placed, layout).groupBy(*TILE).applyInArrow(pairs, NEIGHBOR_SCHEMA)
    between = pivots.between_tiles(barred, layout, needing > 0, both_need=True).groupBy(*TILE)
    return near.unionByName(between.applyInArrow(_tile_pairs(include_self, min_similarity, False), NEIGHBOR_SCHEMA))


def with_zero_diagonal(pairs: DataFrame) -> DataFrame:
    """Self pairs kept, at similarity 0."""
    own = F.col("id") == F.col("neighbor_id")
    return pairs.withColumn("similarity", F.when(own, F.lit(0.0)).otherwise(F.col("similarity")))


def rank_neighbors(candidates: DataFrame, k: int) -> DataFrame:
    """The k best candidates per id with their rank; ties go to the smaller neighbour id."""
    return _ranked(candidates).filter(F.col("rank") <= k)


def _ranked(candidates: DataFrame) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbor_id")
    return candidates.withColumn("rank", F.row_number().over(order))


def topk_neighbors(features: DataFrame, k: int, report: dict | None = None) -> DataFrame:
    """The k most similar others of every item: `(id, neighbor_id, similarity, rank)`.

    In a large catalogue items meet by the labels they share, where that leaves out nearly all pairs
    (see `postings`).  Otherwise they meet their own cell first (see `pivots`).  The k-th best found there is an item's bar,
    and only cells that can hold something at least as good are met then.  Where that leaves out
    little, plain blocks meet instead, which takes fewer copies of the rows.  A `report` is filled
    with the tiles there are, the tiles met, and the rows sent to them.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    rows, held = _shape(features)
    k = max(1, min(k, rows - 1))
    blocks = block_count(rows, held, _tasks(features), k)
    units = l2_normalize(features)
    by_labels = _topk_by_labels(units, rows, held, k, report) if rows >= LISTED_ROWS else None
    if by_labels is not None:
        return by_labels
    chosen = _pivots(units, rows)
    if chosen is None:
        best = _square_tiles(units, blocks).groupBy(*TILE).applyInArrow(_tile_best(k), NEIGHBOR_SCHEMA)
        _fill(report, blocks * (blocks + 1) // 2, blocks * (blocks + 1) // 2, rows * blocks)
        return rank_neighbors(best, k)
    placed = stored(pivots.place(units, chosen), "placed")
    cells = pivots.cells_of(placed, chosen.num_rows)
    layout = pivots.lay_out(cells, math.ceil(rows / blocks))
    inside = pivots.inside_tiles(placed, layout).groupBy(*TILE)
    near = stored(rank_neighbors(inside.applyInArrow(_tile_best(k), NEIGHBOR_SCHEMA), k), "near")
    bars = near.filter(F.col("rank") == k).select("id", F.col("similarity").alias("bar"))
    barred = stored(pivots.with_needs(placed.join(bars, "id", "left"), cells), "barred")
    needed = pivots.needed_cells(barred, chosen.num_rows) > 0
    met = layout.between(needed | needed.T)
    inside_sent, sent = (layout.blocks * cells.rows).sum(), cells.rows[:, None] * (needed | needed.T)
    if not pivots.worth_it(cells, layout, sent, rows, blocks):
        tiled = _square_tiles(barred.drop("cell", "needs"), blocks).groupBy(*TILE)
        tiles = blocks * (blocks + 1) // 2
        _fill(report, tiles, tiles, int(inside_sent + rows * blocks))
        return rank_neighbors(tiled.applyInArrow(_tile_best(k), NEIGHBOR_SCHEMA), k)
    _fill(report, layout.everything(), int(layout.inside().sum() + met.sum()), int(inside_sent + (sent * layout.blocks).sum()))
    if not met.any():
        return near
    between = pivots.between_tiles(barred, layout, needed).groupBy(*TILE)
    far = between.applyInArrow(_tile_needed(k), NEIGHBOR_SCHEMA)
    return rank_neighbors(near.drop("rank").unionByName(far), k)


def _topk_by_labels(units: DataFrame, rows: int, held: int, k: int, report: dict | None) -> DataFrame | None:
    """The same by the labels items share; none where that would not leave out nearly all pairs.

    A repeated id, or a row that lists a label twice, leaves it to the other ways.
    """
    twice, bare = F.size("labels") > F.size(F.array_distinct("labels")), F.size("labels") == 0
    found = units.agg(*[f.alias(n) for n, f in (("ids", F.count("id")), ("twice", F.count_if(twice)), ("bare", F.count_if(bare)))])
    known = found.first()
    if known.ids < rows or known.twice or known.bare**2 * LISTED_SHARE > rows**2:
        return None
    if units.select("id").distinct().count() < rows:
        return None
    listed = stored(postings.with_lists(units, k), "listed")
    blocks, most = block_count(rows, held, _tasks(units), k), math.ceil(rows / block_count(rows, held, 1, k))
    seeds = listed.select(*postings.ROW, F.lit(-2.0).alias("bar"), F.array("seed").alias("asking"))
    first = postings.asked(seeds, listed, most)
    if first.pairs * LISTED_SHARE > rows**2:
        return None
    near = stored(rank_neighbors(postings.met(first, listed, k, _tasks(units), NEIGHBOR_SCHEMA), k), "near")
    bars = near.filter(F.col("rank") == k).select("id", F.col("similarity").alias("bar"))
    barred = listed.join(bars, "id", "left").withColumn("asking", postings.further(rows))
    barred = stored(barred.select(*postings.ROW, F.coalesce("bar", F.lit(-2.0)).alias("bar"), "asking"), "barred")
    second = postings.asked(barred, listed, most)
    everything = blocks * (blocks + 1) // 2
    if second.pairs * FURTHER_SHARE > rows**2:
        _fill(report, everything, first.tiles + everything, first.sent + rows * blocks)
        tiled = _square_tiles(barred.drop("asking"), blocks).groupBy(*TILE)
        return rank_neighbors(tiled.applyInArrow(_tile_best(k), NEIGHBOR_SCHEMA), k)
    _fill(report, everything, first.tiles + second.tiles, first.sent + second.sent)
    if not second.pairs:
        return near
    far = postings.met(second, listed, k, _tasks(units), NEIGHBOR_SCHEMA)
    # Two items may meet in several lists.
    both = near.drop("rank").unionByName(far).repartition("id")
    return rank_neighbors(both.groupBy("id", "neighbor_id").agg(F.max("similarity").alias("similarity")), k)


def _pivots(units: DataFrame, rows: int) -> pa.Table | None:
    """Pivots for a catalogue, or none where there would be one cell."""
    count = min(pivots.MOST_PIVOTS, rows // CELL_ROWS)
    chosen = pivots.choose(units, count) if count > 1 else None
    return chosen if chosen is not None and chosen.num_rows > 1 else None


def _fill(report: dict | None, tiles: int, met: int, sent: int) -> None:
    if report is not None:
        report.update(tiles=tiles, tiles_met=met, rows_sent=sent)


def _tile_needed(k: int) -> Callable[[pa.Table], pa.Table]:
    """The best k, at or above its bar, of each row that needs the other side of its tile."""

    def best(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        sides = [table.filter(pa.array(side == s)) for s in (0, 1)]
        if not all(s.num_rows for s in sides):
            return Best(np.empty(0, np.int64), k).table()
        whole = [Block(s) for s in sides]
        asking = [Block(s.filter(s["needy"])) for s in sides]
        n, m = (len(w.ids) for w in whole)
        found = []
        if len(asking[0].ids) * m + len(asking[1].ids) * n < n * m:
            for one, other in ((asking[0], whole[1]), (asking[1], whole[0])):
                of_one = Best(one.ids, k, one.bar)
                fill(one, other, of_one, others_only=False)
                found.append(of_one.table())
        else:
            both = [Best(w.ids, k, w.bar) for w in whole]
            fill(*whole, *both, others_only=False)
            found = [b.table() for b in both]
        return pa.concat_tables(found)

    return best


def topk_for(queries: DataFrame, features: DataFrame, k: int | None = None) -> DataFrame:
    """The same for some items only: `queries` are feature rows of the items asked about.

    Without `k` each query has a `depth` of its own, a positive integer: the catalogue is read
    and sent once, whatever the depths.
    """
    if k is not None and k < 1:
        raise ValueError("k must be at least 1")
    deep = queries if k is None else queries.withColumn("depth", F.lit(k))
    rows, held = _shape(features)
    i_blocks = block_count(rows, held, _tasks(features) ** 2)
    # A tile keeps no more for a query than the items it holds.
    kept = F.least(F.col("depth").cast("long"), F.lit(math.ceil(rows / i_blocks)))
    q_rows, q_held = _shape(deep)
    most = deep.agg(F.sum(kept).alias("kept")).first().kept or 0
    # A cosine does not depend on the depth, which only rides along.
    asked = l2_normalize(queries).join(deep.select("id", F.col("depth").cast("int").alias("depth")), "id")
    items = l2_normalize(features).withColumn("depth", F.lit(None).cast("int"))
    tiled = _cross_tiles(asked, items, block_count(q_rows, q_held + 16 * most, 1), i_blocks)
    best = tiled.groupBy(*TILE).applyInArrow(_tile_depths, f"{NEIGHBOR_SCHEMA}, depth int")
    return _ranked(best).filter("rank <= depth").drop("depth")


def _tile_depths(table: pa.Table) -> pa.Table:
    """The best of the items of a tile for each of its queries, as many as the query's depth.

    Queries are worked through by the power of two that holds their depth, so that a deep one
    does not deepen the others.  A tile whose queries or items are missing has nothing to compare.
    """
    side, depth = table["side"].to_numpy(), table["depth"].fill_null(1).to_numpy()
    items = Block(table.filter(pa.array(side == 1)))
    level = np.frexp(np.maximum(depth - 1, 0).astype(np.float64))[1]
    empty = {"id": pa.int64(), "neighbor_id": pa.int64(), "similarity": pa.float64(), "depth": pa.int32()}
    found = [pa.table({n: pa.array([], t) for n, t in empty.items()})]
    for power in np.unique(level[side == 0]).tolist() if len(items.ids) else ():
        rows = table.filter(pa.array((side == 0) & (level == power))).sort_by("id")
        asked = Block(rows)
        best = Best(asked.ids, min(1 << power, len(items.ids)))
        for r, c, product in products(asked, items):
            mask_self(product, asked.ids[r], items.ids[c])
            best.add(r, product, items.ids[c])
        kept = best.table()
        place = np.searchsorted(asked.ids, kept["id"].to_numpy())
        found.append(kept.append_column("depth", rows["depth"].combine_chunks().take(pa.array(place))))
    return pa.concat_tables(found)


def assert_unique_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Fail when an id occurs twice: it would have no single row of neighbours."""
    repeated = df.groupBy(key).count().filter("count > 1").select(key).first()
    if repeated is not None:
        raise ValueError(f"repeated {key}: {repeated[0]}")
    return df


def wide_matrix(neighbors: DataFrame, ids: list[int], items: DataFrame | None = None) -> DataFrame:
    """Similarities to the listed ids as columns, one row per item.

    With `items`, all rows the pairs were made from, `neighbors` need hold only pairs with the
    listed ids: any item that has a row to be paired with gets a row.
    """
    wide = neighbors.groupBy("id").pivot("neighbor_id", ids).agg(F.first("similarity"))
    if items is None or items.limit(2).count() < 2:
        return wide
    return items.select("id").distinct().join(wide, "id", "left")

"""Which parts of a catalogue can hold neighbours of a row: pivots and angle bounds.

The angle between unit rows is a metric.  A few rows far apart are the pivots; every row knows its
angle to each, and belongs to the cell of the nearest.  A cell knows the least and the greatest
angle of its rows to each pivot.  A row at angle t from a pivot whose cell reaches from low to high
there is at least max(low - t, t - high) away from all rows of the cell, so the cell can be left
out when even that angle gives less than the row needs.

There are at most 64 pivots, found in a sample of fixed size, so what the driver holds and sends
does not grow with the catalogue.  The sample decides how much is left out, never the result.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfkin.operators import tiles

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_PIVOTS = 64  # the cells a row needs are the bits of one long
SAMPLE = 1024  # rows the pivots are chosen from
SLACK = 2e-6  # angles are kept in single precision

UNIT = "id bigint, unit array<double>, labels array<int>, label_weight double"
PLACED = f"{UNIT}, cell int, near array<float>"


class Cells(NamedTuple):
    """The cells of a placed table: pivots, rows, and the angles their rows have to each pivot."""

    rows: np.ndarray  # of each cell
    low: np.ndarray  # [cell, pivot], in radians
    high: np.ndarray

    def reach(self, near: np.ndarray) -> np.ndarray:
        """The greatest cosine that rows at these angles to the pivots can have with each cell."""
        best = np.empty((len(near), len(self.rows)))
        for cell in range(len(self.rows)):
            gap = np.maximum(self.low[cell] - near, near - self.high[cell]).max(axis=1)
            best[:, cell] = np.cos(np.clip(gap - SLACK, 0.0, np.pi))
        return best


def _distant(sample: pa.Table, count: int) -> pa.Table:
    """Rows far from each other: each next one is the farthest from those chosen."""
    block = tiles.Block(sample.sort_by("id"))
    cosine = np.empty((len(block.ids), len(block.ids)))
    for rows, cols, product in tiles.products(block, block):
        cosine[rows, cols] = product
    chosen = [0]
    nearest = cosine[0].copy()
    while len(chosen) < min(count, len(block.ids)):
        far = int(nearest.argmin())
        if nearest[far] > 1 - 1e-9:
            break  # the rest are copies of rows chosen
        chosen.append(far)
        nearest = np.maximum(nearest, cosine[far])
    return sample.sort_by("id").take(chosen).sort_by("id")


def choose(units: DataFrame, count: int) -> pa.Table:
    """At most `count` rows of a sample of fixed size; rows of length zero have no direction."""
    some = units.select("id", "unit", "labels", "label_weight").filter(
        F.exists("unit", lambda x: x != 0) | (F.size("labels") > 0)
    )
    sample = some.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    return _distant(sample, min(count, MOST_PIVOTS)) if sample.num_rows else sample


def place(units: DataFrame, pivots: pa.Table) -> DataFrame:
    """The unit rows with their angle to each pivot, `near`, and the cell of the nearest one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = tiles.Block(pivots)
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).sort_by("id").combine_chunks()
            left = tiles.Block(table)
            near = np.empty((len(left.ids), len(right.ids)), np.float32)
            for r, c, product in tiles.products(left, right):
                near[r, c] = np.arccos(np.clip(product, -1.0, 1.0))
            offsets = np.arange(0, near.size + 1, near.shape[1], dtype=np.int32)
            table = table.append_column("cell", pa.array(near.argmin(axis=1).astype(np.int32)))
            table = table.append_column("near", pa.ListArray.from_arrays(offsets, near.ravel()))
            yield from table.to_batches()

    return units.select("id", "unit", "labels", "label_weight").mapInArrow(rows, PLACED)


def cells_of(placed: DataFrame, count: int) -> Cells:
    """Rows and angle bounds of each cell: one row per pivot reaches the driver."""
    bounds = [f(F.col("near")[j]).alias(f"{n}{j}") for j in range(count) for n, f in (("low", F.min), ("high", F.max))]
    found = {r.cell: r for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *bounds).collect()}
    rows = np.array([found[c].n if c in found else 0 for c in range(count)], dtype=np.int64)
    low, high = (
        np.array([[found[c][f"{n}{j}"] if c in found else np.nan for j in range(count)] for c in range(count)])
        for n in ("low", "high")
    )
    # Nothing can reach a cell without rows.
    return Cells(rows, np.where(np.isnan(low), 2 * np.pi, low), np.where(np.isnan(high), 2 * np.pi, high))


def with_needs(barred: DataFrame, cells: Cells) -> DataFrame:
    """Adds `needs`: a bit for each other cell that can hold something at least as similar as `bar`.

    A null bar needs every cell that has rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = np.left_shift(np.int64(1), np.arange(len(cells.rows), dtype=np.int64))
        for batch in batches:
            if not batch.num_rows:
                continue
            near = batch.column("near").flatten().to_numpy().reshape(batch.num_rows, -1)
            bar = batch.column("bar").fill_null(-2.0).to_numpy()
            needed = (cells.reach(near) >= bar[:, None] - tiles.MARGIN) & (cells.rows > 0)
            needed[np.arange(len(near)), batch.column("cell").to_numpy()] = False
            needs = np.bitwise_or.reduce(np.where(needed, bit, 0), axis=1)
            bars = pa.array(bar)
            kept = [batch.column(c) for c in ("id", "unit", "labels", "label_weight", "cell")]
            yield pa.RecordBatch.from_arrays(
                [*kept, bars, pa.array(needs)], ["id", "unit", "labels", "label_weight", "cell", "bar", "needs"]
            )

    return barred.select("id", "unit", "labels", "label_weight", "cell", "near", "bar").mapInArrow(
        rows, f"{UNIT}, cell int, bar double, needs bigint"
    )


def needed_cells(rows: DataFrame, count: int) -> np.ndarray:
    """[a, b]: how many rows of cell a need cell b; one row per cell reaches the driver."""
    out = np.zeros((count, count), np.int64)
    bits = [F.count_if(F.getbit("needs", F.lit(b)) == 1).alias(f"b{b}") for b in range(count)]
    for row in rows.groupBy("cell").agg(*bits).collect():
        out[row.cell] = [row[f"b{b}"] for b in range(count)]
    return out


def worth_it(cells: Cells, layout: Layout, sent: np.ndarray, rows: int, blocks: int) -> bool:
    """Whether cells save anything when `sent` [a, b] rows of cell a go to cell b.

    Every row meets every row in `blocks` plain blocks with that many copies of each.  Cells that
    leave out less than half of the pairs and send more copies than that are no help.
    """
    pairs = np.triu(sent.astype(float) * sent.T, 1).sum() * 2 + (cells.rows.astype(float) ** 2).sum()
    copies = (layout.blocks * cells.rows).sum() + (sent * layout.blocks).sum()
    return pairs < 0.5 * float(rows) ** 2 or copies <= rows * blocks


class Layout(NamedTuple):
    """Blocks of each cell, none of more than about `size` rows; a row's block is the hash of its id."""

    blocks: np.ndarray

    def inside(self) -> np.ndarray:
        """Tiles of two blocks of one cell, for each cell; the same block twice among them."""
        return self.blocks * (self.blocks + 1) // 2

    def between(self, met: np.ndarray) -> np.ndarray:
        """Tiles of blocks of two cells that meet, for each pair of cells, the smaller one first."""
        return np.triu(np.outer(self.blocks, self.blocks) * met, 1)

    def everything(self) -> int:
        """Tiles if every block met every block."""
        total = int(self.blocks.sum())
        return total * (total + 1) // 2


def lay_out(cells: Cells, size: int) -> Layout:
    return Layout(np.maximum(1, -(-cells.rows // size)))


def _of_cell(values: np.ndarray):
    """The entry of a row's cell."""
    return F.element_at(F.array(*map(F.lit, values.tolist())), F.col("cell") + 1)


def inside_tiles(placed: DataFrame, layout: Layout) -> DataFrame:
    """Rows once per tile of their own cell; `side` tells the two blocks apart."""
    counts = layout.inside()
    blocks, first = _of_cell(layout.blocks), _of_cell(np.cumsum(counts) - counts)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    tiled = (
        placed.drop("near")
        .withColumn("block", F.pmod(F.xxhash64("id"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        .withColumn("tile", first + F.shiftright(high * (high + 1), 1) + low)
        .withColumn("side", (F.col("block") > F.col("other")).cast("int"))
        .drop("block", "other", "cell")
    )
    return tiles.spread(tiled, int(counts.sum()))


def between_tiles(rows: DataFrame, layout: Layout, needed: np.ndarray, both_need: bool = False) -> DataFrame:
    """Rows once per tile with a block of another cell where they are needed.

    A tile is made of two cells one of which needs the other.  A row goes there when it needs the
    other cell, which `needy` tells, or when some row of the other cell needs its own; with
    `both_need` only when it needs the other cell itself.
    """
    met = needed & needed.T if both_need else needed | needed.T
    counts = layout.between(met)
    first = (np.cumsum(counts) - counts.ravel()).reshape(counts.shape)
    blocks = layout.blocks
    plain = ["id", "unit", "labels", "label_weight", "bar"]
    schema = f"{UNIT}, bar double, tile bigint, side int, needy boolean"

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, needs, block = (batch.column(c).to_numpy() for c in ("cell", "needs", "block"))
            for other in range(len(blocks)):
                needy = (needs >> other) & 1 == 1
                here = met[cell, other] & (needy if both_need else needy | needed[other, cell])
                at = np.flatnonzero(here & (cell != other))
                if not len(at):
                    continue
                mine, own = cell[at], block[at]
                low = mine < other
                moved = batch.select(plain).take(pa.array(at)).columns
                for partner in range(int(blocks[other])):
                    tile = np.where(
                        low, first[mine, other] + own * blocks[other] + partner, first[other, mine] + partner * blocks[mine] + own
                    )
                    arrays = [*moved, pa.array(tile), pa.array((~low).astype(np.int32)), pa.array(needy[at])]
                    yield pa.RecordBatch.from_arrays(arrays, [*plain, "tile", "side", "needy"])

    numbered = rows.withColumn("block", F.pmod(F.xxhash64("id"), _of_cell(blocks)))
    return tiles.spread(numbered.mapInArrow(copies, schema), max(1, int(counts.sum())))

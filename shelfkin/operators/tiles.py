"""The kernel of a tile: two blocks of rows multiplied slice by slice, the best kept.

Everything here runs inside one task, on two blocks of bounded size.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The tile functions travel to the Python workers by value, so that the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Similarities are compared and kept at this many decimals: equal vectors then tie exactly,
# whatever order their products were summed in.
DECIMALS = 10
SLICE_ROWS = 2048  # rows of either block multiplied at a time
SLICE_COLUMNS = 4096  # label columns made dense at a time
LISTING = 128  # a pair of rows listed for a label costs as much as so many in a product
PAIRS_LISTED = 1 << 22  # pairs listed at a time, about
SEED_COLUMNS = 256  # entries sorted to fill a list of neighbours
MARGIN = 1e-9  # more than rounding can move a similarity
SCREEN_BYTES = 128 << 20  # what the screens of both blocks may take, see `Screen`
PAIRS_CHECKED = 1 << 16  # pairs computed again at a time
MOST_CHECKED = 16  # a product of two slices is cheaper when one pair in so many passes the screen
MOST_TASKS = 1 << 20  # of one stage; beyond that a task takes several tiles

TILE = ("task", "tile")  # where `spread` has put the rows


def spread(tiled: DataFrame, tiles: int) -> DataFrame:
    """Shuffle by tile number: a task for each tile, so tasks stay as large as two blocks."""
    tasks = min(tiles, MOST_TASKS)
    task = F.pmod("tile", F.lit(tasks)).cast("int")
    return tiled.withColumn("task", task).repartitionById(tasks, "task")


class Block:
    """One block inside a task: ids in ascending order, features ready to be made dense."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("id").combine_chunks()
        self.ids = table["id"].to_numpy()
        self.weight = table["label_weight"].to_numpy()
        unit = table["unit"].combine_chunks()
        self.unit = unit.flatten().to_numpy().reshape(len(self.ids), -1 if len(self.ids) else 0)
        labels = table["labels"].combine_chunks()
        self.label = labels.flatten().to_numpy()
        self.label_row = np.repeat(np.arange(len(self.ids)), np.asarray(labels.value_lengths()))
        self.by_label: dict[tuple[int, int], tuple] = {}  # of each slice, when first asked for
        names = table.column_names
        self.bar = table["bar"].to_numpy() if "bar" in names else np.full(len(self.ids), -np.inf)

    def slices(self, rows: int | None = None) -> list[slice]:
        """Of all rows, or of the first ones only."""
        n = len(self.ids) if rows is None else rows
        return [slice(i, min(i + SLICE_ROWS, n)) for i in range(0, n, SLICE_ROWS)]

    def postings(self, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Labels of some rows with where each begins and how often it occurs, and its rows."""
        place = rows.start, rows.stop
        if place not in self.by_label:
            a, b = np.searchsorted(self.label_row, place)
            order = np.argsort(self.label[a:b], kind="stable")
            label, row = self.label[a:b][order], self.label_row[a:b][order] - rows.start
            labels, first, count = np.unique(label, return_index=True, return_counts=True)
            self.by_label[place] = labels, first, count, row
        return self.by_label[place]


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places of several runs, one run after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


def common_labels(left: Block, rows: slice, right: Block, cols: slice) -> np.ndarray | None:
    """How many labels the rows of two slices have in common; None if none at all.

    Frequent labels are counted by a product of 0/1 columns in single precision, where whole
    numbers are exact.  For the others their pairs of rows are listed.  A label is frequent when
    listing would cost more, so the columns are few however many labels there are.
    """
    l_labels, l_first, l_count, l_row = left.postings(rows)
    r_labels, r_first, r_count, r_row = right.postings(cols)
    shared, i, j = np.intersect1d(l_labels, r_labels, assume_unique=True, return_indices=True)
    if not len(shared):
        return None
    l_first, l_count, r_first, r_count = l_first[i], l_count[i], r_first[j], r_count[j]
    shape = (rows.stop - rows.start, cols.stop - cols.start)
    common = np.zeros(shape, dtype=np.float32)
    pairs = l_count.astype(np.int64) * r_count
    frequent = np.flatnonzero(pairs * LISTING > shape[0] * shape[1])
    for start in range(0, len(frequent), SLICE_COLUMNS):
        some = frequent[start : start + SLICE_COLUMNS]
        sides = []
        for n, first, count, row in ((shape[0], l_first, l_count, l_row), (shape[1], r_first, r_count, r_row)):
            side = np.zeros((n, len(some)), dtype=np.float32)
            side[row[_runs(first[some], count[some])], np.repeat(np.arange(len(some)), count[some])] = 1.0
            sides.append(side)
        common += sides[0] @ sides[1].T
    rare = np.flatnonzero(pairs * LISTING <= shape[0] * shape[1])
    cuts = np.searchsorted(np.cumsum(pairs[rare]), np.arange(PAIRS_LISTED, pairs[rare].sum(), PAIRS_LISTED))
    for some in np.split(rare, cuts):
        total = _runs(np.zeros(len(some), np.int64), pairs[some])  # numbers each label's pairs
        label = np.repeat(some, pairs[some])
        row = l_row[l_first[label] + total // r_count[label]]
        col = r_row[r_first[label] + total % r_count[label]]
        common += np.bincount(row * shape[1] + col, minlength=common.size).reshape(shape)
    return common


def blocks_of(table: pa.Table) -> tuple[Block, Block, bool]:
    """The two blocks of a tile; on the diagonal both are the same one."""
    side = table["side"].to_numpy()
    if not side.any():
        block = Block(table)
        return block, block, True
    return (
        Block(table.filter(pa.array(side == 0))),
        Block(table.filter(pa.array(side == 1))),
        False,
    )


def products(left: Block, right: Block, in_order: bool = False) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Cosines of the two blocks, one slice of each at a time.

    With `in_order` slices are left out where every id of `left` is above those of `right`.
    """
    for rows in left.slices():
        for cols in right.slices():
            if not in_order or left.ids[rows.start] <= right.ids[cols.stop - 1]:
                yield rows, cols, _product(left, rows, right, cols)


def _product(left: Block, rows: slice, right: Block, cols: slice) -> np.ndarray:
    product = left.unit[rows] @ right.unit[cols].T
    common = common_labels(left, rows, right, cols)
    if common is not None:
        product += common * left.weight[rows, None] * right.weight[cols]
    return product


class Screen:
    """Both blocks in single precision, the labels they share as columns.

    A product of these differs from the cosine by less than `slack`: rows are no longer than 1, so
    a sum of so many products is off by less than one rounding for each.
    """

    def __init__(self, left: Block, right: Block, shared: np.ndarray):
        self.slack = (left.unit.shape[1] + len(shared) + 8) * 2.0**-23 + MARGIN
        self.left, self.right = left, right
        self.l_has, self.l_near = self._columns(left, shared)
        self.r_has, self.r_near = (self.l_has, self.l_near) if left is right else self._columns(right, shared)

    @staticmethod
    def of(left: Block, right: Block) -> Screen | None:
        """None where the shared labels are too many to be columns, or a row lists one twice."""
        shared = np.intersect1d(left.label, right.label)
        rows = len(left.ids) + (0 if left is right else len(right.ids))
        if rows * (4 * left.unit.shape[1] + 5 * len(shared)) > SCREEN_BYTES:
            return None
        screen = Screen(left, right, shared)
        listed = [np.isin(block.label, shared).sum() for block in (left, right)]
        return screen if listed == [screen.l_has.sum(), screen.r_has.sum()] else None

    @staticmethod
    def _columns(block: Block, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = np.isin(block.label, shared)
        has = np.zeros((len(block.ids), len(shared)), bool)
        has[block.label_row[known], np.searchsorted(shared, block.label[known])] = True
        return has, np.concatenate([block.unit, has * block.weight[:, None]], axis=1, dtype=np.float32)

    def near(self, rows: slice, cols: slice) -> np.ndarray:
        return self.l_near[rows] @ self.r_near[cols].T

    def cosines(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of single pairs, in double precision."""
        out = np.empty(len(i))
        for start in range(0, len(i), PAIRS_CHECKED):
            a, b = i[start : start + PAIRS_CHECKED], j[start : start + PAIRS_CHECKED]
            value = np.einsum("ij,ij->i", self.left.unit[a], self.right.unit[b])
            common = (self.l_has[a] & self.r_has[b]).sum(axis=1)
            out[start : start + PAIRS_CHECKED] = value + common * self.left.weight[a] * self.right.weight[b]
        return out


def fill(left: Block, right: Block, of_left: Best, of_right: Best | None = None, others_only: bool = True) -> None:
    """The best of `right` for the rows of `left`, and the other way round with `of_right`.

    Lists that are not full take in the first rows of the other block.  From then on products in
    single precision tell which pairs may reach a list, and only these are computed as they are
    kept.  With `others_only` a row is no neighbour of itself.
    """
    screen = Screen.of(left, right)
    if screen is None:
        for rows, cols, product in products(left, right):
            if others_only:
                mask_self(product, left.ids[rows], right.ids[cols])
            of_left.add(rows, product, right.ids[cols])
            if of_right is not None:
                of_right.add(cols, product.T, left.ids[rows])
        return
    l_seeds = _seed(left, right, of_left, others_only, False)
    r_seeds = None if of_right is None else _seed(right, left, of_right, others_only, True)
    for rows in left.slices():
        for cols in right.slices():
            near, exact = screen.near(rows, cols), None
            for best, mine in ((of_left, rows), (of_right, cols)):
                if best is None:
                    continue
                low = (best.value[mine, -1] - screen.slack).astype(np.float32)
                if best is of_left:
                    r, c = _above(near, low, 1)
                    late = c + cols.start >= l_seeds[rows.start]
                else:
                    c, r = _above(near, low, 0)
                    late = r + rows.start >= r_seeds[cols.start]
                if others_only:
                    own = np.searchsorted(right.ids[cols], left.ids[rows])[r]
                    late &= (own != c) | (left.ids[rows][r] != right.ids[cols][c])
                r, c = r[late], c[late]
                if len(r) * MOST_CHECKED > near.size:
                    exact = _product(left, rows, right, cols) if exact is None else exact
                    value = exact[r, c]
                else:
                    value = screen.cosines(r + rows.start, c + cols.start)
                if best is of_left:
                    best.take(rows.start + r, value, right.ids[cols][c])
                else:
                    best.take(cols.start + c, value, left.ids[rows][r])


def _above(near: np.ndarray, low: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the entries above their row's `low`, row by row; of columns at axis 0."""
    some = np.flatnonzero(near.max(axis=axis) > low)
    if len(some) * 4 < len(low):  # most rows have none
        part = near[some] if axis else near[:, some].T
        found = np.flatnonzero(part > low[some, None])
        return some[found // part.shape[1]], found % part.shape[1]
    if axis:
        found = np.flatnonzero(near > low[:, None])
        return found // near.shape[1], found % near.shape[1]
    found = np.flatnonzero(near > low)
    r, c = found // near.shape[1], found % near.shape[1]
    order = np.argsort(c, kind="stable")
    return c[order], r[order]


def _seed(block: Block, other: Block, best: Best, others_only: bool, turned: bool) -> dict[int, int]:
    """Fill the lists that are not full; how many rows of `other` each slice has taken in."""
    taken = {}
    for rows in block.slices():
        full = not np.isneginf(best.value[rows, -1]).any()
        taken[rows.start] = 0 if full else min(len(other.ids), max(SEED_COLUMNS, 4 * best.k))
        for cols in other.slices(taken[rows.start]):
            product = _product(block, rows, other, cols)
            if others_only and turned:
                mask_self(product.T, other.ids[cols], block.ids[rows])
            elif others_only:
                mask_self(product, block.ids[rows], other.ids[cols])
            best.add(rows, product, other.ids[cols])
    return taken


def mask_self(product: np.ndarray, row_ids: np.ndarray, col_ids: np.ndarray) -> None:
    place = np.minimum(np.searchsorted(col_ids, row_ids), len(col_ids) - 1)
    own = np.flatnonzero(col_ids[place] == row_ids)
    product[own, place[own]] = -np.inf


class Best:
    """Running best k of each row of a block, best first, ties in order of id.

    With `bar` a row keeps nothing less similar than its own bar.
    """

    def __init__(self, ids: np.ndarray, k: int, bar: np.ndarray | None = None):
        self.ids, self.k = ids, k
        below = -np.inf if bar is None else np.where(bar < -1, -np.inf, bar - 0.5 * 10.0**-DECIMALS)
        self.floor = np.broadcast_to(below, len(ids))
        self.value = np.repeat(self.floor[:, None], k, axis=1)
        self.other = np.zeros((len(ids), k), dtype=np.int64)

    def add(self, rows: slice, product: np.ndarray, others: np.ndarray) -> None:
        """Take in one slice; slices must come in ascending order of `others`.

        The first columns fill the list; from then on only entries above the last place
        count, and an equal one never does, as its id is larger.
        """
        seeds = 0
        if np.isneginf(self.value[rows, -1]).any():
            seeds = min(product.shape[1], max(SEED_COLUMNS, 4 * self.k))
            seed = np.round(product[:, :seeds], DECIMALS) + 0.0  # no negative zeros
            value, column = _largest(seed, self.k)
            value = np.concatenate([self.value[rows], value], axis=1)
            other = np.concatenate([self.other[rows], others[column]], axis=1)
            order = np.argsort(-value, axis=1, kind="stable")[:, : self.k]
            self.value[rows] = np.take_along_axis(value, order, axis=1)
            self.other[rows] = np.take_along_axis(other, order, axis=1)
        bar = self.value[rows, -1]
        r, c = np.nonzero(product[:, seeds:] > bar[:, None] - MARGIN)
        c += seeds
        self.take(rows.start + r, product[r, c], others[c])

    def take(self, row: np.ndarray, value: np.ndarray, other: np.ndarray) -> None:
        """Take in single entries, in ascending order of `other` for each row and after what was added."""
        value = np.round(value, DECIMALS) + 0.0
        above = value > self.value[row, -1]
        if above.any():
            self._insert(row[above], value[above], other[above])

    def _insert(self, row: np.ndarray, value: np.ndarray, other: np.ndarray) -> None:
        """Merge single entries, which come in ascending order of `other` for each row."""
        touched, at = np.unique(row, return_inverse=True)
        place = np.concatenate([np.repeat(np.arange(len(touched)), self.k), at])
        value = np.concatenate([self.value[touched].ravel(), value])
        other = np.concatenate([self.other[touched].ravel(), other])
        order = np.lexsort((-value, place))  # stable: equal values keep their order
        place = place[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        order = order[rank < self.k]
        self.value[touched] = value[order].reshape(-1, self.k)
        self.other[touched] = other[order].reshape(-1, self.k)

    def table(self) -> pa.Table:
        keep = self.value > self.floor[:, None]
        ids = np.repeat(self.ids, keep.sum(axis=1))
        return pa.table(
            {"id": ids, "neighbor_id": self.other[keep], "similarity": self.value[keep]}
        )


def _largest(product: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and columns of the k largest entries per row; ties go to the first columns."""
    n, m = product.shape
    if m > k:
        bar = np.partition(product, m - k, axis=1)[:, m - k, None]
        pick = product >= bar
        tied = np.flatnonzero(pick.sum(axis=1) > k)
        if len(tied):
            above, level = product[tied] > bar[tied], product[tied] == bar[tied]
            room = k - above.sum(axis=1, keepdims=True)
            pick[tied] = above | (level & (np.cumsum(level, axis=1) <= room))
        column = np.nonzero(pick)[1].reshape(n, k)
    else:
        column = np.broadcast_to(np.arange(m), (n, m))
    return np.take_along_axis(product, column, axis=1), column

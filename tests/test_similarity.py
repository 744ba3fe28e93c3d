"""Cosine neighbours against a plain matrix product."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfkin.operators import pivots, tiles
from shelfkin.operators import similarity as sim

SCHEMA = "id bigint, numeric array<double>, labels array<int>"


def frame(spark, rows, parts=4):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def random_rows(n, seed, width=3, labels=12):
    rng = np.random.default_rng(seed)
    return [
        (int(i) * 7 + 1, [float(x) for x in rng.normal(size=width)],
         sorted(int(x) for x in set(rng.integers(0, labels, 4))))
        for i in rng.permutation(n)
    ]


def matrix(rows, labels):
    ids = np.array([r[0] for r in rows])
    dense = np.zeros((len(rows), len(rows[0][1]) + labels))
    for i, (_, numeric, present) in enumerate(rows):
        dense[i, : len(numeric)] = numeric
        dense[i, [len(numeric) + j for j in present]] = 1.0
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    unit = dense / np.where(norm > 0, norm, 1)
    return ids, np.round(unit @ unit.T, tiles.DECIMALS) + 0.0


def expected_top(rows, labels, k):
    ids, cosine = matrix(rows, labels)
    out = {}
    for i, own in enumerate(ids):
        order = sorted((-cosine[i, j], ids[j]) for j in range(len(ids)) if j != i)
        out[int(own)] = [(int(j), -s) for s, j in order[:k]]
    return out


def got_top(df):
    out = {}
    for r in df.orderBy("id", "rank").collect():
        out.setdefault(r.id, []).append((r.neighbor_id, r.similarity))
    return out


def same(got, expected):
    assert got.keys() == expected.keys()
    for key, pairs in expected.items():
        assert [j for j, _ in got[key]] == [j for j, _ in pairs]
        assert [s for _, s in got[key]] == pytest.approx([s for _, s in pairs], abs=1e-9)


@pytest.mark.parametrize("blocks", [1, 3, 8])
@pytest.mark.parametrize("rows_per_slice, columns_per_slice", [(2048, 4096), (7, 4)])
def test_top_neighbours(spark, monkeypatch, blocks, rows_per_slice, columns_per_slice):
    monkeypatch.setattr(sim, "block_count", lambda *_: blocks)
    monkeypatch.setattr(tiles, "SLICE_ROWS", rows_per_slice)
    monkeypatch.setattr(tiles, "SLICE_COLUMNS", columns_per_slice)
    rows = random_rows(90, 5)
    same(got_top(sim.topk_neighbors(frame(spark, rows), 4)), expected_top(rows, 12, 4))


@pytest.mark.parametrize("blocks", [1, 5])
def test_a_third_of_the_items_are_copies(spark, monkeypatch, blocks):
    """Ties are broken by id, also across tiles and slices."""
    monkeypatch.setattr(sim, "block_count", lambda *_: blocks)
    monkeypatch.setattr(tiles, "SLICE_ROWS", 16)
    rows = random_rows(80, 6) + [(1000 + i, [0.5, 1.0, 2.0], [1, 2]) for i in range(40)]
    same(got_top(sim.topk_neighbors(frame(spark, rows), 6)), expected_top(rows, 12, 6))


def test_blocks_stay_balanced_under_copies(spark):
    rows = spark.range(30_000).withColumn("block", sim._block(10)).groupBy("block").count().collect()
    assert len(rows) == 10 and max(r["count"] for r in rows) < 3_500


def test_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(sim, "block_count", lambda *_: 3)
    rows = random_rows(40, 7)
    ids, cosine = matrix(rows, 12)
    place = {int(x): i for i, x in enumerate(ids)}
    pairs = sim.all_pairs_cosine(frame(spark, rows), include_self=True).collect()
    assert len(pairs) == 1600
    for r in pairs:
        assert r.similarity == pytest.approx(cosine[place[r.id], place[r.neighbor_id]], abs=1e-9)
    without = sim.all_pairs_cosine(frame(spark, rows)).collect()
    assert len(without) == 1560 and all(r.id != r.neighbor_id for r in without)
    seen = {(r.id, r.neighbor_id): r.similarity for r in without}
    assert all(seen[b, a] == s and -1 <= s <= 1 for (a, b), s in seen.items())


def test_equal_orthogonal_and_zero_rows(spark):
    rows = [(1, [2.0, 0.0], []), (2, [5.0, 0.0], []), (3, [0.0, 1.0], []), (4, [0.0, 0.0], [])]
    seen = {(r.id, r.neighbor_id): r.similarity for r in sim.all_pairs_cosine(frame(spark, rows)).collect()}
    assert seen[1, 2] == 1.0 and seen[1, 3] == 0.0 and seen[1, 4] == 0.0 and seen[4, 3] == 0.0
    cells = sim.with_zero_diagonal(sim.all_pairs_cosine(frame(spark, rows), include_self=True))
    assert all(r.similarity == 0.0 for r in cells.filter("id = neighbor_id").collect())


def test_fewer_items_than_neighbours(spark):
    rows = [(1, [1.0], []), (2, [1.0], [])]
    assert got_top(sim.topk_neighbors(frame(spark, rows), 5)) == {1: [(2, 1.0)], 2: [(1, 1.0)]}
    assert sim.topk_neighbors(frame(spark, rows[:1]), 5).count() == 0


def test_top_for_some_items(spark, monkeypatch):
    monkeypatch.setattr(sim, "block_count", lambda *_: 4)
    rows = random_rows(70, 8)
    some = [r for r in rows if r[0] % 5 == 0]
    expected = expected_top(rows, 12, 9)
    got = got_top(sim.topk_for(frame(spark, some), frame(spark, rows), 9))
    same(got, {r[0]: expected[r[0]] for r in some})


def test_block_count_is_bounded_by_size():
    for n, row_bytes in ((10, 48), (100_000, 520), (10_000_000, 520), (1_000_000, 100_000)):
        blocks = sim.block_count(n, n * row_bytes, 8)
        assert n / blocks * row_bytes <= sim.BLOCK_BYTES or n <= sim.MIN_BLOCK_ROWS
        assert blocks <= n


def test_many_labels_do_not_make_many_blocks():
    """20 million items with 5 numbers and 18 labels each: a row is copied once per block."""
    n, held = 20_000_000, 8 + 5 * 8 + 18 * 4
    assert n * sim.block_count(n, n * held, 1000, 50) <= 48e9 / 5


@pytest.mark.parametrize("listing", [0, 3, 10**6])
def test_labels_in_common(monkeypatch, listing):
    """All labels as columns, some, and all listed."""
    monkeypatch.setattr(tiles, "LISTING", listing)
    monkeypatch.setattr(tiles, "PAIRS_LISTED", 50)
    rng = np.random.default_rng(4)
    has = [(rng.random((n, 30)) < rng.random(30) ** 3) for n in (23, 31)]
    blocks = []
    for h in has:
        block = object.__new__(tiles.Block)
        block.label_row, block.label = np.nonzero(h)
        block.by_label = {}
        blocks.append(block)
    got = tiles.common_labels(blocks[0], slice(3, 20), blocks[1], slice(5, 31))
    assert (got == has[0][3:20].astype(int) @ has[1][5:31].astype(int).T).all()


def test_only_similar_pairs(spark):
    rows = random_rows(40, 11)
    every = sim.all_pairs_cosine(frame(spark, rows)).filter("similarity >= 0.4").collect()
    assert sorted(every) == sorted(sim.all_pairs_cosine(frame(spark, rows), min_similarity=0.4).collect())


def test_repeated_ids_are_refused(spark):
    df = frame(spark, [(1, [1.0], []), (1, [2.0], [])])
    with pytest.raises(ValueError, match="repeated id"):
        sim.assert_unique_ids(df)


def test_plan_limits_groups_before_the_shuffle(spark):
    plan = sim.topk_neighbors(frame(spark, random_rows(20, 9)), 3)._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "CartesianProduct" not in plan


def test_wide_matrix(spark):
    rows = [(1, [1.0], []), (2, [1.0], []), (3, [-1.0], [])]
    wide = sim.wide_matrix(sim.all_pairs_cosine(frame(spark, rows)), [1, 3]).orderBy("id").collect()
    assert [(r["1"], r["3"]) for r in wide] == [(None, -1.0), (1.0, -1.0), (-1.0, None)]


def test_wide_matrix_meets_only_its_columns(spark, monkeypatch):
    rows = random_rows(40, 13)
    every = sim.all_pairs_cosine(frame(spark, rows))
    ids = [rows[0][0], rows[1][0], -5]
    monkeypatch.setattr(sim, "block_count", lambda *_: 3)
    some = sim.all_pairs_cosine(frame(spark, rows), neighbors=ids)
    assert sorted(some.collect()) == sorted(every.filter(F.col("neighbor_id").isin(ids)).collect())
    with_self = sim.all_pairs_cosine(frame(spark, rows), include_self=True, neighbors=ids)
    assert with_self.count() == 2 * len(rows)
    got = sim.wide_matrix(some, ids, frame(spark, rows)).orderBy("id").collect()
    assert got == sim.wide_matrix(every, ids).orderBy("id").collect() and len(got) == len(rows)


@pytest.mark.parametrize("rows, n", [([(1, [1.0], [])], 0), ([(1, [1.0], []), (2, [2.0], [])], 2)])
def test_wide_matrix_has_a_row_for_items_without_a_listed_pair(spark, rows, n):
    for ids in ([9], [1, 9]):
        wide = sim.wide_matrix(sim.all_pairs_cosine(frame(spark, rows), neighbors=ids), ids, frame(spark, rows))
        assert wide.count() == n == sim.wide_matrix(sim.all_pairs_cosine(frame(spark, rows)), ids).count()


def clustered_rows(n, seed, clusters=6, labels=12):
    """Rows around a few centres, some far from all, some without direction, some copies."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 4)) * 3
    rows = []
    for i in range(n):
        at = centres[rng.integers(clusters)] + rng.normal(size=4) * 0.3
        if i % 10 == 0:
            at = rng.normal(size=4)
        rows.append((i * 3 - 20, [float(x) for x in at], sorted({int(x) for x in rng.integers(0, labels, i % 3)})))
    rows += [(10_000 + i, [0.0] * 4, []) for i in range(5)] + [(20_000 + i, [1.0, 2.0, 0.5, 1.0], [3]) for i in range(40)]
    return rows


@pytest.mark.parametrize("cell_rows, block_rows, k", [(20, 1000, 3), (40, 7, 5), (3, 11, 2), (20, 50, 60)])
def test_top_neighbours_by_pivots(spark, monkeypatch, cell_rows, block_rows, k):
    monkeypatch.setattr(sim, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(sim, "block_count", lambda rows, *_: max(1, rows // block_rows))
    rows = clustered_rows(160, k)
    report = {}
    got = got_top(sim.topk_neighbors(frame(spark, rows), k, report))
    same(got, expected_top(rows, 12, k))
    assert report["tiles_met"] <= report["tiles"]


def test_pivots_leave_tiles_out(spark, monkeypatch):
    monkeypatch.setattr(sim, "CELL_ROWS", 20)
    rng = np.random.default_rng(3)
    rows = [
        (i, [float(x) for x in np.eye(8)[i % 8] * 5 + rng.normal(size=8) * 0.1], []) for i in range(400)
    ]
    report = {}
    same(got_top(sim.topk_neighbors(frame(spark, rows), 5, report)), expected_top(rows, 0, 5))
    assert report["tiles_met"] < report["tiles"] / 2


@pytest.mark.parametrize("least", [-0.5, 0.3, 0.9, 0.999])
def test_similar_pairs_by_pivots(spark, monkeypatch, least):
    monkeypatch.setattr(sim, "CELL_ROWS", 20)
    rows = clustered_rows(120, 4)
    every = sim.all_pairs_cosine(frame(spark, rows)).filter(F.col("similarity") >= least).collect()
    assert sorted(every) == sorted(sim.all_pairs_cosine(frame(spark, rows), min_similarity=least).collect())


def test_bounds_hold_for_every_row():
    rng = np.random.default_rng(5)
    unit = rng.normal(size=(300, 5))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    unit[::50] = 0.0
    near = np.arccos(np.clip(unit @ unit[1:9].T, -1, 1)).astype(np.float32)
    cell = near.argmin(axis=1)
    low, high = (np.array([f(near[cell == c], axis=0) for c in range(8)]) for f in (np.min, np.max))
    reach = pivots.Cells(np.bincount(cell, minlength=8), low, high).reach(near)
    assert ((unit @ unit.T) <= reach[:, cell] + tiles.MARGIN).all()


def test_a_depth_for_each_query(spark, monkeypatch):
    """One pass serves all depths, deeper ones than a tile holds among them."""
    monkeypatch.setattr(sim, "block_count", lambda *_: 4)
    rows = random_rows(70, 12)
    depth = {r[0]: d for r, d in zip(rows[:12], (1, 2, 3, 4, 5, 8, 9, 16, 17, 40, 69, 1000))}
    asked = frame(spark, rows).join(spark.createDataFrame(list(depth.items()), "id long, depth int"), "id")
    got = got_top(sim.topk_for(asked, frame(spark, rows)))
    expected = expected_top(rows, 12, 1000)
    same(got, {i: expected[i][:d] for i, d in depth.items()})


def test_one_catalogue_scan_for_all_depths(spark, tmp_path):
    frame(spark, random_rows(40, 13)).write.parquet(str(tmp_path / "catalogue"))
    items = spark.read.parquet(str(tmp_path / "catalogue"))
    asked = frame(spark, random_rows(40, 13)[:9]).withColumn("depth", (F.col("id") % 30 + 1).cast("int"))
    plan = sim.topk_for(asked, items)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("catalogue") + plan.count("Relation [") <= 2


def block(rows, bar=None):
    unit = [np.array(r[1]) for r in rows]
    scale = [np.sqrt(u @ u + len(r[2])) for u, r in zip(unit, rows)]
    columns = {
        "id": pa.array([r[0] for r in rows], pa.int64()),
        "unit": pa.array([(u / s).tolist() for u, s in zip(unit, scale)], pa.list_(pa.float64())),
        "labels": pa.array([r[2] for r in rows], pa.list_(pa.int32())),
        "label_weight": pa.array([1 / s for s in scale]),
    }
    return tiles.Block(pa.table(columns | ({} if bar is None else {"bar": pa.array(bar)})))


@pytest.mark.parametrize("columns", [1 << 27, 0])
def test_screened_products_give_the_same_lists(monkeypatch, columns):
    """Rows that differ by less than single precision holds, copies, and labels; columns 0: no screen."""
    monkeypatch.setattr(tiles, "SCREEN_BYTES", columns)
    monkeypatch.setattr(tiles, "SLICE_ROWS", 64)
    monkeypatch.setattr(tiles, "SEED_COLUMNS", 16)
    rows = random_rows(300, 14)
    rng = np.random.default_rng(14)
    rows += [(9000 + i, [x + 1e-5 * rng.normal() for x in rows[i % 20][1]], rows[i % 20][2]) for i in range(200)]
    rows += [(8000 + i, *rows[i % 5][1:]) for i in range(60)]
    expected = expected_top(rows, 12, 5)
    halves = block(rows[::2]), block(rows[1::2])
    found = [tiles.Best(b.ids, 5) for b in halves]
    for b, best in zip(halves, found):
        tiles.fill(b, b, best)
    both = [tiles.Best(b.ids, 5) for b in halves]
    tiles.fill(*halves, *both)
    got = {}
    for table in (t.table().to_pylist() for t in (*found, *both)):
        for r in table:
            got.setdefault(r["id"], []).append((-r["similarity"], r["neighbor_id"]))
    same({i: [(j, -s) for s, j in sorted(p)[:5]] for i, p in got.items()}, expected)


def test_a_label_listed_twice_counts_as_in_whole_products(monkeypatch):
    """Repeated items have each label twice; such rows are not screened."""
    monkeypatch.setattr(tiles, "SLICE_ROWS", 64)
    monkeypatch.setattr(tiles, "SEED_COLUMNS", 16)
    rows = [(i, numeric, sorted(labels * 2) if i % 7 == 0 else labels) for i, numeric, labels in random_rows(150, 17)]
    whole = block(rows)
    plain, best = tiles.Best(whole.ids, 4), tiles.Best(whole.ids, 4)
    for r, c, product in tiles.products(whole, whole):
        tiles.mask_self(product, whole.ids[r], whole.ids[c])
        plain.add(r, product, whole.ids[c])
    tiles.fill(whole, whole, best)
    assert best.table() == plain.table()


def test_few_products_in_double_precision(monkeypatch):
    """Where lists are full only pairs that may reach one are computed as they are kept."""
    monkeypatch.setattr(tiles, "SLICE_ROWS", 64)
    rows = random_rows(512, 15)
    halves = block(rows[:256], [0.95] * 256), block(rows[256:], [0.95] * 256)
    counted = []
    checked = tiles.Screen.cosines
    monkeypatch.setattr(tiles.Screen, "cosines", lambda self, i, j: counted.append(len(i)) or checked(self, i, j))
    monkeypatch.setattr(tiles, "_product", lambda *_: pytest.fail("a whole slice was computed"))
    best = [tiles.Best(b.ids, 3, b.bar) for b in halves]
    tiles.fill(*halves, *best, others_only=False)
    assert 0 < sum(counted) < 256 * 256 / 16
    ids, cosine = matrix(sorted(rows[:256]) + sorted(rows[256:]), 12)
    for r in best[0].table().to_pylist():
        i, j = (int(np.flatnonzero(ids == r[c])[0]) for c in ("id", "neighbor_id"))
        assert r["similarity"] == pytest.approx(cosine[i, j], abs=1e-9) and cosine[i, j] >= 0.95
    assert len(best[0].table()) == np.minimum((cosine[:256, 256:] >= 0.95).sum(axis=1), 3).sum()


def test_plain_blocks_where_cells_leave_out_little(spark, monkeypatch):
    """Directions without order: every cell needs every other, and plain blocks take fewer copies."""
    monkeypatch.setattr(sim, "CELL_ROWS", 10)
    monkeypatch.setattr(sim, "block_count", lambda *_: 4)
    rng = np.random.default_rng(16)
    rows = [(i, [float(x) for x in rng.normal(size=16)], []) for i in range(300)]
    every = sim.all_pairs_cosine(frame(spark, rows)).filter("similarity >= 0.2").collect()
    monkeypatch.setattr(pivots, "between_tiles", lambda *_, **__: pytest.fail("a copy for each cell"))
    report = {}
    same(got_top(sim.topk_neighbors(frame(spark, rows), 5, report)), expected_top(rows, 0, 5))
    assert report["tiles"] == 10 and report["rows_sent"] < 8 * len(rows)
    assert sorted(every) == sorted(sim.all_pairs_cosine(frame(spark, rows), min_similarity=0.2).collect())


def test_runs_of_pairs_come_in_one_direction_and_then_the_other():
    """What writes the matrix meets each run of values again within a few hundred bytes."""
    sides, tables = [], []
    for side, (rows, first) in enumerate(((40, 0), (37, 100))):
        unit = np.random.default_rng(side).normal(size=(rows, 3))
        unit /= np.linalg.norm(unit, axis=1)[:, None]
        tables.append(
            pa.table(
                {
                    "id": np.arange(first, first + rows),
                    "unit": pa.array(unit.tolist(), pa.list_(pa.float64())),
                    "labels": pa.array([[]] * rows, pa.list_(pa.int32())),
                    "label_weight": np.ones(rows),
                    "side": np.full(rows, side),
                }
            )
        )
        sides.append(unit)
    expected = np.round(sides[0] @ sides[1].T, 10)
    for bound in (None, 0.2):
        batches = list(sim._tile_pairs(False, bound)(iter(pa.concat_tables(tables).combine_chunks().to_batches())))
        got = pa.Table.from_batches(batches).to_pydict()
        pairs = list(zip(got["id"], got["neighbor_id"]))
        wanted = [(i, 100 + j) for i, j in zip(*np.nonzero(expected >= (-2 if bound is None else bound)))]
        assert sorted(pairs) == sorted(wanted + [(b, a) for a, b in wanted])
        values = dict(zip(pairs, got["similarity"]))
        assert all(abs(values[a, b] - expected[a, b - 100]) < 1e-9 and values[a, b] == values[b, a] for a, b in wanted)
        place = {pair: i for i, pair in enumerate(pairs)}
        assert max(abs(place[a, b] - place[b, a]) for a, b in wanted) <= 37


@pytest.mark.parametrize("keep_self", [True, False])
def test_files_of_the_full_matrix_hold_one_band_of_values(spark, monkeypatch, tmp_path, keep_self):
    """What writes a task's pairs meets few different values; no pair is lost or given twice."""
    monkeypatch.setattr(sim, "BANDED_ROWS", 60, raising=False)
    monkeypatch.setattr(sim, "BAND_PAIRS", 128, raising=False)
    monkeypatch.setattr(tiles, "SLICE_ROWS", 16)
    rows = random_rows(150, 17, width=2)
    rows += [(5000 + i, [x, 0.0], []) for i, x in enumerate((1.0, -1.0, 0.0))]  # cosines at -1, 0 and 1
    rows += [(5010, [0.5, 0.75**0.5], []), (5011, [-0.5, 0.75**0.5], [])]  # and at the edge of a band
    path = str(tmp_path / "pairs")
    sim.all_pairs_cosine(frame(spark, rows), include_self=keep_self).write.parquet(path)
    ids, cosine = matrix(rows, 12)
    expected = {(i, j): cosine[r, c] for r, i in enumerate(ids) for c, j in enumerate(ids) if keep_self or i != j}
    found = spark.read.parquet(path).withColumn("file", F.input_file_name()).collect()
    assert len(found) == len(expected)
    assert {(r.id, r.neighbor_id): r.similarity for r in found} == pytest.approx(expected, abs=1e-9)
    values = {}
    for r in found:
        values.setdefault(r.file, []).append(r.similarity)
    assert all(max(v) - min(v) <= 0.125 + 1e-9 or max(v) < -0.49 for v in values.values())


def listed_rows(n, seed, sets=4, labels=40):
    """Items near each other in numbers of all sizes, with one of a few sets of labels or a larger one."""
    rng = np.random.default_rng(seed)
    kinds = [sorted(int(x) for x in rng.choice(labels, size, replace=False)) for size in rng.integers(1, 5, sets)]
    kinds += [[], kinds[0][:1]]
    spots = rng.normal(size=(n // 16, 3)) * 2.0 ** rng.integers(-3, 9, n // 16)[:, None]
    spot = rng.integers(len(spots), size=n)
    numbers = spots[spot] * (1 + rng.normal(size=(n, 3)) * 10.0 ** -rng.integers(1, 5, n)[:, None])
    chosen = [kinds[j % len(kinds)] + [int(labels + j % 3)] * int(more) for j, more in zip(spot, rng.integers(0, 2, n))]
    return [(int(i) * 3 + 1, [float(x) for x in numbers[i]], chosen[i]) for i in range(n)], labels + 3


@pytest.mark.parametrize("seed, least, block_rows", [(18, 5, 16), (19, 40, 1000), (20, 10_000, 50)])
def test_items_meet_by_the_labels_they_share(spark, monkeypatch, seed, least, block_rows):
    """The lists that a bar leaves hold all neighbours, whatever the sizes and the sets of labels."""
    from shelfkin.operators import postings

    monkeypatch.setattr(sim, "LISTED_ROWS", 1)
    monkeypatch.setattr(sim, "LISTED_SHARE", 1)
    monkeypatch.setattr(sim, "FURTHER_SHARE", 0)  # keep to it, though there are few items
    monkeypatch.setattr(postings, "SEED_ROWS", least)
    monkeypatch.setattr(postings, "BLOCK_ROWS", block_rows)
    for other in ("_pivots", "_square_tiles"):
        monkeypatch.setattr(sim, other, lambda *_: pytest.fail("not by labels"))
    plans, kinds, asked = [], set(), postings.asked

    def noted(*args):
        plans.append(asked(*args))
        kinds.update((len(plans), r.kind, r.light > 0) for r in plans[-1].questions.collect())
        return plans[-1]

    monkeypatch.setattr(postings, "asked", noted)
    rows, labels = listed_rows(400, seed)
    rows += [(9001, [0.0, 0.0, 0.0], []), (9002, [0.0, 0.0, 0.0], [])]
    same(got_top(sim.topk_neighbors(frame(spark, rows), 3)), expected_top(rows, labels, 3))
    assert len(plans) == 2 and (least > len(rows)) != ((1, postings.SAME, False) in kinds and (2, postings.LABEL, True) in kinds)
    assert {(2, postings.LABEL, False), (2, postings.ALL, False)} <= kinds, kinds


def test_labels_alone_do_not_place_copies_of_an_id(spark, monkeypatch):
    """Repeated ids and labels, and items without labels, are left to the other ways."""
    monkeypatch.setattr(sim, "LISTED_ROWS", 1, raising=False)
    rows, labels = listed_rows(60, 21)
    units = sim.l2_normalize(frame(spark, rows))
    for more in ([rows[0]], [(9001, [1.0, 0.0, 0.0], [3, 3])]):
        assert sim._topk_by_labels(sim.l2_normalize(frame(spark, rows + more)), len(rows) + 1, 6000, 5, None) is None
    assert sim._topk_by_labels(units.withColumn("labels", F.array().cast("array<int>")), len(rows), 6000, 5, None) is None

"""Fitting and applying item features."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfkin.operators import features as feat

SCHEMA = (
    "id bigint, title string, tags array<string>, genres array<string>, popularity bigint, "
    "chapters bigint, volumes bigint, averageScore bigint, meanScore bigint, favourites bigint, "
    "startDate timestamp_ntz, has_end_date int, description string"
)
DAY = dt.datetime(2001, 2, 1)


def item(i, tags=("x",), genres=("G",), popularity=10, chapters=5, score=80, start=DAY, end=1):
    return (i, None, list(tags), list(genres) if genres is not None else None, popularity,
            chapters, -1, score, None, None, start, end, None)


def catalogue(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA).repartition(3)


def test_incomplete_rows_are_dropped(spark):
    df = catalogue(spark, item(1, tags=[]), item(2, score=None), item(3, start=None), item(4, genres=None))
    assert [r.id for r in feat.prepare_items(df).collect()] == [1]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 1.0), (3, None)], "id int, x double")
    assert [r.id for r in feat.drop_incomplete(df).collect()] == [2]


def test_vocabulary_order_and_kinds(spark):
    df = catalogue(
        spark, item(1, ["b", "a", "a"], ["Drama"]), item(2, ["drama", "é", "Z"], ["b", "Action"])
    )
    got = [(r.kind, r.term) for r in feat.fit_vocab(feat.prepare_items(df)).orderBy("index").collect()]
    tags = [("tags", t) for t in ("Z", "a", "b", "drama", "é")]
    assert got == tags + [("genres", g) for g in ("Action", "Drama", "b")]


def test_vocabulary_is_ranked_in_order(spark):
    words = [f"{a}{b}" for a in "abcdé" for b in range(40)]
    df = catalogue(spark, *[item(i, words[i : i + 9], [words[i][0]]) for i in range(190)])
    ranked = feat.fit_vocab(feat.prepare_items(df)).orderBy("index").collect()
    used = {w for i in range(190) for w in words[i : i + 9]}
    expected = [("tags", t) for t in sorted(used)] + [("genres", g) for g in "abcdé"]
    assert [(r.kind, r.term) for r in ranked] == expected
    assert [r["index"] for r in ranked] == list(range(len(expected)))


def test_multi_hot(spark):
    fitted = feat.fit_vocab(feat.prepare_items(catalogue(spark, item(1, ["b", "a"], ["a", "c"]))))
    df = catalogue(spark, item(1, ["b", "b"], ["c"]), item(2, [], []), item(3, ["new"], ["a"]))
    got = {r.id: list(r.labels) for r in feat.multi_hot(feat.prepare_items(df), fitted).collect()}
    assert got == {1: [1, 3], 2: [], 3: [2]}


def test_scaler_uses_population_deviation(spark):
    df = catalogue(spark, item(1, score=1), item(2, score=2), item(3, score=4))
    prepared = feat.prepare_items(df)
    scaled = feat.apply_scaler(prepared, feat.fit_scaler(prepared))
    got = {r.id: (r.averageScore, r.popularity) for r in scaled.collect()}
    assert [got[i][0] for i in (1, 2, 3)] == pytest.approx([-1.0690450, -0.2672612, 1.3363062])
    assert [got[i][1] for i in (1, 2, 3)] == [0.0, 0.0, 0.0]


def test_item_features_against_numpy(spark):
    rng = np.random.default_rng(3)
    rows = [
        item(i, [f"t{j}" for j in rng.integers(0, 9, 4)], [f"g{rng.integers(0, 3)}"],
             int(rng.integers(0, 1000)), int(rng.integers(-1, 50)), int(rng.integers(1, 100)),
             dt.datetime(int(rng.integers(1980, 2020)), 1, 1), int(rng.integers(0, 2)))
        for i in range(60)
    ]
    features, params = feat.item_features(catalogue(spark, *rows))
    got = {r.id: r for r in features.collect()}
    raw = np.array(
        [[np.log1p(r[4]), np.log1p(max(r[5], 0)), r[7], r[10].year] for r in rows], dtype=float
    )
    scaled = (raw - raw.mean(axis=0)) / raw.std(axis=0)
    vocab = {(r.kind, r.term): r["index"] for r in params.vocab.collect()}
    for i, r in enumerate(rows):
        expected = [scaled[i, 0], scaled[i, 1], scaled[i, 2], float(r[11]), scaled[i, 3]]
        assert list(got[i].numeric) == pytest.approx(expected)
        labels = {vocab["tags", t] for t in r[2]} | {vocab["genres", g] for g in r[3]}
        assert list(got[i].labels) == sorted(labels)


def test_new_items_are_scored_with_frozen_parameters(spark):
    params = feat.fit_item_features(catalogue(spark, item(1, score=1), item(2, score=3)))
    (row,) = feat.transform_item_features(catalogue(spark, item(9, ["x", "unseen"], score=5)), params).collect()
    assert row.numeric[2] == pytest.approx(3.0) and list(row.labels) == [0, 1]


def test_user_features(spark):
    schema = "userId bigint, status string, score double, progress double, mediaId bigint, createdAt timestamp_ntz"
    df = spark.createDataFrame(
        [(1, "CURRENT", 5.0, None, 7, DAY), (1, "REPEATING", 5.0, None, 8, DAY)], schema
    )
    got = feat.user_features(df).orderBy("mediaId").collect()
    assert got[0].interaction_strength == pytest.approx(0.4)
    assert got[1].status is None and got[1].interaction_strength is None
    assert feat.user_features(df).columns == ["userId", "status", "score", "mediaId", "interaction_strength"]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "clean")
    catalogue(spark, item(1), item(2)).write.parquet(path)
    plan = feat.prepare_items(spark.read.parquet(path))._jdf.queryExecution().toString()
    assert "IsNotNull(popularity)" in plan.split("PushedFilters")[1]
    assert "description" not in plan.split("ReadSchema")[1]

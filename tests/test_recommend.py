"""Batch recommendation."""

import json

import pytest
from pyspark.sql import functions as F

from shelfkin.operators import recommend
from shelfkin.operators import similarity as sim

ITEMS = [
    (1, "alpha", "First.", ["x"]),
    (2, "beta", "Second.", ["x", "y"]),
    (3, "gamma", None, []),
    (4, "alpha", "Again.", ["z"]),
    (5, "delta", "No features.", []),
]
VECTORS = [(1, [1.0, 0.0], []), (2, [1.0, 0.1], []), (3, [-1.0, 0.2], []), (4, [0.5, 0.5], [])]


@pytest.fixture(scope="module")
def tables(spark):
    metadata = spark.createDataFrame(
        ITEMS, "id bigint, title string, description string, tags array<string>"
    )
    features = spark.createDataFrame(VECTORS, "id bigint, numeric array<double>, labels array<int>")
    return metadata, features, sim.topk_neighbors(features, 2)


def requests(spark, *rows):
    return spark.createDataFrame(list(rows), "request_id bigint, title string, top_n int")


def test_exact_answers(spark, tables):
    metadata, _, neighbors = tables
    asked = requests(spark, (1, "ALPHA", 1), (2, "nothing", 3), (3, "delta", 2), (4, "gamma", None))
    rows = recommend.recommend_exact(asked, neighbors, metadata).collect()
    got = [(r.request_id, r.status, r["rank"], r.id, r.title, r.similarity) for r in rows]
    assert got == [
        (1, "ok", 1, 2, "beta", 1.0),
        (2, "title_not_found", None, None, None, None),
        (3, "not_in_model", None, None, None, None),
        (4, "ok", 1, 4, "alpha", -0.55),
        (4, "ok", 2, 2, "beta", -0.96),
    ]
    assert rows[0].description == "Second." and rows[0].tags == ["x", "y"]


def test_self_is_never_recommended(spark, tables):
    metadata, features, _ = tables
    every = sim.topk_neighbors(features, 10)
    rows = recommend.recommend_exact(requests(spark, (1, "gamma", 10)), every, metadata).collect()
    assert len(rows) == 3 and all(r.id != 3 for r in rows)


def test_fuzzy_answers(spark, tables):
    metadata, _, neighbors = tables
    asked = requests(spark, (1, "alpa", 2), (2, "BETA", 2), (3, "delt", 2))
    rows = recommend.recommend_fuzzy(asked, neighbors, metadata).collect()
    assert [(r.request_id, r.status, r.id) for r in rows] == [
        (1, "ok", 2), (1, "ok", 4), (2, "title_not_found", None), (3, "not_in_model", None)
    ]


def test_top_n_below_one_is_refused(spark, tables):
    metadata, _, neighbors = tables
    with pytest.raises(Exception, match="top_n"):
        recommend.recommend_exact(requests(spark, (1, "alpha", 0)), neighbors, metadata).collect()


def test_more_than_the_model_stores(spark, tables):
    _, features, neighbors = tables
    matched = requests(spark, (1, "alpha", 3), (2, "beta", 1)).withColumn("matched_id", F.col("request_id"))
    served = recommend.extend_neighbors(matched, neighbors, features, 2)
    rows = recommend.top_n(recommend.neighbors_of(matched, served)).collect()
    assert sorted((r.request_id, r["rank"], r.id) for r in rows) == [(1, 1, 2), (1, 2, 4), (1, 3, 3), (2, 1, 1)]
    shallow = matched.withColumn("top_n", F.lit(2))
    same = recommend.extend_neighbors(shallow, neighbors, features, 2)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, neighbors.collect()))


def test_records(spark, tables):
    metadata, _, neighbors = tables
    answers = recommend.recommend_exact(requests(spark, (1, "alpha", 2), (2, "nope", 2)), neighbors, metadata)
    (row,) = recommend.to_records(answers).collect()
    records = json.loads(row.recommendations)
    assert row.request_id == 1 and [r["id"] for r in records] == [2, 4]
    assert list(records[0]) == ["id", "title", "description", "tags", "similarity"]


def test_many_requests_for_one_item(spark, tables):
    metadata, _, neighbors = tables
    asked = requests(spark, *[(i, "alpha" if i % 3 else "beta", 2) for i in range(300)])
    rows = recommend.recommend_exact(asked, neighbors, metadata).collect()
    assert len(rows) == 600 and {(r.request_id, r["rank"]) for r in rows} == {
        (i, k) for i in range(300) for k in (1, 2)
    }

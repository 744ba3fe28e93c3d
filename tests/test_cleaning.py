"""Item and interaction cleaning, and the frame helpers below them."""

import pytest
from pyspark.sql import functions as F

from shelfkin import schemas
from shelfkin.operators import frames, interactions, items


def test_adult_flag_unknown_is_kept(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, isAdult boolean")
    assert sorted(r.id for r in items.drop_adult(df).collect()) == [2, 3]


def test_sentinel(spark):
    df = spark.createDataFrame([(None, 0), (3, None)], "chapters bigint, volumes bigint")
    assert [tuple(r) for r in items.fill_sentinel(df).collect()] == [(-1, 0), (3, -1)]


def test_drop_columns_fails_on_unknown_name(spark):
    with pytest.raises(KeyError):
        frames.drop_columns(spark.range(1), "nope")


def test_conform_schema_adds_and_removes(spark):
    df = spark.createDataFrame([("1", "z")], "userId string, z string")
    out = frames.conform_schema(df, schemas.RAW_INTERACTION)
    assert out.columns == schemas.RAW_INTERACTION.names
    assert out.first().progress is None


def test_clean_interactions(spark):
    rows = [
        ("1.9", "current", "5", "2.0", "7", "0"),
        ("-1.9", None, "x", None, "7", "1700000000"),
        ("abc", "current", "5", None, "1", "0"),
        ("1", "current", "5", None, None, "0"),
        ("1.9", "current", "5", "2.0", "7", "0"),
    ]
    schema = "userId string, status string, score string, progress string, mediaId string, createdAt string"
    got = interactions.clean_interactions(spark.createDataFrame(rows, schema)).collect()
    kept = sorted((r.userId, r.status or "", r.score or -1.0, r.mediaId) for r in got)
    assert kept == [(-1, "", -1.0, 7), (1, "CURRENT", 5.0, 7), (1, "CURRENT", 5.0, 7)]


def test_infinite_key_is_an_error(spark):
    df = spark.createDataFrame([("inf", "1")], "userId string, mediaId string")
    with pytest.raises(Exception, match="OVERFLOW"):
        interactions.clean_interactions(df).collect()


def test_clean_items_from_json(spark, tmp_path):
    from shelfkin.sources.landing import scan_json

    path = tmp_path / "items.json"
    path.write_text(
        '[{"id": 1, "title": {"english": "One"}, "tags": [{"name": "Tag"}], "genres": ["G"],'
        ' "popularity": 5, "startDate": {"month": 2, "year": 2001}, "endDate": {"year": null},'
        ' "isAdult": null, "description": "A<br>B"},'
        ' {"id": 2, "title": "Two", "tags": "Solo", "isAdult": true}]',
        encoding="utf-8-sig",
    )
    cleaned = items.clean_items(scan_json(spark, str(path), schemas.RAW_ITEM))
    assert "endDate" not in cleaned.columns and "isAdult" not in cleaned.columns
    (row,) = cleaned.collect()
    assert (row.id, row.title, row.tags, row.chapters, row.has_end_date) == (1, "one", ["tag"], -1, 0)
    assert row.description == "A B"


def test_cleaning_twice_changes_nothing(spark):
    df = spark.createDataFrame([(None, 2)], "chapters bigint, volumes bigint")
    once = items.fill_sentinel(df)
    assert once.collect() == items.fill_sentinel(once).collect()


def test_lookup_join_spreads_a_hot_key(spark):
    """A third of the rows share one key and another third has none; no partition gets all."""
    n = 3000
    left = spark.range(n).select(
        F.col("id").alias("rid"),
        F.when(F.col("id") % 3 == 0, F.lit(0))
        .when(F.col("id") % 3 == 1, F.lit(None).cast("int"))
        .otherwise((F.col("id") % 500).cast("int"))
        .alias("k"),
    )
    right = spark.range(600).select(F.col("id").cast("int").alias("rk"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = frames.lookup_join(left, right, "k", "rk", ["rid"])
        rows = out.withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(rows) == n and len({r.rid for r in rows}) == n
    assert all((r.v is None) == (r.k is None) and (r.k is None or r.v == r.k) for r in rows)
    hot = [r.p for r in rows if r.k == 0]
    missing = [r.p for r in rows if r.k is None]
    for group in (hot, missing):
        assert len(set(group)) >= 4 and max(map(group.count, set(group))) < 0.6 * len(group)


def test_first_rows_is_exact_under_skew(spark):
    rows = [(1, i) for i in range(1000)] + [(2, i) for i in range(3)] + [(None, 5)]
    df = spark.createDataFrame(rows, "k int, pos int").repartition(5)
    kept = frames.first_rows(df, "k", [F.col("pos")], ["pos"], 40).collect()
    assert sorted(r.pos for r in kept if r.k == 1) == list(range(40))
    assert sorted(r.pos for r in kept if r.k == 2) == [0, 1, 2]


def test_hot_keys(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 3 == 1, F.lit(None))
        .otherwise(F.col("id").cast("string"))
        .alias("k")
    )
    assert sorted(frames.hot_keys(df, "k"), key=str) == [None, "hot"]
    assert frames.hot_keys(spark.range(5000), "id") == []
    assert frames.hot_keys(spark.range(0), "id") == []


def test_hot_keys_below_a_hundredth(spark):
    """The bar is what a partition holds on average, not a fixed share."""
    n = 100_000
    df = spark.range(n).select(F.when(F.col("id") % 111 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    try:
        assert frames.hot_keys(df, "k") == [-1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lookup_join_without_hot_keys_is_plain(spark):
    left, right = spark.range(1000), spark.range(500).withColumnRenamed("id", "k").withColumn("v", F.lit(1))
    out = frames.lookup_join(left, right, "id", "k", ["id"])
    assert out.columns == ["id", "v"] and out.filter("v = 1").count() == 500
    assert "left_salt" not in out._jdf.queryExecution().toString()

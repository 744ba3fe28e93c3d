"""Landing, snapshots, run records and the jobs built from them."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from shelfkin import schemas
from shelfkin.plans import jobs
from shelfkin.sources import landing, metrics
from shelfkin.sources import snapshots as snap

DAY1, DAY2 = dt.date(2024, 1, 9), dt.date(2024, 1, 10)


def test_source_thresholds_are_strict(spark):
    df = spark.createDataFrame(
        [(1, 70, 10_001), (2, 71, 10_001), (3, 71, 10_000)],
        "id int, averageScore bigint, popularity bigint",
    )
    assert [r.id for r in landing.source_filter_items(df, 70, 10_000).collect()] == [2]


def test_user_range_is_inclusive(spark):
    df = spark.range(10).withColumnRenamed("id", "userId")
    assert [r.userId for r in landing.source_filter_users(df, 3, 5).collect()] == [3, 4, 5]


def test_cap_per_user(spark):
    rows = [(1, p, i) for p in range(1, 6) for i in range(4)] + [(2, 1, 0)]
    df = spark.createDataFrame(rows, "userId int, page int, pos int").repartition(4)
    kept = landing.cap_per_user(df, max_pages=2, per_page=4).collect()
    assert sorted(map(tuple, kept)) == [(1, p, i) for p in (1, 2) for i in range(4)] + [(2, 1, 0)]


def test_pages_keep_repeated_rows_and_errors_give_none(spark, tmp_path):
    read = {"userId": 1, "status": "CURRENT", "score": 5, "mediaId": 2}
    lines = [
        {"userId": 1, "page": 1, "data": {"Page": {"mediaList": [read, read]}}},
        {"userId": 2, "page": 1, "data": {"Page": {"mediaList": [read]}}},
        {"userId": 2, "page": 2, "errors": [{"message": "private user"}]},
        {"userId": 3, "page": 1, "errors": [{"message": "internal server error"}]},
    ]
    path = tmp_path / "responses.json"
    path.write_text("\n".join(map(json.dumps, lines)))
    responses = landing.scan_json(spark, str(path), schemas.INTERACTION_RESPONSE, lines=True)
    rows = landing.flatten_pages(
        landing.response_rows(responses), "data.Page.mediaList", keep=("page",)
    )
    assert rows.count() == 3 and set(rows.columns) >= {"page", "mediaId", "createdAt"}
    assert sorted(r.userId for r in landing.skipped_users(responses).collect()) == [2, 3]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        snap.read_latest(spark, root, snap.RAW, "a")
    for day, n in ((DAY1, 3), (DAY2, 5), (DAY2, 7)):
        snap.write_snapshot(spark.range(n), root, snap.RAW, "a", day)
    snap.write_snapshot(spark.range(1), root, snap.RAW, "other", dt.date(2030, 1, 1))
    assert snap.latest_date(spark, root, snap.RAW, "a") == DAY2
    assert snap.read_latest(spark, root, snap.RAW, "a").count() == 7
    assert snap.read_snapshot(spark, root, snap.RAW, "a", DAY1).count() == 3


def test_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "é漢\n\"q\""), (2, None)], "id bigint, text string")
    snap.write_json(df, str(tmp_path / "j"))
    back = landing.scan_json(spark, str(tmp_path / "j"), df.schema, lines=True)
    assert sorted(back.collect()) == sorted(df.collect())


class Session:
    """What `shared_folder` asks a session for."""

    def __init__(self, master, folder):
        self.sparkContext, self.conf = self, self
        self.master, self.folder = master, folder

    def get(self, key, default):
        return self.folder or default


def test_shared_folder_is_the_one_the_session_names():
    for master in ("yarn", "local[2]"):
        session = Session(master, "hdfs://shared/")
        folders = {snap.shared_folder(session) for _ in range(2)}
        assert len(folders) == 2 and all(f.startswith("hdfs://shared/shelfkin-") for f in folders)


@pytest.mark.parametrize("master", ["yarn", "local-cluster[2,1,1024]"])
def test_no_local_folder_on_a_cluster(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        snap.shared_folder(Session(master, None))


def test_temporary_tables_are_removed(spark):
    with snap.temporary_tables(spark):
        inside = snap.stored(spark.range(3))
        (path,) = {f.rsplit("/", 2)[0] for f in inside.inputFiles()}
        assert inside.count() == 3
    outside = snap.stored(spark.range(3))
    assert outside.count() == 3 and not os.path.exists(path.removeprefix("file://"))


def test_an_empty_snapshot_replaces_the_day_and_is_the_latest(spark, tmp_path):
    root, none = str(tmp_path), spark.range(0)
    for day, df in ((DAY1, spark.range(5)), (DAY2, none)):
        snap.write_snapshot(df, root, snap.RAW, "a", day)
    assert snap.latest_date(spark, root, snap.RAW, "a") == DAY2
    latest = snap.read_latest(spark, root, snap.RAW, "a")
    assert latest.columns == ["id"] and latest.count() == 0
    snap.write_snapshot(none, root, snap.RAW, "a", DAY1)
    assert snap.read_snapshot(spark, root, snap.RAW, "a", DAY1).count() == 0


def test_an_unfinished_snapshot_is_passed_over(spark, tmp_path):
    snap.write_snapshot(spark.range(3), str(tmp_path), snap.RAW, "a", DAY1)
    (tmp_path / "raw" / "a" / "dt=2024-01-10").mkdir()
    assert snap.latest_date(spark, str(tmp_path), snap.RAW, "a") == DAY1


def test_malformed_responses_are_kept_in_quarantine(spark, tmp_path):
    path = tmp_path / "responses.json"
    path.write_text('{"userId": 1, "page": 1, "data": {"Page": {"mediaList": []}}}\nnot json\n{"userId": 2\n'
                    '{"userId": 3, "data": {"Page": {"mediaList": []}}}\n')
    responses = landing.scan_json(spark, str(path), schemas.INTERACTION_RESPONSE, lines=True)
    assert [r.userId for r in landing.response_rows(responses).collect()] == [1]
    failed = landing.quarantine(responses).collect()
    assert sorted(str(r.malformed) for r in failed) == ["None", "not json", '{"userId": 2']
    assert [r.userId for r in landing.skipped_users(responses).collect()] == [3]


def test_numbers_written_as_doubles_are_read(spark, tmp_path):
    path = tmp_path / "items.json"
    path.write_text('{"data": {"Page": {"media": [{"id": 1, "averageScore": 85.0, "popularity": 20001}]}}}')
    rows = landing.flatten_pages(
        landing.scan_json(spark, str(path), schemas.ITEM_RESPONSE, lines=True), "data.Page.media"
    )
    kept = landing.whole_numbers(landing.source_filter_items(rows, 70, 20_000), schemas.RAW_ITEM)
    (row,) = kept.collect()
    assert (row.averageScore, row.popularity) == (85, 20_001) and kept.schema["averageScore"].dataType.typeName() == "long"


def test_run_metrics_count_the_id_column(spark):
    vocab = spark.createDataFrame([("tags", "a", 0), ("genres", "b", 1)], "kind string, term string, index int")
    row = metrics.run_metrics(spark.range(4), vocab, 5, "here").first()
    assert (row.num_items, row.num_features, row.model_type, row.feature_store) == (4, 8, "cosine_similarity", "here")


def test_jobs_end_to_end(spark, tmp_path):
    """Landed responses to answers; a second day only adds snapshots."""
    def item(i, **more):
        base = {
            "id": i, "title": {"english": f"Title {i}"}, "tags": [{"name": f"T{i % 3}"}],
            "genres": ["Drama"], "popularity": 20_000 + i, "chapters": i, "averageScore": 71 + i,
            "startDate": {"month": 1, "year": 2000 + i}, "endDate": {"month": 1, "year": 2001},
            "isAdult": False, "description": "D.<br>",
        }
        return {**base, **more}

    items = [item(i) for i in range(1, 9)]
    items += [item(20, isAdult=True), item(21, averageScore=70), item(22, startDate={"month": 0, "year": 0})]
    pages = [{"data": {"Page": {"media": items[:6]}}}, {"data": {"Page": {"media": items[6:]}}},
             {"errors": [{"message": "too many requests"}]}]
    read = {"userId": 1001, "status": "completed", "score": 8, "mediaId": 2, "createdAt": 0}
    reads = [
        {"userId": 1001, "page": 1, "data": {"Page": {"mediaList": [read, {**read, "mediaId": None}]}}},
        {"userId": 1001, "page": 3, "data": {"Page": {"mediaList": [read]}}},
        {"userId": 1002, "page": 1, "errors": [{"message": "private user"}]},
        {"userId": 9999, "page": 1, "data": {"Page": {"mediaList": [read]}}},
    ]
    landed = {}
    for name, lines in (("items", pages), ("reads", reads)):
        landed[name] = str(tmp_path / f"{name}.json")
        (tmp_path / f"{name}.json").write_text("\n".join(map(json.dumps, lines)))
    root = str(tmp_path / "store")
    counts = jobs.run_pipeline(
        spark, root, landed["items"], landed["reads"],
        min_score=70, min_popularity=10_000, users=(1001, 1500), max_pages=2, date=DAY1,
    )
    assert counts["ingest"] == {
        "items": 10, "items_low_score": 1, "items_unpopular": 0, "interactions": 2, "pages_over_cap": 1,
        "skipped_users": 1, "quarantined_items": 1, "quarantined_interactions": 1,
    }
    assert counts["clean"] == {"items": 9, "interactions": 1}
    assert counts["features"]["item_features"] == 8 and counts["features"]["user_features"] == 1
    assert jobs.train(spark, root, k=2, date=DAY1) == {"neighbors": 16}
    jobs.train(spark, root, k=2, date=DAY1)
    (metrics_row,) = metrics.read_runs(spark, f"{root}/models/run_metrics").collect()
    assert metrics_row.num_items == 8 and metrics_row.num_features == 1 + 5 + 4
    asked = spark.createDataFrame(
        [(1, "titl 3", 2), (2, "title 4", 7), (3, "title 22", 1), (4, "unheard of", 1)],
        "request_id bigint, title string, top_n int",
    )
    answers = jobs.recommend_batch(spark, root, asked)
    by_request = {}
    for r in answers.collect():
        by_request.setdefault((r.request_id, r.status), []).append(r.id)
    assert {k: len(v) for k, v in by_request.items()} == {
        (1, "ok"): 2, (2, "ok"): 7, (3, "not_in_model"): 1, (4, "title_not_found"): 1
    }
    assert sorted(by_request[2, "ok"]) == [1, 2, 3, 5, 6, 7, 8]
    exact = jobs.recommend_batch(spark, root, asked, fuzzy=False)
    assert [r.status for r in exact.filter(F.col("request_id") == 1).collect()] == ["title_not_found"]
    ledger = metrics.read_ledger(spark, f"{root}/ledger", DAY1.isoformat())
    counted = {(r.stage, r.dataset): (r.rows_in, r.rows_out, r.rejected) for r in ledger.collect()}
    assert ledger.count() == len(counted) == 15
    assert counted["ingest", "items"] == (11, 10, 1) and counted["ingest", "skipped_users"] == (None, 1, None)
    assert counted["clean", "items"] == (10, 9, 1) and counted["clean", "interactions"] == (2, 1, 1)
    assert counted["features", "item_features"] == (9, 8, 1) and counted["train", "neighbors"][:2] == (8, 16)
    # Features made anew, with other items, do not meet the neighbours of the old ones.
    (tmp_path / "items.json").write_text(json.dumps({"data": {"Page": {"media": items[4:6]}}}))
    jobs.run_pipeline(
        spark, root, landed["items"], landed["reads"],
        min_score=70, min_popularity=10_000, users=(1001, 1500), max_pages=2, date=DAY2,
    )
    before = {(r.request_id, r.id) for r in answers.collect()}
    assert {(r.request_id, r.id) for r in jobs.recommend_batch(spark, root, asked).collect()} == before
    jobs.train(spark, root, k=2, date=DAY2)
    after = jobs.recommend_batch(spark, root, asked).collect()
    assert {r.id for r in after if r.status == "ok"} <= {5, 6}


def broken(spark):
    """Rows of which some are written before the job fails."""
    fails = F.when(F.col("id") == 99_999, F.raise_error(F.lit("lost"))).otherwise(F.col("id"))
    return spark.range(0, 100_000, 1, 4).select(fails.cast("long").alias("id"))


def test_a_lost_write_leaves_the_day_as_it_was(spark, tmp_path):
    root = str(tmp_path)
    snap.write_snapshot(spark.range(3), root, snap.RAW, "a", DAY1)
    first = snap.write_snapshot(spark.range(5), root, snap.RAW, "a", DAY2)
    reader = snap.read_latest(spark, root, snap.RAW, "a")
    with pytest.raises(Exception, match="lost"):
        snap.write_snapshot(broken(spark), root, snap.RAW, "a", DAY2)
    assert snap.latest(spark, root, snap.RAW, "a") == first
    assert snap.read_latest(spark, root, snap.RAW, "a").count() == 5 and reader.count() == 5
    with pytest.raises(Exception, match="lost"):
        snap.write_snapshot(broken(spark), root, snap.RAW, "a", dt.date(2024, 2, 1))
    assert snap.latest_date(spark, root, snap.RAW, "a") == DAY2


def test_a_replaced_snapshot_stays_readable_until_it_is_removed(spark, tmp_path):
    root = str(tmp_path)
    old = [snap.write_snapshot(spark.range(n), root, snap.RAW, "a", DAY1) for n in (1, 2, 3)]
    assert [snap.read(spark, root, s).count() for s in old] == [1, 2, 3]
    assert snap.read_latest(spark, root, snap.RAW, "a").count() == 3
    assert snap.remove_superseded(spark, root, snap.RAW, "a", keep=[old[1]]) == [old[0]]
    assert [snap.read(spark, root, s).count() for s in old[1:]] == [2, 3]
    assert not os.path.exists(tmp_path / "raw" / "a" / "dt=2024-01-09" / f"run={old[0].run}")


def test_all_days_of_a_dataset(spark, tmp_path):
    root = str(tmp_path)
    for day, n in ((DAY1, 4), (DAY1, 2), (DAY2, 3)):
        snap.write_snapshot(spark.range(n), root, snap.RAW, "a", day)
    rows = snap.read_days(spark, root, snap.RAW, "a").groupBy("dt").count().collect()
    assert {(r.dt, r["count"]) for r in rows} == {(DAY1, 2), (DAY2, 3)}


def test_a_manifest_names_what_belongs_together(spark, tmp_path):
    root = str(tmp_path)
    one = snap.write_snapshot(spark.range(1), root, snap.FEATURES, "x", DAY1)
    two = snap.write_snapshot(spark.range(2), root, snap.MODELS, "y", DAY1)
    snap.write_manifest(spark, root, snap.MODELS, [one, two], DAY1)
    snap.write_snapshot(spark.range(9), root, snap.FEATURES, "x", DAY2)
    named = snap.read_manifest(spark, root, snap.MODELS)
    assert named == {("features", "x"): one, ("models", "y"): two}
    assert snap.read(spark, root, named["features", "x"]).count() == 1


def test_a_repeated_stage_leaves_one_record(spark, tmp_path):
    path = str(tmp_path)
    for rows in ([metrics.StageRows("a", 3, 2, 1)], [metrics.StageRows("a", 5, 5, 0), metrics.StageRows("b", None, 1)]):
        metrics.record_stage(spark, path, "run 1", "clean", rows)
    metrics.record_stage(spark, path, "run 2", "clean", [metrics.StageRows("a", 1, 1, 0)])
    assert sorted(map(tuple, metrics.read_ledger(spark, path, "run 1").collect())) == [
        ("clean", "a", 5, 5, 0), ("clean", "b", None, 1, None)
    ]
    with pytest.raises(ValueError):
        metrics.record_stage(spark, path, "../x", "clean", [])


def test_threads_do_not_remove_each_others_tables(spark):
    from threading import Barrier, Thread

    meet, counts = Barrier(2), {}

    def work(name, stays):
        with snap.temporary_tables(spark):
            table = snap.stored(spark.range(10))
            meet.wait()
            if stays:
                meet.wait()
                counts[name] = table.count()
        if not stays:
            meet.wait()

    threads = [Thread(target=work, args=(i, i == 0)) for i in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert counts == {0: 10}


def test_a_lookup_does_not_move_a_table_in_buckets(spark, tmp_path):
    from shelfkin.operators.frames import lookup_join, lookup_placed

    root = str(tmp_path)
    model = spark.range(2000).selectExpr("id % 500 AS id", "id AS neighbor_id")
    snap.write_snapshot(model, root, snap.MODELS, "m", DAY1, key="id")
    placed = snap.read_latest(spark, root, snap.MODELS, "m").withColumnRenamed("id", "owner")
    assert placed.count() == 2000 and snap.read_latest(spark, root, snap.MODELS, "m").count() == 2000
    asked = snap.stored(
        spark.range(900).selectExpr("id AS request_id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 4 = 0 THEN NULL ELSE id END AS key")
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        even = snap.stored(spark.range(900).selectExpr("id AS request_id", "id AS key"))
        joined = lookup_placed(even, placed, "key", "owner", ["request_id"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        scan = plan[: plan.index("shelfkin_")].splitlines()
        depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
        above, at = [], depth(plan[: plan.index("shelfkin_")].splitlines()[-1])
        for line in reversed(scan):
            if depth(line) < at:
                above.append(line)
                at = depth(line)
        join = next(i for i, line in enumerate(above) if "Join" in line)
        assert not any("Exchange" in line for line in above[:join]) and "Bucketed: true" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for rows in (even, asked):
        mine = lookup_placed(rows, placed, "key", "owner", ["request_id"]).collect()
        theirs = lookup_join(rows, model.withColumnRenamed("id", "owner"), "key", "owner", ["request_id"]).collect()
        assert sorted(map(str, mine)) == sorted(map(str, theirs))


def test_deep_and_shallow_requests_of_one_batch(spark, tmp_path):
    """Requests for more than the model stores, for unknown items, and for an item alone."""
    from shelfkin.operators import recommend, similarity

    features = spark.createDataFrame(
        [(i, [1.0, float(i)], []) for i in range(1, 8)], "id bigint, numeric array<double>, labels array<int>"
    )
    metadata = features.selectExpr("id", "concat('t', id) AS title", "'d' AS description", "array('x') AS tags")
    neighbors = similarity.topk_neighbors(features, 2)
    snap.write_snapshot(neighbors, str(tmp_path), snap.MODELS, "m", DAY1, key="id")
    model = snap.read_latest(spark, str(tmp_path), snap.MODELS, "m")
    asked = spark.createDataFrame(
        [(1, "t1", 5, 1), (2, "t2", 1, 2), (3, "t9", 9, 9), (4, "?", 2, None), (5, "t1", 1, 1), (6, "t3", 90, 3)],
        "request_id bigint, title string, top_n int, matched_id bigint",
    )
    mine = recommend.answer_placed(asked, model, metadata, features, 2).collect()
    served = recommend.extend_neighbors(asked, neighbors, features, 2)
    assert sorted(map(str, mine)) == sorted(map(str, recommend.answer(asked, served, metadata, features).collect()))
    assert sum(r.request_id == 6 for r in mine) == 6 and sum(r.request_id == 1 for r in mine) == 5

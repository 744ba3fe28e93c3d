"""The registered queries and the pipeline, on the smallest tables and on odd rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from check import TABLES, rows
from shelfkin.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry_points.queries())


@here
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.execute(ORACLES[name]).df())


@here
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_a_row_for_each_document(spark, name):
    got = QUERIES[name](spark, SF)
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


@pytest.fixture
def folder(spark, tmp_path):
    """A table folder with hostile rows."""
    item = "Anna has 12 apples and gives 5 of them to Peter every day, how many are left after 3 days?"
    clean = [" ".join(f"w{(i * 37 + j * j) % 501}" for j in range(60)) for i in range(40)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(clean)]
    docs += [(100 + i, f"gorf blarg {t} gorf", "en", "s", 5) for i, t in enumerate(clean[:20])]
    docs += [(200, clean[3], "en", "s", 1), (201, clean[4] + "\nextra", "en", "s", 1)]
    docs += [(300, f"Read this. {item}", "en", "s", 9), (301, "", None, None, None), (302, None, "en", "s", 0)]
    docs += [(None, "nameless text", "en", "s", 3), (5, clean[5], "en", "s", 1), (303, "é" * 20_000, "fr", "s", 2)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(d[0], 1, int(100 <= d[0] < 200)) for d in docs if d[0] is not None and d[0] < 200]
    labels += [(0, 1, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    bench = spark.createDataFrame([(1, item), (2, None)], "item_id bigint, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids, columns = {}, docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{i}")
        docs = spark.read.parquet(f"{folder}/stage{i}")
        assert docs.columns == columns or i == 4
        ids[name] = [r.doc_id for r in docs.collect()]
    assert not [i for i in ids["toxicity"] if i is not None and 100 <= i < 200]
    assert {*range(40), 200, 201, 300, 301, 302, 303, None} == set(ids["toxicity"])
    lined = {r.doc_id: (r.text, r.n_chars) for r in spark.read.parquet(f"{folder}/stage1").collect()}
    assert 200 not in lined and lined[201] == ("extra", 5) and {301, 302, None, *range(40)} <= set(lined)
    assert ids["simhash_near_dedup"].count(5) == 1 and 301 in ids["simhash_near_dedup"]
    assert 302 not in ids["simhash_near_dedup"] and None in ids["simhash_near_dedup"]
    assert 300 in ids["simhash_near_dedup"] and 300 not in ids["benchmark_decontamination"]
    assert set(ids["sentencepiece"]) == set(ids["benchmark_decontamination"])
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in whole) == sorted(
        (r.doc_id or -1, r.n_tokens) for r in docs.collect()
    )


def test_empty_tables(spark, folder, tmp_path_factory):
    empty = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").filter("false").write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0

"""Similarity queries, on the embeddings and on the features of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as A
from checks.feature_queries import SQL_PREPARED, SQL_SCALER, SQL_VOCAB, cleaned
from checks.registry import query, table
from shelfkin.operators import features as feat
from shelfkin.operators import similarity as sim
from shelfkin.plans import jobs
from shelfkin.sources import snapshots as snap
from shelfkin.sources.snapshots import stored

TOP_K = 5


def embedding_features(spark, sf):
    """Embeddings as item features without labels."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").cast("array<double>").alias("numeric"),
        F.array().cast("array<int>").alias("labels"),
    )


def part_features(spark, sf):
    features, _ = feat.item_features(stored(cleaned(spark, sf)))
    return stored(features)


# Cosines of the embeddings: the upper triangle, mirrored.
SQL_PAIRS = """vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
triangle AS (
  SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS s
  FROM vectors AS a JOIN vectors AS b ON a.id < b.id
),
pairs AS (
  SELECT x AS id, y AS neighbor_id, s FROM triangle
  UNION ALL SELECT y AS id, x AS neighbor_id, s FROM triangle
)"""

SQL_NEIGHBORS = f"""{SQL_PAIRS},
neighbors AS (
  SELECT id, neighbor_id, s AS similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 10) DESC, neighbor_id) AS rank
    FROM pairs) AS ranked
  WHERE rank <= {TOP_K}
)"""


def _rounded(df):
    return df.withColumn("similarity", F.round("similarity", 6) + 0.0)


@query(
    "v1_l2_normalize",
    """SELECT vec_id AS id, position, round(CAST(x AS DOUBLE) / norm, 6) + 0.0 AS x FROM (
      SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS position,
        sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y))) AS norm
      FROM embeddings) AS t""",
)
def l2_normalize(spark, sf):
    units = sim.l2_normalize(embedding_features(spark, sf))
    rows = units.select("id", F.posexplode("unit").alias("position", "x"))
    return rows.select("id", F.col("position").cast("bigint"), (F.round("x", 6) + 0.0).alias("x"))


@query(
    "v2_all_pairs_cosine",
    f"""WITH {SQL_PAIRS} SELECT id, neighbor_id, round(round(s, 10), 6) + 0.0 AS similarity FROM pairs
    UNION ALL SELECT id, id, 1.0 FROM vectors""",
)
def all_pairs_cosine(spark, sf):
    return _rounded(sim.all_pairs_cosine(embedding_features(spark, sf), include_self=True))


@query(
    "v2_similar_pairs",
    f"""WITH {SQL_PAIRS} SELECT id, neighbor_id, round(round(s, 10), 6) + 0.0 AS similarity FROM pairs
    WHERE round(s, 10) >= 0.3""",
)
def similar_pairs(spark, sf):
    """Only the pairs that reach a least similarity leave their task."""
    return _rounded(sim.all_pairs_cosine(embedding_features(spark, sf), min_similarity=0.3))


@query(
    "v3_exclude_self",
    f"WITH {SQL_PAIRS} SELECT id, neighbor_id, round(round(s, 10), 6) + 0.0 AS similarity FROM pairs",
)
def exclude_self(spark, sf):
    return _rounded(sim.all_pairs_cosine(embedding_features(spark, sf)))


@query(
    "v4_similarity_by_id",
    f"""WITH {SQL_PAIRS} SELECT id, neighbor_id, round(round(s, 10), 6) + 0.0 AS similarity FROM pairs
    UNION ALL SELECT id, id, 0.0 FROM vectors""",
)
def similarity_by_id(spark, sf):
    """Every cell of the matrix by its two ids, the diagonal at 0."""
    pairs = sim.all_pairs_cosine(embedding_features(spark, sf), include_self=True)
    return _rounded(sim.with_zero_diagonal(pairs))


WIDE_IDS = (0, 1, 2, 3)


@query(
    "v4_wide_matrix",
    f"""WITH {SQL_PAIRS} SELECT id, """
    + ", ".join(
        f"coalesce(max(CASE WHEN neighbor_id = {i} THEN round(round(s, 10), 6) END), -9.0) + 0.0 AS to_{i}"
        for i in WIDE_IDS
    )
    + " FROM pairs GROUP BY id",
)
def wide_matrix(spark, sf):
    """Some columns of the matrix; the diagonal, which has no pair, is shown as -9."""
    features, ids = embedding_features(spark, sf), list(WIDE_IDS)
    wide = sim.wide_matrix(sim.all_pairs_cosine(features, neighbors=ids), ids, features)
    shown = [F.coalesce(F.round(str(i), 6), F.lit(-9.0)) + 0.0 for i in WIDE_IDS]
    return wide.select("id", *[c.alias(f"to_{i}") for i, c in zip(WIDE_IDS, shown)])


@query(
    "v5_topk_neighbors",
    f"""WITH {SQL_NEIGHBORS}
    SELECT id, neighbor_id, round(round(similarity, 10), 6) + 0.0 AS similarity, rank FROM neighbors""",
)
def topk_neighbors(spark, sf):
    return _rounded(sim.topk_neighbors(embedding_features(spark, sf), TOP_K))


# Cosines of part features: products of the scaled numbers plus the labels in common.
SQL_PART_NEIGHBORS = f"""{SQL_SCALER}, {SQL_VOCAB.split(f"{SQL_PREPARED},", 1)[1]},
dense AS (
  SELECT id, list_concat(
    list_value(popularity, chapters, "averageScore", CAST(has_end_date AS DOUBLE), release_year),
    list_concat(
      list_transform((SELECT list(term ORDER BY term) FROM terms WHERE slot = 0),
        lambda t: CAST(CASE WHEN list_contains(tags, t) THEN 1 ELSE 0 END AS DOUBLE)),
      list_transform((SELECT list(term ORDER BY term) FROM terms WHERE slot = 1),
        lambda t: CAST(CASE WHEN list_contains(genres, t) THEN 1 ELSE 0 END AS DOUBLE)))) AS v
  FROM scaled
),
triangle AS (
  SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS s
  FROM dense AS a JOIN dense AS b ON a.id < b.id
),
pairs AS (
  SELECT x AS id, y AS neighbor_id, s FROM triangle
  UNION ALL SELECT y AS id, x AS neighbor_id, s FROM triangle
),
neighbors AS (
  SELECT id, neighbor_id, s AS similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 10) DESC, neighbor_id) AS rank
    FROM pairs) AS ranked
  WHERE rank <= {TOP_K}
)"""

SQL_PART_RESULT = f"""WITH {SQL_PART_NEIGHBORS}
SELECT id, neighbor_id, round(round(similarity, 10), 6) + 0.0 AS similarity, rank FROM neighbors"""


@query("v5_topk_neighbors_items", SQL_PART_RESULT)
def topk_neighbors_items(spark, sf):
    return _rounded(sim.topk_neighbors(part_features(spark, sf), TOP_K))


@query("v6_train_similarity", SQL_PART_RESULT)
def train_similarity(spark, sf):
    """Clean, features and train as jobs over snapshots; the model read back."""
    root = snap.shared_folder(spark)
    items = snap.write_snapshot(cleaned(spark, sf), root, snap.CLEANED, jobs.ITEMS)
    features, params = feat.item_features(snap.read(spark, root, items))
    written = [
        snap.write_snapshot(df, root, snap.FEATURES, name)
        for df, name in ((features, jobs.ITEM_FEATURES), (params.vocab, jobs.VOCAB))
    ]
    snap.write_manifest(spark, root, snap.FEATURES, [items, *written])
    jobs.train(spark, root, k=TOP_K)
    model = snap.read_manifest(spark, root, snap.MODELS)[snap.MODELS, jobs.NEIGHBORS]
    return _rounded(snap.read(spark, root, model))


@query(
    "s12_run_metrics",
    f"""WITH {SQL_VOCAB}
    SELECT 'cosine_similarity' AS model_type, 'parquet' AS feature_store,
      (SELECT count(*) FROM complete) AS num_items, (SELECT count(*) FROM vocab) + 6 AS num_features""",
)
def run_metrics(spark, sf):
    """The record a training run leaves, made twice and read back."""
    from shelfkin.sources import metrics

    path = f"{snap.shared_folder(spark)}/run_metrics"
    features, params = feat.item_features(stored(cleaned(spark, sf)))
    run = metrics.run_metrics(
        features, params.vocab, len(feat.NUMERIC_COLUMNS), jobs.FEATURE_STORE
    )
    for _ in range(2):
        metrics.record_run(run, path, "run")
    return metrics.read_runs(spark, path).drop("run_id")

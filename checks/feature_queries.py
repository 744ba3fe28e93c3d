"""Feature queries: fit and transform."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as A
from checks.registry import query, table
from shelfkin.functions import numbers
from shelfkin.operators import features as feat
from shelfkin.operators import interactions, items
from shelfkin.sources.snapshots import stored

# Complete items, counts on a log scale; then the vocabulary and the scaler fitted on them.
SQL_PREPARED = f"""{A.SQL_ITEMS},
complete AS (
  SELECT id, tags, genres, has_end_date, year("startDate") AS release_year,
    CAST("averageScore" AS DOUBLE) AS score,
    ln(1 + CAST(popularity AS DOUBLE)) AS log_popularity,
    ln(1 + CAST(CASE WHEN chapters = -1 THEN 0 ELSE chapters END AS DOUBLE)) AS log_chapters
  FROM items
  WHERE genres IS NOT NULL AND "averageScore" IS NOT NULL AND "startDate" IS NOT NULL
)"""

SQL_VOCAB = f"""{SQL_PREPARED},
terms AS (
  SELECT DISTINCT 0 AS slot, term FROM (SELECT unnest(tags) AS term FROM complete) AS t
  UNION ALL
  SELECT DISTINCT 1 AS slot, term FROM (SELECT unnest(genres) AS term FROM complete) AS g
),
vocab AS (
  SELECT CASE slot WHEN 0 THEN 'tags' ELSE 'genres' END AS kind, term,
    row_number() OVER (ORDER BY slot, term) - 1 AS index
  FROM terms
)"""

SQL_SCALER = f"""{SQL_PREPARED},
stats AS (
  SELECT avg(log_popularity) AS m1, stddev_pop(log_popularity) AS s1,
    avg(log_chapters) AS m2, stddev_pop(log_chapters) AS s2,
    avg(score) AS m3, stddev_pop(score) AS s3,
    avg(release_year) AS m4, stddev_pop(release_year) AS s4
  FROM complete
),
scaled AS (
  SELECT id, tags, genres, has_end_date,
    (log_popularity - m1) / CASE WHEN s1 = 0 THEN 1 ELSE s1 END AS popularity,
    (log_chapters - m2) / CASE WHEN s2 = 0 THEN 1 ELSE s2 END AS chapters,
    (score - m3) / CASE WHEN s3 = 0 THEN 1 ELSE s3 END AS "averageScore",
    (release_year - m4) / CASE WHEN s4 = 0 THEN 1 ELSE s4 END AS release_year
  FROM complete CROSS JOIN stats
)"""


def _rounded(*columns: str):
    """Six decimals, without negative zeros."""
    return [(F.round(c, 6) + 0.0).alias(c) for c in columns]


def cleaned(spark, sf):
    return items.clean_items(A.raw_items(spark, sf))


def prepared(spark, sf):
    return feat.prepare_items(cleaned(spark, sf))


@query("f2_drop_incomplete", f"WITH {SQL_PREPARED} SELECT id, len(tags) AS n_tags FROM complete")
def drop_incomplete(spark, sf):
    rows = feat.drop_columns(cleaned(spark, sf), *feat.UNUSED_COLUMNS)
    complete = feat.drop_incomplete(feat.with_release_year(rows))
    return complete.select("id", F.size("tags").cast("bigint").alias("n_tags"))


@query("f3_vocab_fit", f"WITH {SQL_VOCAB} SELECT kind, term, index FROM vocab")
def vocab_fit(spark, sf):
    return feat.fit_vocab(prepared(spark, sf))


@query("f3_vocab_fit_ranked", f"WITH {SQL_VOCAB} SELECT kind, term, index FROM vocab")
def vocab_fit_ranked(spark, sf):
    """The same from stored rows."""
    return feat.fit_vocab(stored(prepared(spark, sf)))


SQL_MULTI_HOT = f"""WITH {SQL_VOCAB},
labelled AS (
  SELECT DISTINCT id, 'tags' AS kind, unnest(tags) AS term FROM complete
  UNION ALL
  SELECT DISTINCT id, 'genres' AS kind, unnest(genres) AS term FROM complete
)
SELECT id, index FROM labelled JOIN vocab USING (kind, term)"""


def _labels_as_rows(df):
    return df.select("id", F.explode("labels").alias("index"))


@query("f4_multi_hot", SQL_MULTI_HOT)
def multi_hot(spark, sf):
    rows = stored(prepared(spark, sf))
    return _labels_as_rows(feat.multi_hot(rows, feat.fit_vocab(rows)))


@query("f4_multi_hot_joined", SQL_MULTI_HOT)
def multi_hot_joined(spark, sf):
    """The same with a vocabulary read back from a table."""
    rows = stored(prepared(spark, sf))
    return _labels_as_rows(feat.multi_hot(rows, stored(feat.fit_vocab(rows))))


@query(
    "f5_log_popularity",
    """SELECT p_partkey AS id, round(ln(1 + CAST(count(l_partkey) AS DOUBLE)), 6) AS popularity
    FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""",
)
def log_popularity(spark, sf):
    logged = numbers.log_popularity(F.col("popularity")).alias("popularity")
    return A.raw_items(spark, sf).select("id", logged).select("id", *_rounded("popularity"))


@query(
    "f6_log_chapters",
    """SELECT p_partkey AS id, round(ln(1 + CAST(
      CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_size END AS DOUBLE)), 6) AS chapters
    FROM part""",
)
def log_chapters(spark, sf):
    filled = items.fill_sentinel(A.raw_items(spark, sf))
    logged = numbers.log_chapters(F.col("chapters")).alias("chapters")
    return filled.select("id", logged).select("id", *_rounded("chapters"))


@query(
    "f7_scaler_fit",
    f"""WITH {SQL_SCALER}
    SELECT 'popularity' AS col, round(m1, 6) AS mean, round(s1, 6) AS std FROM stats
    UNION ALL SELECT 'chapters', round(m2, 6), round(s2, 6) FROM stats
    UNION ALL SELECT 'averageScore', round(m3, 6), round(s3, 6) FROM stats
    UNION ALL SELECT 'release_year', round(m4, 6), round(s4, 6) FROM stats""",
)
def scaler_fit(spark, sf):
    return feat.fit_scaler(prepared(spark, sf)).select("col", *_rounded("mean", "std"))


SQL_SCALED = f"""WITH {SQL_SCALER}
SELECT id, round(popularity, 6) + 0.0 AS popularity, round(chapters, 6) + 0.0 AS chapters,
  round("averageScore", 6) + 0.0 AS "averageScore", round(release_year, 6) + 0.0 AS release_year
FROM scaled"""


@query("f8_scaler_apply", SQL_SCALED)
def scaler_apply(spark, sf):
    rows = prepared(spark, sf)
    scaled = feat.apply_scaler(rows, feat.fit_scaler(rows))
    return scaled.select("id", *_rounded(*feat.SCALED_COLUMNS))


@query(
    "f9_save_params",
    f"""WITH {SQL_VOCAB}, {SQL_SCALER.split(f"{SQL_PREPARED},", 1)[1]}
    SELECT kind || ':' || term AS name, CAST(index AS DOUBLE) AS value FROM vocab
    UNION ALL SELECT 'mean:popularity', round(m1, 6) FROM stats
    UNION ALL SELECT 'mean:chapters', round(m2, 6) FROM stats
    UNION ALL SELECT 'mean:averageScore', round(m3, 6) FROM stats
    UNION ALL SELECT 'mean:release_year', round(m4, 6) FROM stats
    UNION ALL SELECT 'std:popularity', round(s1, 6) FROM stats
    UNION ALL SELECT 'std:chapters', round(s2, 6) FROM stats
    UNION ALL SELECT 'std:averageScore', round(s3, 6) FROM stats
    UNION ALL SELECT 'std:release_year', round(s4, 6) FROM stats""",
)
def save_params(spark, sf):
    """Both parameter tables written as snapshots and read back."""
    from shelfkin.sources import snapshots as snap

    root = snap.shared_folder(spark)
    params = feat.fit_item_features(stored(cleaned(spark, sf)))
    snap.write_snapshot(params.vocab, root, snap.FEATURES, "vocab")
    snap.write_snapshot(params.scaler, root, snap.FEATURES, "scaler")
    vocab = snap.read_latest(spark, root, snap.FEATURES, "vocab")
    scaler = snap.read_latest(spark, root, snap.FEATURES, "scaler")
    terms = vocab.select(
        F.concat_ws(":", "kind", "term").alias("name"), F.col("index").cast("double").alias("value")
    )
    for kind in ("mean", "std"):
        value = F.round(kind, 6).alias("value")
        terms = terms.unionByName(scaler.select(F.concat(F.lit(f"{kind}:"), "col").alias("name"), value))
    return terms


@query(
    "f10_item_features",
    f"""WITH {SQL_SCALER}, {SQL_VOCAB.split(f"{SQL_PREPARED},", 1)[1]},
    labelled AS (
      SELECT DISTINCT id, 'tags' AS kind, unnest(tags) AS term FROM complete
      UNION ALL
      SELECT DISTINCT id, 'genres' AS kind, unnest(genres) AS term FROM complete
    ),
    positions AS (
      SELECT id, string_agg(CAST(index AS VARCHAR), '|' ORDER BY index) AS labels
      FROM labelled JOIN vocab USING (kind, term) GROUP BY id
    )
    SELECT id, round(popularity, 6) + 0.0 AS popularity, round(chapters, 6) + 0.0 AS chapters,
      round("averageScore", 6) + 0.0 AS "averageScore", CAST(has_end_date AS DOUBLE) AS has_end_date,
      round(release_year, 6) + 0.0 AS release_year, coalesce(labels, '') AS labels
    FROM scaled LEFT JOIN positions USING (id)""",
)
def item_features(spark, sf):
    rows, _ = feat.item_features(stored(cleaned(spark, sf)))
    numeric = [F.col("numeric")[i].alias(c) for i, c in enumerate(feat.NUMERIC_COLUMNS)]
    labels = F.array_join(F.col("labels").cast("array<string>"), "|").alias("labels")
    return rows.select("id", *numeric, labels).select(
        "id", *_rounded(*feat.NUMERIC_COLUMNS), "labels"
    )


SQL_WEIGHT = """CASE status WHEN 'COMPLETED' THEN 1.0 WHEN 'CURRENT' THEN 0.8
  WHEN 'PAUSED' THEN 0.5 WHEN 'PLANNING' THEN 0.4 WHEN 'DROPPED' THEN 0.1 END"""


@query(
    "f11_status_weight",
    f"WITH {A.SQL_COERCED} SELECT event_id, CAST({SQL_WEIGHT} AS DOUBLE) AS weight FROM coerced",
)
def status_weight(spark, sf):
    return A.raw_interactions(spark, sf).select(
        "event_id", numbers.status_weight(F.upper("status")).alias("weight")
    )


@query(
    "f12_interaction_strength",
    f"""WITH {A.SQL_COERCED}
    SELECT event_id, round(CAST({SQL_WEIGHT} AS DOUBLE) * (score / 10), 6) AS strength
    FROM coerced""",
)
def interaction_strength(spark, sf):
    weight = numbers.status_weight(F.upper("status"))
    score = numbers.coerce_numeric(F.col("score"))
    strength = numbers.interaction_strength(weight, score)
    return A.raw_interactions(spark, sf).select("event_id", F.round(strength, 6).alias("strength"))


@query(
    "f13_user_features",
    f"""WITH {A.SQL_COERCED}
    SELECT "userId", CAST({SQL_WEIGHT} AS DOUBLE) AS status, score, "mediaId",
      round(CAST({SQL_WEIGHT} AS DOUBLE) * (score / 10), 6) AS interaction_strength
    FROM reads""",
)
def user_features(spark, sf):
    clean = interactions.clean_interactions(A.landed_interactions(spark, sf))
    strength = F.round("interaction_strength", 6)
    return feat.user_features(clean).withColumn("interaction_strength", strength)

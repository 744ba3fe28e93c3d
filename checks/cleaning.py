"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as A
from checks.registry import joined, query, table
from shelfkin import schemas
from shelfkin.functions import dates, numbers, text
from shelfkin.operators import frames, interactions, items

SQL_RAW_TITLE = "CASE WHEN p_partkey % 21 = 3 THEN NULL ELSE lower(p_name) END"


@query("p1_clean_title", f"SELECT p_partkey AS id, {SQL_RAW_TITLE} AS title FROM part")
def clean_title(spark, sf):
    part = table(spark, sf, "part")
    return part.withColumn("raw", A.raw_titles(part)).select(
        F.col("p_partkey").alias("id"), text.clean_title(F.col("raw")).alias("title")
    )


@query(
    "p2_clean_tags",
    """SELECT p_partkey AS id,
      CASE p_partkey % 5 WHEN 0 THEN lower(p_brand) WHEN 1 THEN ''
        WHEN 2 THEN split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 1)
        ELSE replace(p_name, ' ', '|') || '|' || lower(p_brand) END AS tags,
      CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 ELSE 3 END AS n_tags
    FROM part""",
)
def clean_tags(spark, sf):
    part = table(spark, sf, "part")
    cleaned = part.withColumn("raw", A.raw_tags(part)).withColumn(
        "clean", text.clean_tags(F.col("raw"))
    )
    return cleaned.select(
        F.col("p_partkey").alias("id"),
        joined("clean").alias("tags"),
        F.size("clean").alias("n_tags"),
    )


@query(
    "p3_has_end_date",
    "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 2 THEN 0 ELSE 1 END AS has_end_date"
    " FROM orders",
)
def has_end_date(spark, sf):
    orders = table(spark, sf, "orders").withColumn("endDate", A.raw_end_date("o_orderkey"))
    return orders.select(
        F.col("o_orderkey").alias("id"), dates.has_end_date(F.col("endDate")).alias("has_end_date")
    )


SQL_MONTH_START = """CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 OR o_orderkey % 37 = 0
  THEN NULL ELSE date_trunc('month', o_orderdate) END"""


def order_months(spark, sf):
    raw = A.raw_start_date("o_orderdate", "o_orderkey")
    orders = table(spark, sf, "orders").withColumn("date", raw)
    return orders.select(
        F.col("o_orderkey").alias("id"), dates.month_start(F.col("date")).alias("startDate")
    )


@query(
    "p4_month_start",
    f"""SELECT o_orderkey AS id, CAST({SQL_MONTH_START} AS TIMESTAMP) AS "startDate" FROM orders""",
)
def month_start(spark, sf):
    return order_months(spark, sf)


@query(
    "f1_release_year",
    f"SELECT o_orderkey AS id, CAST(year({SQL_MONTH_START}) AS DOUBLE) AS release_year FROM orders",
)
def release_year(spark, sf):
    return order_months(spark, sf).select(
        "id", dates.release_year(F.col("startDate")).cast("double").alias("release_year")
    )


@query(
    "p5_fill_sentinel",
    """SELECT p_partkey AS id,
      CAST(CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE p_size END AS BIGINT) AS chapters,
      CAST(CASE WHEN p_partkey % 13 = 0 THEN -1 ELSE p_size * 2 END AS BIGINT) AS volumes
    FROM part""",
)
def fill_sentinel(spark, sf):
    return items.fill_sentinel(A.raw_items(spark, sf)).select("id", "chapters", "volumes")


@query(
    "p6_clean_description",
    r"""SELECT doc_id AS id,
      regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(
        regexp_replace(regexp_replace(dirty,
          '[(\[]\s*Source:[^)\]]+[)\]]', '', 'gi'),
          'Note:[^.]*\.?$', '', 'gi'),
          '<br\s*/?>', ' ', 'gi'),
          chr(10), ' '), '\s{2,}', ' ', 'g'), '^\s+', ''), '\s+$', '') AS description
    FROM (SELECT doc_id, CASE doc_id % 4
        WHEN 0 THEN text || chr(10) || '(Source: some publisher)'
        WHEN 1 THEN text || ' Note: no sentence after this one.'
        WHEN 2 THEN '[source: A B] ' || text || '<BR />end<br>'
        ELSE text END AS dirty FROM documents) AS d""",
)
def clean_description(spark, sf):
    body = F.col("text")
    dirty = A._when(
        "doc_id",
        {
            (4, 0): F.concat(body, F.lit("\n(Source: some publisher)")),
            (4, 1): F.concat(body, F.lit(" Note: no sentence after this one.")),
            (4, 2): F.concat(F.lit("[source: A B] "), body, F.lit("<BR />end<br>")),
        },
        body,
    )
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), text.clean_description(dirty).alias("description")
    )


@query(
    "p6_clean_description_html",
    r"""SELECT page_id AS id,
      regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(
        regexp_replace(regexp_replace(html,
          '[(\[]\s*Source:[^)\]]+[)\]]', '', 'gi'),
          'Note:[^.]*\.?$', '', 'gi'),
          '<br\s*/?>', ' ', 'gi'),
          chr(10), ' '), '\s{2,}', ' ', 'g'), '^\s+', ''), '\s+$', '') AS description
    FROM pages""",
)
def clean_description_html(spark, sf):
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), text.clean_description(F.col("html")).alias("description")
    )


@query(
    "p7_drop_adult",
    "SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 1 THEN NULL ELSE 'false' END AS"
    ' "isAdult" FROM part WHERE p_partkey % 10 <> 0',
)
def drop_adult(spark, sf):
    return items.drop_adult(A.raw_items(spark, sf)).select(
        "id", F.col("isAdult").cast("string").alias("isAdult")
    )


@query(
    "p8_drop_columns",
    "SELECT p_partkey, p_name, p_brand, p_size FROM part",
)
def drop_columns(spark, sf):
    return frames.drop_columns(table(spark, sf, "part"), "p_type", "p_retailprice")


@query(
    "p9_clean_items",
    f"""WITH {A.SQL_ITEMS}
    SELECT id, title, array_to_string(tags, '|') AS tags, array_to_string(genres, '|') AS genres,
      popularity, CAST(chapters AS BIGINT) AS chapters, CAST(volumes AS BIGINT) AS volumes,
      CAST("averageScore" AS DOUBLE) AS "averageScore", "meanScore", CAST(favourites AS BIGINT) AS favourites,
      CAST("startDate" AS TIMESTAMP) AS "startDate", has_end_date, description
    FROM items""",
)
def clean_items(spark, sf):
    cleaned = items.clean_items(A.raw_items(spark, sf))
    score = F.col("averageScore").cast("double")
    return cleaned.withColumns(
        {"tags": joined("tags"), "genres": joined("genres"), "averageScore": score}
    )


@query(
    "p10_conform_schema",
    """SELECT CASE WHEN event_id % 97 = 0 THEN 'abc'
        WHEN event_id % 83 = 0 THEN CAST(user_id AS VARCHAR) || '.9'
        ELSE CAST(user_id AS VARCHAR) END AS "userId",
      CASE WHEN event_id % 47 = 0 THEN NULL ELSE
        CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'current'
          WHEN 'click' THEN 'paused' WHEN 'signup' THEN 'planning' ELSE 'repeating' END
      END AS status,
      CASE WHEN event_id % 61 = 0 THEN value
        WHEN event_id % 59 = 0 OR event_id % 53 = 0 THEN NULL ELSE value END AS score,
      CAST(NULL AS VARCHAR) AS progress,
      CASE WHEN event_id % 89 = 0 THEN NULL
        WHEN event_id % 71 = 0 THEN regexp_extract(props, '[0-9]+') || 'd'
        ELSE regexp_extract(props, '[0-9]+') END AS "mediaId",
      CASE WHEN event_id % 43 = 0 THEN '1e20' WHEN event_id % 41 = 0 THEN 'x'
        WHEN event_id % 37 = 0 THEN '0' ELSE CAST(CAST(floor(epoch(ts)) AS BIGINT) AS VARCHAR)
      END AS "createdAt"
    FROM events""",
)
def conform_schema(spark, sf):
    conformed = frames.conform_schema(A.raw_interactions(spark, sf), schemas.RAW_INTERACTION)
    score = numbers.coerce_numeric(F.col("score"))  # as text it is written by either engine's rules
    return conformed.withColumn("score", score)


@query(
    "p11_coerce_numeric",
    f"""WITH {A.SQL_COERCED}
    SELECT event_id, CAST("userId" AS DOUBLE) AS "userId", "mediaId", score, progress FROM coerced""",
)
def coerce_numeric(spark, sf):
    raw = A.raw_interactions(spark, sf).withColumn("progress", F.lit(None).cast("string"))
    return interactions.coerce_interactions(raw).select(
        "event_id", "userId", "mediaId", "score", "progress"
    )


@query("p12_upper_status", f"WITH {A.SQL_COERCED} SELECT event_id, status FROM coerced")
def upper_status(spark, sf):
    return A.raw_interactions(spark, sf).select(
        "event_id", text.upper_status(F.col("status")).alias("status")
    )


@query("p13_epoch_to_ts", f'WITH {A.SQL_COERCED} SELECT event_id, "createdAt" FROM coerced')
def epoch_to_ts(spark, sf):
    seconds = numbers.coerce_numeric(F.col("createdAt"))
    return A.raw_interactions(spark, sf).select(
        "event_id", dates.epoch_to_ts(seconds).alias("createdAt")
    )


@query(
    "p14_drop_unjoinable",
    f"""WITH {A.SQL_COERCED}
    SELECT event_id, CAST("userId" AS DOUBLE) AS "userId", "mediaId" FROM coerced
    WHERE "userId" IS NOT NULL AND "mediaId" IS NOT NULL""",
)
def drop_unjoinable(spark, sf):
    raw = A.raw_interactions(spark, sf).withColumn("progress", F.lit(None).cast("string"))
    kept = interactions.drop_unjoinable(interactions.coerce_interactions(raw))
    return kept.select("event_id", "userId", "mediaId")


@query("p15_cast_ids", f'WITH {A.SQL_COERCED} SELECT event_id, "userId", "mediaId" FROM reads')
def cast_ids(spark, sf):
    return interactions.cast_ids(drop_unjoinable(spark, sf))


@query(
    "p16_clean_interactions",
    f"""WITH {A.SQL_COERCED}
    SELECT "userId", status, score, progress, "mediaId", "createdAt" FROM reads""",
)
def clean_interactions(spark, sf):
    return interactions.clean_interactions(A.landed_interactions(spark, sf))

"""Source and sink queries: landed pages, filters, quarantine, files, snapshots, counts."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from checks import adapters as A
from checks.registry import query, table
from shelfkin import schemas
from shelfkin.operators import items
from shelfkin.sources import landing, metrics
from shelfkin.sources import snapshots as snap

ROWS_PER_FILE = 1000  # rows in one landed JSON array
ROWS_PER_RESPONSE = 50


def responses(spark, sf):
    """Landed interaction responses: one page per user per event, errors for error events.

    Every 91st is not JSON, every 89th has no page number.
    """
    broken, unnumbered = F.col("event_id") % 91 == 0, F.col("event_id") % 89 == 0
    failed = F.col("event_type") == "error"
    row = F.struct(
        F.col("user_id").cast("string").alias("userId"),
        A.event_status().alias("status"),
        F.col("value").cast("string").alias("score"),
        F.lit(None).cast("string").alias("progress"),
        A.read_key().alias("mediaId"),
        F.col("event_id").cast("string").alias("createdAt"),
    )
    page = F.struct(
        F.array(row).alias("mediaList"), F.struct(F.lit(True).alias("hasNextPage")).alias("pageInfo")
    )
    errors = F.to_variant_object(F.struct(F.lit("private user").alias("message")))
    lines = table(spark, sf, "events").select(
        F.when(broken, F.concat(F.lit("<html>"), F.col("event_id").cast("string")))
        .otherwise(
            F.to_json(
                F.struct(
                    F.col("user_id").alias("userId"),
                    F.when(~unnumbered, F.col("event_id")).alias("page"),
                    F.when(failed, errors).alias("errors"),
                    F.when(~failed, F.struct(page.alias("Page"))).alias("data"),
                )
            )
        )
        .alias("value")
    )
    path = f"{snap.shared_folder(spark)}/responses"
    lines.write.text(path)
    return landing.scan_json(spark, path, schemas.INTERACTION_RESPONSE, lines=True)


@query(
    "s1_scan_json",
    """SELECT CAST(user_id AS VARCHAR) AS "userId", event_type AS status,
      CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS score, CAST(NULL AS VARCHAR) AS progress,
      regexp_extract(props, '[0-9]+') AS "mediaId", CAST(event_id AS VARCHAR) AS "createdAt"
    FROM events""",
)
def scan_json(spark, sf):
    """Events landed as files of one JSON array each, then read back."""
    record = F.struct(
        F.col("user_id").cast("string").alias("userId"),
        F.col("event_type").alias("status"),
        F.floor("value").cast("string").alias("score"),
        A.read_key().alias("mediaId"),
        F.col("event_id").cast("string").alias("createdAt"),
    )
    path = f"{snap.shared_folder(spark)}/landed"
    page = F.floor(F.col("event_id") / ROWS_PER_FILE)
    arrays = table(spark, sf, "events").groupBy(page.alias("page")).agg(
        F.to_json(F.collect_list(record)).alias("value")  # at most ROWS_PER_FILE records
    )
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return landing.scan_json(spark, path, schemas.RAW_INTERACTION)


@query(
    "s2_flatten_pages",
    """SELECT event_id // 50 AS page_no, CAST(user_id AS VARCHAR) AS "userId", event_type AS status,
      CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS score, CAST(NULL AS VARCHAR) AS progress,
      regexp_extract(props, '[0-9]+') AS "mediaId", CAST(event_id AS VARCHAR) AS "createdAt"
    FROM events""",
)
def flatten_pages(spark, sf):
    """Events packed into response pages and flattened again; repeated rows stay."""
    record = F.struct(
        F.col("user_id").cast("string").alias("userId"),
        F.col("event_type").alias("status"),
        F.floor("value").cast("string").alias("score"),
        F.lit(None).cast("string").alias("progress"),
        A.read_key().alias("mediaId"),
        F.col("event_id").cast("string").alias("createdAt"),
    )
    page = F.floor(F.col("event_id") / ROWS_PER_RESPONSE)
    packed = table(spark, sf, "events").groupBy(page.alias("page_no")).agg(
        F.struct(F.collect_list(record).alias("mediaList")).alias("Page")
    )
    return landing.flatten_pages(packed, "Page.mediaList", keep=("page_no",))


@query(
    "s3_source_filter_items",
    f"""WITH {A.SQL_ITEMS.replace("WHERE p_partkey % 10 <> 0", "")}
    SELECT id, popularity, "averageScore" FROM items
    WHERE "averageScore" > {A.MIN_CATALOGUE_SCORE} AND popularity > {A.MIN_CATALOGUE_POPULARITY}""",
)
def source_filter_items(spark, sf):
    kept = landing.source_filter_items(
        A.raw_items(spark, sf), A.MIN_CATALOGUE_SCORE, A.MIN_CATALOGUE_POPULARITY
    )
    return kept.select("id", "popularity", "averageScore")


@query(
    "s4_source_filter_users",
    'SELECT event_id, user_id AS "userId" FROM events WHERE user_id BETWEEN 10 AND 60',
)
def source_filter_users(spark, sf):
    users = table(spark, sf, "events").withColumnRenamed("user_id", "userId")
    return landing.source_filter_users(users, 10, 60).select("event_id", "userId")


@query(
    "s5_cap_per_user",
    """SELECT event_id, user_id AS "userId" FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 20""",
)
def cap_per_user(spark, sf):
    """Two pages of ten rows per user, in order of arrival."""
    arrived = table(spark, sf, "events").select(
        "event_id",
        F.col("user_id").alias("userId"),
        F.floor(F.col("event_id") / 10).alias("page"),
        (F.col("event_id") % 10).alias("pos"),
    )
    return landing.cap_per_user(arrived, max_pages=2, per_page=10).select("event_id", "userId")


@query(
    "s6_quarantine_errors",
    """SELECT CASE WHEN event_id % 91 <> 0 THEN CAST(user_id AS DOUBLE) END AS page_user,
      CASE WHEN event_id % 91 <> 0 AND event_id % 89 <> 0 THEN CAST(event_id AS DOUBLE) END AS page,
      CASE WHEN event_id % 91 = 0 THEN '<html>' || event_id END AS malformed,
      TRUE AS quarantined, NULL AS "mediaId"
    FROM events WHERE event_type = 'error' OR event_id % 91 = 0 OR event_id % 89 = 0
    UNION ALL SELECT user_id, event_id, NULL, FALSE, regexp_extract(props, '[0-9]+')
    FROM events WHERE NOT (event_type = 'error' OR event_id % 91 = 0 OR event_id % 89 = 0)""",
)
def quarantine_errors(spark, sf):
    """Both branches of the landed responses: kept rows and quarantined pages."""
    landed = responses(spark, sf).withColumnRenamed("userId", "page_user")
    kept = landing.flatten_pages(
        landing.response_rows(landed), "data.Page.mediaList", keep=("page_user", "page")
    ).select("page_user", "page", "mediaId")
    failed = landing.quarantine(landed).select("page_user", "page", "malformed")
    both = kept.withColumn("quarantined", F.lit(False)).unionByName(
        failed.withColumn("quarantined", F.lit(True)), allowMissingColumns=True
    )
    return both.withColumns({c: F.col(c).cast("double") for c in ("page_user", "page")})


@query(
    "s6_skipped_users",
    """SELECT DISTINCT user_id AS "userId" FROM events
    WHERE (event_type = 'error' OR event_id % 89 = 0) AND event_id % 91 <> 0""",
)
def skipped_users(spark, sf):
    return landing.skipped_users(responses(spark, sf))


@query(
    "s7_write_json",
    "SELECT doc_id, text, lang, source, n_chars FROM documents",
)
def write_json(spark, sf):
    """Documents written as JSON lines and read back whole, newlines and accents kept."""
    path = f"{snap.shared_folder(spark)}/documents"
    documents = table(spark, sf, "documents")
    snap.write_json(documents, path)
    return spark.read.schema(documents.schema).json(path)


@query(
    "s8_scan_parquet",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000",
)
def scan_parquet(spark, sf):
    orders = snap.scan_parquet(spark, f"{sf}/orders.parquet")
    return orders.filter("o_totalprice > 150000").select("o_orderkey", "o_totalprice")


@query("s9_write_parquet", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def write_parquet(spark, sf):
    path = f"{snap.shared_folder(spark)}/customer"
    snap.write_parquet(table(spark, sf, "customer"), path)
    return snap.scan_parquet(spark, path)


DAYS = tuple(datetime.date(2024, 1, day) for day in (9, 10, 11))
ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


def _orders_of_two_days(spark, sf):
    """Finished orders on the first day; all on the second, which is then written again.

    A second dataset has all orders on the second day and none when that is written again; a
    third has some on the first day and none on a later one.
    """
    root = snap.shared_folder(spark)
    orders = table(spark, sf, "orders").select(*ORDER_COLUMNS.split(", "))
    for name, days in (("emptied", (DAYS[1], DAYS[1])), ("ended", (DAYS[0], DAYS[2]))):
        snap.write_snapshot(orders, root, snap.RAW, name, days[0])
        snap.write_snapshot(orders.filter("o_orderkey IS NULL"), root, snap.RAW, name, days[1])
    snap.write_snapshot(orders.filter("o_orderstatus = 'F'"), root, snap.RAW, "orders", DAYS[0])
    snap.write_snapshot(orders, root, snap.RAW, "orders", DAYS[1])
    snap.write_snapshot(orders.filter("o_orderstatus <> 'F'"), root, snap.RAW, "orders", DAYS[1])
    return root


@query(
    "s10_write_snapshot",
    f"""SELECT 'orders' AS dataset, '2024-01-09' AS dt, {ORDER_COLUMNS} FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'orders', '2024-01-10', {ORDER_COLUMNS} FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT 'ended', '2024-01-09', {ORDER_COLUMNS} FROM orders""",
)
def write_snapshot(spark, sf):
    root = _orders_of_two_days(spark, sf)
    days = [
        snap.read_days(spark, root, snap.RAW, name).withColumn("dataset", F.lit(name))
        for name in ("orders", "emptied", "ended")
    ]
    every_day = days[0].unionByName(days[1]).unionByName(days[2])
    return every_day.withColumn("dt", F.col("dt").cast("string"))


@query(
    "s11_read_latest",
    f"SELECT 'orders' AS dataset, {ORDER_COLUMNS} FROM orders WHERE o_orderstatus <> 'F'",
)
def read_latest(spark, sf):
    """The latest of each dataset; of two of them it is empty."""
    root = _orders_of_two_days(spark, sf)
    latest = [
        snap.read_latest(spark, root, snap.RAW, name).withColumn("dataset", F.lit(name))
        for name in ("orders", "emptied", "ended")
    ]
    return latest[0].unionByName(latest[1]).unionByName(latest[2])


@query(
    "s13_stage_counts",
    f"""WITH {A.SQL_COERCED}
    SELECT 'raw items' AS stage, count(*) AS rows FROM part
    UNION ALL SELECT 'clean items', count(*) FROM part WHERE p_partkey % 10 <> 0
    UNION ALL SELECT 'raw interactions', count(*) FROM coerced
    UNION ALL SELECT 'clean interactions', count(*) FROM reads""",
)
def stage_counts(spark, sf):
    from shelfkin.operators.interactions import clean_interactions

    raw, reads = A.raw_items(spark, sf), A.landed_interactions(spark, sf)
    return metrics.stage_counts(
        **{
            "raw items": raw,
            "clean items": items.clean_items(raw),
            "raw interactions": reads,
            "clean interactions": clean_interactions(reads),
        }
    )


@query(
    "s13_rows_per_user",
    'SELECT user_id AS "userId", count(*) AS rows FROM events GROUP BY user_id',
)
def rows_per_user(spark, sf):
    return metrics.rows_per_user(table(spark, sf, "events").withColumnRenamed("user_id", "userId"))

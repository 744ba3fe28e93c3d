"""The given tables in the shape of a catalogue and a read-list.

Parts are items and events are reads.  Missing, malformed and mixed-shape values are put in
by remainder of the key, so that every row rule is met at any scale.  The SQL texts state
the cleaned form of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import table
from shelfkin.sources.snapshots import stored

MIN_CATALOGUE_SCORE = 70
MIN_CATALOGUE_POPULARITY = 30


def part_activity(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitem count and first ship date of every part."""
    return table(spark, sf, "lineitem").groupBy("l_partkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("l_shipdate").alias("first_ship")
    )


def _when(key: str, cases: dict[tuple[int, int], object], otherwise):
    """CASE on remainders: {(modulus, remainder): value}."""
    chain = F
    for (modulus, remainder), value in cases.items():
        chain = chain.when(F.col(key) % modulus == remainder, value)
    return chain.otherwise(otherwise)


def _names(english, romaji, native):
    return F.to_variant_object(
        F.struct(english.alias("english"), romaji.alias("romaji"), native.alias("native"))
    )


def _tag(name):
    return F.struct(name.alias("name"), F.lit("Theme").alias("category"))


def raw_titles(part: DataFrame):
    null = F.lit(None).cast("string")
    name = F.initcap("p_name")
    return _when(
        "p_partkey",
        {
            (7, 0): F.upper("p_name").cast("variant"),
            (7, 1): _names(F.lit(""), name, null),
            (7, 2): _names(null, F.lit(""), F.upper("p_name")),
            (21, 3): _names(null, null, null),
        },
        _names(name, F.lit("other"), F.lit("another")),
    )


def raw_tags(part: DataFrame):
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    null = F.lit(None).cast("string")
    return _when(
        "p_partkey",
        {
            (5, 0): F.col("p_brand").cast("variant"),
            (5, 1): F.lit(None).cast("variant"),
            (5, 2): F.to_variant_object(
                F.array(_tag(F.initcap(first)), _tag(F.lit("")), _tag(null), _tag(first))
            ),
        },
        F.to_variant_object(F.array(_tag(first), _tag(F.initcap(second)), _tag(F.col("p_brand")))),
    )


def raw_start_date(date: str = "first_ship", key: str = "p_partkey"):
    year = F.year(date).cast("bigint")
    month = F.month(date).cast("bigint")
    null = F.lit(None).cast("bigint")
    zero, thirteen = (F.lit(n).cast("bigint") for n in (0, 13))
    return F.struct(
        _when(key, {(17, 0): zero, (19, 0): thirteen}, month).alias("month"),
        _when(key, {(37, 0): null}, year).alias("year"),
    )


def raw_end_date(key: str = "p_partkey"):
    empty = F.expr("CAST(map() AS MAP<STRING, BIGINT>)")
    return _when(
        key,
        {
            (4, 0): F.lit(None).cast("map<string,bigint>"),
            (4, 1): F.expr("map('month', CAST(NULL AS BIGINT), 'year', 2000L)"),
            (4, 2): F.expr("map('month', 5L, 'year', 2001L)"),
        },
        empty,
    )


def raw_description():
    name = F.col("p_name")
    return _when(
        "p_partkey",
        {
            (6, 0): F.concat(name, F.lit(" tale.\n\n(Source: Lantern House)")),
            (6, 1): F.concat(name, F.lit(". Note: one sentence.")),
            (6, 2): F.concat(name, F.lit(".<br>Note: z.<br/>")),
            (6, 3): F.lit(None).cast("string"),
            (6, 4): F.concat(name, F.lit("  of  [source: x y] old <BR /> days ")),
        },
        F.concat(name, F.lit(" (Source: a(b) c) d")),
    )


def raw_items(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as raw catalogue items."""
    part = table(spark, sf, "part")
    parts = part.join(part_activity(spark, sf), part.p_partkey == F.col("l_partkey"), "left")
    size = F.col("p_size").cast("bigint")
    score = (F.floor("p_retailprice") % 101).cast("bigint")
    null = F.lit(None).cast("bigint")
    return parts.select(
        F.col("p_partkey").alias("id"),
        raw_titles(part).alias("title"),
        raw_tags(part).alias("tags"),
        _when(
            "p_partkey",
            {(23, 0): F.array().cast("array<string>"), (29, 0): F.lit(None).cast("array<string>")},
            F.array("p_type"),
        ).alias("genres"),
        F.coalesce("n_lines", F.lit(0)).alias("popularity"),
        _when("p_partkey", {(11, 0): null}, size).alias("chapters"),
        _when("p_partkey", {(13, 0): null}, size * 2).alias("volumes"),
        _when("p_partkey", {(31, 0): null}, score).alias("averageScore"),
        (score - 1).alias("meanScore"),
        (size * 3).alias("favourites"),
        raw_start_date().alias("startDate"),
        raw_end_date().alias("endDate"),
        _when(
            "p_partkey",
            {(10, 0): F.lit(True), (10, 1): F.lit(None).cast("boolean")},
            F.lit(False),
        ).alias("isAdult"),
        raw_description().alias("description"),
    )


# The cleaned items, from the same tables.
SQL_ITEMS = """
activity AS (
  SELECT l_partkey, count(*) AS n_lines, min(l_shipdate) AS first_ship
  FROM lineitem GROUP BY l_partkey
),
items AS (
  SELECT p_partkey AS id,
    CASE WHEN p_partkey % 21 = 3 THEN NULL ELSE lower(p_name) END AS title,
    CASE WHEN p_partkey % 5 = 0 THEN list_value(lower(p_brand))
         WHEN p_partkey % 5 = 1 THEN []::VARCHAR[]
         WHEN p_partkey % 5 = 2 THEN list_value(split_part(p_name, ' ', 1), split_part(p_name, ' ', 1))
         ELSE list_value(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), lower(p_brand))
    END AS tags,
    CASE WHEN p_partkey % 23 = 0 THEN []::VARCHAR[]
         WHEN p_partkey % 29 = 0 THEN NULL
         ELSE list_value(p_type) END AS genres,
    coalesce(n_lines, 0) AS popularity,
    CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE p_size END AS chapters,
    CASE WHEN p_partkey % 13 = 0 THEN -1 ELSE p_size * 2 END AS volumes,
    CASE WHEN p_partkey % 31 = 0 THEN NULL
         ELSE CAST(floor(p_retailprice) AS BIGINT) % 101 END AS "averageScore",
    CAST(floor(p_retailprice) AS BIGINT) % 101 - 1 AS "meanScore",
    p_size * 3 AS favourites,
    CASE WHEN p_partkey % 17 = 0 OR p_partkey % 19 = 0 OR p_partkey % 37 = 0 THEN NULL
         ELSE date_trunc('month', first_ship) END AS "startDate",
    CASE WHEN p_partkey % 4 < 2 THEN 0 ELSE 1 END AS has_end_date,
    CASE p_partkey % 6
      WHEN 0 THEN p_name || ' tale.'
      WHEN 1 THEN p_name || '.'
      WHEN 2 THEN p_name || '. Note: z.'
      WHEN 3 THEN NULL
      WHEN 4 THEN p_name || ' of old days'
      ELSE p_name || ' c) d' END AS description
  FROM part LEFT JOIN activity ON l_partkey = p_partkey
  WHERE p_partkey % 10 <> 0
)"""


def read_key():
    return F.regexp_extract("props", "[0-9]+", 0)


def event_status():
    """The event type as a reading status; errors stand for the status without a weight."""
    return F.expr(
        "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'current' "
        "WHEN 'click' THEN 'paused' WHEN 'signup' THEN 'planning' ELSE 'repeating' END"
    )


def raw_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as raw read-list rows, all text.  `progress` is absent and `z` is not ours."""
    user = F.col("user_id").cast("string")
    value = F.col("value").cast("string")
    null = F.lit(None).cast("string")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("string")
    return table(spark, sf, "events").select(
        "event_id",
        _when(
            "event_id", {(97, 0): F.lit("abc"), (83, 0): F.concat(user, F.lit(".9"))}, user
        ).alias("userId"),
        _when("event_id", {(47, 0): null}, event_status()).alias("status"),
        _when(
            "event_id",
            {
                (61, 0): F.concat(F.lit(" "), value, F.lit(" ")),
                (59, 0): F.lit("x"),
                (53, 0): F.lit("NaN"),
            },
            value,
        ).alias("score"),
        _when(
            "event_id", {(89, 0): null, (71, 0): F.concat(read_key(), F.lit("d"))}, read_key()
        ).alias("mediaId"),
        _when(
            "event_id", {(43, 0): F.lit("1e20"), (41, 0): F.lit("x"), (37, 0): F.lit("0")}, seconds
        ).alias("createdAt"),
        F.lit("unused").alias("z"),
    )


def landed_interactions(spark: SparkSession, sf: str) -> DataFrame:
    """The raw rows as a table, the form in which cleaning finds them.

    Cleaning them in one plan with the expressions that make them up would measure those.
    """
    return stored(raw_interactions(spark, sf), "raw_interactions")


SQL_COERCED = """
coerced AS (
  SELECT event_id,
    CASE WHEN event_id % 97 = 0 THEN NULL
         WHEN event_id % 83 = 0 THEN user_id + CAST(0.9 AS DOUBLE) ELSE user_id END AS "userId",
    CASE WHEN event_id % 47 = 0 THEN NULL ELSE
      CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'view' THEN 'CURRENT'
        WHEN 'click' THEN 'PAUSED' WHEN 'signup' THEN 'PLANNING' ELSE 'REPEATING' END
    END AS status,
    CASE WHEN event_id % 61 = 0 THEN value
         WHEN event_id % 59 = 0 OR event_id % 53 = 0 THEN NULL ELSE value END AS score,
    CAST(NULL AS DOUBLE) AS progress,
    CASE WHEN event_id % 89 = 0 OR event_id % 71 = 0 THEN NULL
         ELSE CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) END AS "mediaId",
    CASE WHEN event_id % 43 = 0 OR event_id % 41 = 0 THEN NULL
         WHEN event_id % 37 = 0 THEN TIMESTAMP '1970-01-01 00:00:00'
         ELSE date_trunc('second', ts) END AS "createdAt"
  FROM events
),
reads AS (
  SELECT event_id, CAST(floor("userId") AS BIGINT) AS "userId", status, score, progress,
    CAST("mediaId" AS BIGINT) AS "mediaId", "createdAt"
  FROM coerced WHERE "userId" IS NOT NULL AND "mediaId" IS NOT NULL
)"""

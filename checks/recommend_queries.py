"""Matching and recommendation queries.

The catalogue is every part, under its name and brand; the model is the neighbours of the
embeddings, so parts beyond the embeddings are known titles without a model row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.model_queries import SQL_NEIGHBORS, TOP_K, embedding_features
from checks.registry import query, table
from shelfkin.functions import numbers, text
from shelfkin.operators import matching, recommend
from shelfkin.operators import similarity as sim
from shelfkin.sources.snapshots import stored


def catalogue(spark, sf):
    """Parts by name and brand: many names occur more than once."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.lower(F.concat("p_name", F.lit(" "), "p_brand")).alias("title"),
        F.concat(F.lit("A "), F.lower("p_type"), F.lit(" "), "p_name").alias("description"),
        F.split("p_name", " ").alias("tags"),
    )


def exact_requests(spark, sf):
    """A request per part, in capitals for odd keys; every ninth names no title."""
    part = table(spark, sf, "part")
    title = F.concat("p_name", F.lit(" "), F.lower("p_brand"))
    key = F.col("p_partkey")
    return part.select(
        key.alias("request_id"),
        F.when(key % 9 == 0, F.concat(title, F.lit(" unknown")))
        .when(key % 2 == 1, F.upper(title))
        .otherwise(title)
        .alias("title"),
        (key % TOP_K + 1).cast("int").alias("top_n"),
    )


def named_catalogue(spark, sf):
    """Parts by name only."""
    return catalogue(spark, sf).withColumn("title", F.array_join("tags", " "))


def fuzzy_requests(spark, sf):
    """A request per part: its name as it is, or misspelt in one of seven ways."""
    key, name = F.col("p_partkey"), F.col("p_name")
    return table(spark, sf, "part").select(
        key.alias("request_id"),
        F.when(key % 8 == 1, F.expr("substring(p_name, 2)"))
        .when(key % 8 == 2, F.regexp_replace(name, " ", ""))
        .when(key % 8 == 3, F.concat(name, F.lit("xx")))
        .when(key % 8 == 4, F.upper(name))
        .when(key % 8 == 5, F.reverse(name))
        .when(key % 8 == 6, F.regexp_replace(name, "e", "a"))
        .when(key % 8 == 7, F.concat(F.substring(name, 1, 3), F.lit("q"), F.expr("substring(p_name, 4)")))
        .otherwise(name)
        .alias("title"),
        (key % TOP_K + 1).cast("int").alias("top_n"),
    )


def model(spark, sf):
    return stored(sim.topk_neighbors(embedding_features(spark, sf), TOP_K))


SQL_CATALOGUE = """catalogue AS (
  SELECT p_partkey AS id, lower(p_name || ' ' || p_brand) AS title,
    'A ' || lower(p_type) || ' ' || p_name AS description, replace(p_name, ' ', '|') AS tags
  FROM part
),
requests AS (
  SELECT p_partkey AS request_id,
    CASE WHEN p_partkey % 9 = 0 THEN p_name || ' ' || lower(p_brand) || ' unknown'
         WHEN p_partkey % 2 = 1 THEN upper(p_name || ' ' || p_brand)
         ELSE p_name || ' ' || lower(p_brand) END AS title,
    p_partkey % 5 + 1 AS top_n
  FROM part
),
first_ids AS (SELECT title, min(id) AS matched_id FROM catalogue GROUP BY title),
matched AS (
  SELECT request_id, requests.title, top_n, matched_id
  FROM requests LEFT JOIN first_ids ON lower(requests.title) = first_ids.title
)"""

SQL_CHECKED = """checked AS (
  SELECT request_id, top_n, matched_id,
    CASE WHEN matched_id IS NULL THEN 'title_not_found'
         WHEN vec_id IS NULL THEN 'not_in_model' ELSE 'ok' END AS status
  FROM matched LEFT JOIN embeddings ON vec_id = matched_id
)"""

SQL_ANSWERS = f"""{SQL_NEIGHBORS}, {SQL_CATALOGUE}, {SQL_CHECKED},
served AS (
  SELECT request_id, status, rank, neighbor_id AS id, round(similarity, 10) AS score,
    round_even(round(similarity, 10) * 100, 0) / 100 + 0.0 AS similarity
  FROM checked LEFT JOIN neighbors ON neighbors.id = matched_id AND rank <= top_n
),
answers AS (
  SELECT served.*, title, description, tags FROM served LEFT JOIN catalogue USING (id)
  WHERE served.id IS NULL OR catalogue.id IS NOT NULL
)"""


def matched(spark, sf):
    return stored(matching.match_exact(exact_requests(spark, sf), catalogue(spark, sf)))


def checked(spark, sf):
    modeled = embedding_features(spark, sf).select("id")
    return stored(recommend.lookup_status(recommend.check_modeled(matched(spark, sf), modeled)))


def ranked(spark, sf):
    return stored(recommend.top_n(recommend.neighbors_of(checked(spark, sf), model(spark, sf))))


def answers(spark, sf):
    return recommend.attach_metadata(ranked(spark, sf), catalogue(spark, sf))


def _double(*columns: str) -> dict:
    """Nullable whole numbers as doubles, the form both engines show alike."""
    return {c: F.col(c).cast("double") for c in columns}


SHOWN = "request_id, status, CAST(rank AS DOUBLE) AS rank, CAST(id AS DOUBLE) AS id"


@query(
    "r1_match_exact",
    f"""WITH {SQL_CATALOGUE}
    SELECT request_id, title, CAST(matched_id AS DOUBLE) AS matched_id FROM matched""",
)
def match_exact(spark, sf):
    return matched(spark, sf).select("request_id", "title", "matched_id").withColumns(
        _double("matched_id")
    )


# Bit-parallel longest common subsequence: one bit per character of the request, one step
# per character of the title.
SQL_FUZZY = """names AS (SELECT p_name AS title, min(p_partkey) AS first_id FROM part GROUP BY p_name),
requests AS (
  SELECT p_partkey AS request_id, p_partkey % 5 + 1 AS top_n,
    CASE p_partkey % 8 WHEN 1 THEN substr(p_name, 2) WHEN 2 THEN replace(p_name, ' ', '')
      WHEN 3 THEN p_name || 'xx' WHEN 4 THEN {upper} WHEN 5 THEN reverse(p_name)
      WHEN 6 THEN replace(p_name, 'e', 'a')
      WHEN 7 THEN substr(p_name, 1, 3) || 'q' || substr(p_name, 4) ELSE p_name END AS title
  FROM part
),
wanted AS (SELECT DISTINCT title AS query FROM requests),
spots AS (SELECT query, unnest(range(1, 1 + length(query))) AS spot FROM wanted),
masks AS (
  SELECT query, substr(query, spot, 1) AS letter,
    CAST(sum(CAST(pow(2, spot - 1) AS BIGINT)) AS BIGINT) AS mask
  FROM spots GROUP BY query, substr(query, spot, 1)
),
steps AS (
  SELECT query, title, first_id, 0 AS done, CAST(pow(2, length(query)) AS BIGINT) - 1 AS state
  FROM wanted CROSS JOIN names
  UNION ALL
  SELECT steps.query, title, first_id, done + 1,
    ((state + (state & coalesce(mask, 0))) | (state - (state & coalesce(mask, 0))))
      & (CAST(pow(2, length(steps.query)) AS BIGINT) - 1)
  FROM steps LEFT JOIN masks
    ON masks.query = steps.query AND letter = substr(title, done + 1, 1)
  WHERE done < length(title)
),
rated AS (
  SELECT query, title, first_id,
    200.0 * (length(query) - bit_count(state)) / (length(query) + length(title)) AS ratio
  FROM steps WHERE done = length(title)
),
best AS (
  SELECT query, title AS matched_title, ratio, first_id FROM (
    SELECT *, row_number() OVER (PARTITION BY query ORDER BY ratio DESC, first_id) AS place
    FROM rated) AS placed
  WHERE place = 1 AND ratio >= 70
),
fuzzy AS (
  SELECT request_id, title, top_n, matched_title, ratio, first_id AS matched_id
  FROM requests LEFT JOIN best ON query = title
)"""

SQL_FUZZY_AS_TYPED = SQL_FUZZY.replace("{upper}", "upper(p_name)")
SQL_FUZZY_ANY_CASE = SQL_FUZZY.replace("{upper}", "p_name")

SQL_FUZZY_ROWS = """SELECT request_id, matched_title, round(ratio, 6) AS ratio,
  CAST(matched_id AS DOUBLE) AS matched_id FROM fuzzy"""


def _fuzzy_rows(found):
    return found.select(
        "request_id", "matched_title", F.round("ratio", 6).alias("ratio"), "matched_id"
    ).withColumns(_double("matched_id"))


@query("r2_match_fuzzy", f"WITH RECURSIVE {SQL_FUZZY_AS_TYPED} {SQL_FUZZY_ROWS}")
def match_fuzzy(spark, sf):
    return _fuzzy_rows(
        matching.match_fuzzy(fuzzy_requests(spark, sf), named_catalogue(spark, sf))
    )


@query("r2_match_fuzzy_any_case", f"WITH RECURSIVE {SQL_FUZZY_ANY_CASE} {SQL_FUZZY_ROWS}")
def match_fuzzy_any_case(spark, sf):
    found = matching.match_fuzzy(
        fuzzy_requests(spark, sf), named_catalogue(spark, sf), normalize_case=True
    )
    return _fuzzy_rows(found)


@query(
    "r3_check_modeled",
    f"""WITH {SQL_CATALOGUE}, {SQL_CHECKED}
    SELECT request_id, status = 'ok' AS in_model FROM checked WHERE matched_id IS NOT NULL""",
)
def check_modeled(spark, sf):
    modeled = embedding_features(spark, sf).select("id")
    found = matched(spark, sf).filter("matched_id IS NOT NULL")
    return recommend.check_modeled(found, modeled).select("request_id", "in_model")


@query(
    "r4_neighbors_of",
    f"""WITH {SQL_NEIGHBORS}, {SQL_CATALOGUE}
    SELECT request_id, rank, neighbor_id AS id FROM matched JOIN neighbors ON neighbors.id = matched_id""",
)
def neighbors_of(spark, sf):
    rows = recommend.neighbors_of(matched(spark, sf), model(spark, sf))
    return rows.filter("rank IS NOT NULL").select("request_id", "rank", "id")


@query(
    "r5_top_n",
    f"WITH {SQL_ANSWERS} SELECT request_id, rank, id FROM served WHERE rank IS NOT NULL",
)
def top_n(spark, sf):
    return ranked(spark, sf).filter("rank IS NOT NULL").select("request_id", "rank", "id")


@query(
    "r5_top_n_beyond_model",
    f"""WITH {SQL_NEIGHBORS.replace(f"rank <= {TOP_K}", "rank <= 12")}, {SQL_CATALOGUE}
    SELECT request_id, rank, neighbor_id AS id FROM matched
    JOIN neighbors ON neighbors.id = matched_id
    AND rank <= CASE WHEN request_id % 100 = 2 THEN 12 ELSE top_n END""",
)
def top_n_beyond_model(spark, sf):
    """Some requests want more neighbours than the model stores; those are ranked again."""
    deep = F.when(F.col("request_id") % 100 == 2, F.lit(12)).otherwise(F.col("top_n"))
    found = matched(spark, sf).withColumn("top_n", deep)
    served = recommend.extend_neighbors(
        found, model(spark, sf), embedding_features(spark, sf), TOP_K
    )
    rows = recommend.top_n(recommend.neighbors_of(found, served))
    return rows.filter("rank IS NOT NULL").select("request_id", "rank", "id")


@query(
    "r6_attach_metadata",
    f"WITH {SQL_ANSWERS} SELECT {SHOWN}, title, description, tags FROM answers",
)
def attach_metadata(spark, sf):
    return (
        answers(spark, sf)
        .withColumn("tags", F.array_join("tags", "|"))
        .withColumns(_double("rank", "id"))
        .select("request_id", "status", "rank", "id", "title", "description", "tags")
    )


def described(spark, sf):
    """The catalogue without every seventh part, which then is a neighbour without metadata."""
    return catalogue(spark, sf).filter("id % 7 <> 0")


@query(
    "r6_attach_metadata_missing",
    f"""WITH {SQL_ANSWERS} SELECT {SHOWN}, title, description, tags FROM answers
    WHERE id IS NULL OR id % 7 <> 0""",
)
def attach_metadata_missing(spark, sf):
    found = recommend.attach_metadata(ranked(spark, sf), described(spark, sf))
    return (
        found.withColumn("tags", F.array_join("tags", "|"))
        .withColumns(_double("rank", "id"))
        .select("request_id", "status", "rank", "id", "title", "description", "tags")
    )


@query(
    "r7_attach_score",
    f"""WITH {SQL_ANSWERS} SELECT request_id, CAST(id AS DOUBLE) AS id,
      round(score, 6) + 0.0 AS similarity FROM answers""",
)
def attach_score(spark, sf):
    return (
        answers(spark, sf)
        .withColumns(_double("id"))
        .select("request_id", "id", (F.round("similarity", 6) + 0.0).alias("similarity"))
    )


@query(
    "r8_round_score",
    f"WITH {SQL_ANSWERS} SELECT request_id, CAST(rank AS DOUBLE) AS rank, similarity FROM served",
)
def round_score(spark, sf):
    rounded = recommend.round_scores(ranked(spark, sf)).withColumns(_double("rank"))
    return rounded.select("request_id", "rank", (F.col("similarity") + 0.0).alias("similarity"))


@query(
    "r9_order_answer",
    f"""WITH {SQL_ANSWERS} SELECT request_id, CAST(rank AS DOUBLE) AS rank, CAST(id AS DOUBLE) AS id,
      similarity FROM served ORDER BY request_id, rank""",
)
def order_answer(spark, sf):
    rounded = recommend.round_scores(ranked(spark, sf)).withColumns(_double("rank", "id"))
    ordered = recommend.order_answers(rounded)
    return ordered.select("request_id", "rank", "id", (F.col("similarity") + 0.0).alias("similarity"))


RECORD = "struct<id bigint, title string, description string, tags array<string>, similarity double>"
SQL_RECORD = """coalesce(title, '') || '|' || coalesce(description, '') || '|' || coalesce(tags, '')"""


def _shown_record(record):
    parts = (record["title"], record["description"], F.array_join(record["tags"], "|"))
    return F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts])


@query(
    "r10_to_records",
    f"""WITH {SQL_ANSWERS} SELECT request_id, count(*) AS n_records, sum(similarity) AS similarity,
      string_agg(CAST(id AS VARCHAR) || ':' || {SQL_RECORD}, ';' ORDER BY rank) AS records
    FROM answers WHERE status = 'ok' GROUP BY request_id""",
)
def to_records(spark, sf):
    """Records per request; the JSON is parsed again so that its content can be compared."""
    records = recommend.to_records(recommend.round_scores(answers(spark, sf)))
    parsed = F.from_json("recommendations", f"array<{RECORD}>")
    shown = F.transform("parsed", lambda r: F.concat(r["id"].cast("string"), F.lit(":"), _shown_record(r)))
    return records.withColumn("parsed", parsed).select(
        "request_id",
        F.size("parsed").cast("bigint").alias("n_records"),
        F.aggregate("parsed", F.lit(0.0), lambda total, r: total + r["similarity"]).alias("similarity"),
        F.array_join(shown, ";").alias("records"),
    )


@query(
    "r10_record_rows",
    f"""WITH {SQL_ANSWERS} SELECT request_id, rank, id, similarity, {SQL_RECORD} AS record
    FROM answers WHERE status = 'ok'""",
)
def record_rows(spark, sf):
    """A record per row, each parsed again."""
    rows = recommend.record_rows(recommend.round_scores(answers(spark, sf)))
    record = F.from_json("record", RECORD)
    return rows.select("request_id", "rank", record.alias("r")).select(
        "request_id",
        "rank",
        "r.id",
        (F.col("r.similarity") + 0.0).alias("similarity"),
        _shown_record(F.col("r")).alias("record"),
    )


@query(
    "r11_render_tags",
    f"""WITH {SQL_ANSWERS} SELECT request_id, rank, replace(tags, '|', ', ') AS tags
    FROM answers WHERE tags IS NOT NULL""",
)
def render_tags(spark, sf):
    rows = answers(spark, sf).filter("tags IS NOT NULL")
    return rows.select("request_id", "rank", text.render_tags(F.col("tags")).alias("tags"))


@query(
    "r12_percent_score",
    f"""WITH {SQL_ANSWERS} SELECT request_id, rank,
      CAST(floor(similarity * 100 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS percent
    FROM served WHERE rank IS NOT NULL""",
)
def percent_score(spark, sf):
    rows = recommend.round_scores(ranked(spark, sf)).filter("rank IS NOT NULL")
    percent = numbers.percent_score(F.col("similarity"))
    return rows.select("request_id", "rank", percent.alias("percent"))


@query(
    "r13_lookup_status",
    f"WITH {SQL_CATALOGUE}, {SQL_CHECKED} SELECT request_id, status FROM checked",
)
def lookup_status(spark, sf):
    return checked(spark, sf).select("request_id", "status")


def _shown(found):
    return (
        found.withColumn("tags", F.array_join("tags", "|"))
        .withColumn("similarity", F.col("similarity") + 0.0)
        .withColumns(_double("rank", "id"))
    )


@query(
    "r14_recommend_exact",
    f"WITH {SQL_ANSWERS} SELECT {SHOWN}, title, description, tags, similarity FROM answers",
)
def recommend_exact(spark, sf):
    return _shown(
        recommend.recommend_exact(exact_requests(spark, sf), model(spark, sf), catalogue(spark, sf))
    )


@query(
    "r15_recommend_fuzzy",
    f"""WITH RECURSIVE {SQL_FUZZY_AS_TYPED}, {SQL_NEIGHBORS},
    checked AS (
      SELECT request_id, top_n, matched_id,
        CASE WHEN matched_id IS NULL THEN 'title_not_found'
             WHEN vec_id IS NULL THEN 'not_in_model' ELSE 'ok' END AS status
      FROM fuzzy LEFT JOIN embeddings ON vec_id = matched_id
    )
    SELECT request_id, status, CAST(rank AS DOUBLE) AS rank, CAST(neighbor_id AS DOUBLE) AS id,
      p_name AS title, 'A ' || lower(p_type) || ' ' || p_name AS description,
      replace(p_name, ' ', '|') AS tags,
      round_even(round(similarity, 10) * 100, 0) / 100 + 0.0 AS similarity
    FROM checked
    LEFT JOIN neighbors ON neighbors.id = matched_id AND rank <= top_n
    LEFT JOIN part ON p_partkey = neighbor_id
    WHERE neighbor_id IS NULL OR p_partkey IS NOT NULL""",
)
def recommend_fuzzy(spark, sf):
    return _shown(
        recommend.recommend_fuzzy(
            fuzzy_requests(spark, sf), model(spark, sf), named_catalogue(spark, sf)
        )
    )

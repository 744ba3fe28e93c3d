"""The pipeline's stages as jobs.  Each reads what the stage before it published and writes its own.

A stage is one lazy plan between two snapshots; a lost executor costs its tasks, and a lost
job is rerun from the snapshot before it.  The last thing a stage writes is a manifest that names
its snapshots and those they were made from; the next stage reads by it, so tables of different
runs never meet.  What a stage counted while it wrote goes to the ledger under the id of the run
(the date, unless one is given), where a repeated run replaces its record.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfkin import schemas
from shelfkin.operators import features as feat
from shelfkin.operators import interactions, items, recommend, similarity
from shelfkin.operators.matching import (
    FUZZY_THRESHOLD,
    distinct_titles,
    first_ids,
    match_exact,
    match_fuzzy,
)
from shelfkin.sources import landing, metrics
from shelfkin.sources.metrics import StageRows
from shelfkin.sources.snapshots import (
    CLEANED,
    FEATURES,
    MODELS,
    RAW,
    Snapshot,
    read,
    read_manifest,
    stored,
    temporary_tables,
    write_manifest,
    write_snapshot,
)

# Dataset names.
ITEMS, INTERACTIONS = "items", "interactions"
ITEM_FEATURES, USER_FEATURES, VOCAB, SCALER = "item_features", "user_features", "vocab", "scaler"
NEIGHBORS, DEPTH, RUN_METRICS, TITLES, FIRST_IDS = "neighbors", "depth", "run_metrics", "titles", "first_ids"
FEATURE_STORE = "parquet"
LEDGER = "ledger"

DEFAULT_NEIGHBORS = 50


class _Stage:
    """The snapshots a stage writes, and what it counts while it writes them."""

    def __init__(self, spark: SparkSession, root: str, status: str, date: datetime.date | None, run_id: str | None):
        self.spark, self.root, self.status, self.date = spark, root, status, date or datetime.date.today()
        self.run_id = run_id or self.date.isoformat()
        self.sources: dict[tuple[str, str], Snapshot] = {}
        self.written: list[Snapshot] = []
        self.rows: list[StageRows] = []

    def reads(self, status: str) -> None:
        """Read by the latest manifest of the stage before."""
        self.sources = read_manifest(self.spark, self.root, status)

    def source(self, status: str, name: str) -> DataFrame:
        if (status, name) not in self.sources:
            raise FileNotFoundError(f"the manifest names no {name} under {status}")
        return read(self.spark, self.root, self.sources[status, name])

    def write(
        self, df: DataFrame, name: str, rows_in: Observation | None = None, key: str | None = None
    ) -> int:
        """Write a snapshot; its rows, and those of the source observed, are counted on the way.

        With `key` it is stored in buckets, for lookups by that column.
        """
        seen = Observation(f"{self.status}-{name}")
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        self.written.append(write_snapshot(counted, self.root, self.status, name, self.date, key))
        rows = seen.get["rows"]
        before = None if rows_in is None else rows_in.get["rows"]
        self.rows.append(StageRows(name, before, rows, None if before is None else before - rows))
        return rows

    def close(self, stage: str) -> None:
        """Publish the manifest, then the ledger's record."""
        named = {**self.sources, **{(s.status, s.dataset): s for s in self.written}}
        write_manifest(self.spark, self.root, self.status, named.values(), self.date)
        metrics.record_stage(self.spark, f"{self.root}/{LEDGER}", self.run_id, stage, self.rows)


def _observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def ingest(
    spark: SparkSession,
    root: str,
    item_pages: str,
    interaction_pages: str,
    min_score: int,
    min_popularity: int,
    max_pages: int,
    users: tuple[int, int] | None = None,
    date: datetime.date | None = None,
    run_id: str | None = None,
) -> dict[str, int]:
    """Landed response files (a response per line) to raw snapshots.

    Returns the rows of each snapshot, and how many items and pages each threshold left out.
    Responses with an error, malformed ones and interaction pages without a page number are
    stored in quarantine.  Every page but a user's last is full, so the cap on rows is a cap on
    page numbers.
    """
    stage = _Stage(spark, root, RAW, date, run_id)
    item_responses = landing.scan_json(spark, item_pages, schemas.ITEM_RESPONSE, lines=True)
    landed = landing.flatten_pages(landing.response_rows(item_responses), "data.Page.media")
    scored, popular = landing.is_popular(min_score, min_popularity)
    seen = Observation("landed items")
    landed = landed.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~scored).alias("items_low_score"),
        F.count_if(~popular).alias("items_unpopular"),
    )
    raw_items = landing.whole_numbers(
        landing.source_filter_items(landed, min_score, min_popularity), schemas.RAW_ITEM
    )
    counts = {"items": stage.write(raw_items, ITEMS, seen)}
    counts |= {name: n for name, n in seen.get.items() if name != "rows"}
    responses = landing.scan_json(
        spark, interaction_pages, schemas.INTERACTION_RESPONSE, lines=True
    )
    if users is not None:
        in_range = F.col("userId").isNull() | F.col("userId").between(*users)
        responses = responses.filter(in_range)  # what names no user goes to quarantine
    late = Observation("landed pages")
    pages = landing.response_rows(responses).observe(
        late, F.count_if(F.col("page") > max_pages).alias("pages_over_cap")
    )
    raw_interactions = landing.flatten_pages(
        pages.filter(F.col("page") <= max_pages), "data.Page.mediaList"
    )
    counts |= {"interactions": stage.write(raw_interactions, INTERACTIONS), **late.get}
    for name, failed in (
        ("skipped_users", landing.skipped_users(responses)),
        ("quarantined_items", landing.quarantine(item_responses)),
        ("quarantined_interactions", landing.quarantine(responses)),
    ):
        counts[name] = stage.write(failed, name)
    stage.close("ingest")
    return counts


def clean(
    spark: SparkSession, root: str, date: datetime.date | None = None, run_id: str | None = None
) -> dict[str, int]:
    stage = _Stage(spark, root, CLEANED, date, run_id)
    stage.reads(RAW)
    raw_items, items_in = _observed(stage.source(RAW, ITEMS), "raw items")
    raw_reads, reads_in = _observed(stage.source(RAW, INTERACTIONS), "raw interactions")
    counts = {"items": stage.write(items.clean_items(raw_items), ITEMS, items_in, "id")}
    written = read(spark, root, stage.written[0])
    stage.write(distinct_titles(written), TITLES)  # for fuzzy requests, made once
    stage.write(first_ids(written), FIRST_IDS, key="known_title")  # and for exact ones
    counts["interactions"] = stage.write(interactions.clean_interactions(raw_reads), INTERACTIONS, reads_in)
    stage.close("clean")
    return counts


def build_features(
    spark: SparkSession, root: str, date: datetime.date | None = None, run_id: str | None = None
) -> dict[str, int]:
    stage = _Stage(spark, root, FEATURES, date, run_id)
    stage.reads(CLEANED)
    with temporary_tables(spark):
        clean_items, items_in = _observed(stage.source(CLEANED, ITEMS), "clean items")
        clean_reads, reads_in = _observed(stage.source(CLEANED, INTERACTIONS), "clean interactions")
        features, params = feat.item_features(clean_items)
        counts = {
            "item_features": stage.write(features, ITEM_FEATURES, items_in),
            "vocab": stage.write(params.vocab, VOCAB),
            "scaler": stage.write(params.scaler, SCALER),
            "user_features": stage.write(feat.user_features(clean_reads), USER_FEATURES, reads_in),
        }
    stage.close("features")
    return counts


def run_pipeline(
    spark: SparkSession, root: str, item_pages: str, interaction_pages: str, **options
) -> dict[str, dict[str, int]]:
    """Ingest, clean and features, in order."""
    date, run_id = options.get("date"), options.get("run_id")
    return {
        "ingest": ingest(spark, root, item_pages, interaction_pages, **options),
        "clean": clean(spark, root, date, run_id),
        "features": build_features(spark, root, date, run_id),
    }


def train(
    spark: SparkSession,
    root: str,
    k: int = DEFAULT_NEIGHBORS,
    date: datetime.date | None = None,
    feature_store: str = FEATURE_STORE,
    run_id: str | None = None,
) -> dict[str, int]:
    """Features to a snapshot of the k best neighbours of every item, an empty row where it has none.

    The run is recorded, with the name given to the feature store, after its model is written.
    """
    stage = _Stage(spark, root, MODELS, date, run_id)
    stage.reads(FEATURES)
    features, items_in = _observed(stage.source(FEATURES, ITEM_FEATURES), "item features")
    similarity.assert_unique_ids(features)
    with temporary_tables(spark):
        neighbors = stored(similarity.topk_neighbors(features, k), "neighbors")
        alone = recommend.without_neighbors(features, neighbors)
        model = neighbors.unionByName(alone, allowMissingColumns=True)
        rows = stage.write(model, NEIGHBORS, key="id")
    stage.write(spark.createDataFrame([(k,)], "k int").coalesce(1), DEPTH)
    run = metrics.run_metrics(
        stage.source(FEATURES, ITEM_FEATURES), stage.source(FEATURES, VOCAB), len(feat.NUMERIC_COLUMNS), feature_store
    )
    record = run.withColumn("run_at", F.current_timestamp())
    metrics.record_run(record, f"{root}/{MODELS}/{RUN_METRICS}", stage.run_id)
    stage.rows[0] = stage.rows[0]._replace(rows_in=items_in.get["rows"])
    stage.close("train")
    return {"neighbors": rows}


def recommend_batch(
    spark: SparkSession,
    root: str,
    requests: DataFrame,
    fuzzy: bool = True,
    threshold: int = FUZZY_THRESHOLD,
    normalize_case: bool = False,
) -> DataFrame:
    """Answers to a table of requests from the latest model, however large their `top_n`.

    The model's manifest names the titles, items and features it was made from; newer ones wait
    for a model of their own.
    """
    named = read_manifest(spark, root, MODELS)

    def of_model(status: str, name: str) -> DataFrame:
        return read(spark, root, named[status, name])

    metadata, features = of_model(CLEANED, ITEMS), of_model(FEATURES, ITEM_FEATURES)
    neighbors = of_model(MODELS, NEIGHBORS)
    asked = recommend.valid_requests(requests)
    if fuzzy:
        titles = of_model(CLEANED, TITLES)
        matched = match_fuzzy(asked, metadata, threshold, normalize_case, titles)
    else:
        matched = match_exact(asked, metadata, of_model(CLEANED, FIRST_IDS))
    ranks = of_model(MODELS, DEPTH).first().k
    matched = stored(matched, "matched")
    answers = recommend.answer_placed(matched, neighbors, metadata, features, ranks)
    return recommend.order_answers(answers)

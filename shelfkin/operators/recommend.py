"""Batch recommendation: a table of requests in, a table of answers out.

Requests are `(request_id, title, top_n)`.  A request that cannot be answered keeps its row
with the reason in `status`; data conditions never raise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfkin.functions import numbers
from shelfkin.operators.frames import lookup_join, lookup_placed
from shelfkin.operators.matching import FUZZY_THRESHOLD, match_exact, match_fuzzy
from shelfkin.operators.similarity import topk_for
from shelfkin.sources.snapshots import stored

DEFAULT_TOP_N = 5

LookUp = Callable[..., DataFrame]  # `lookup_join` or `lookup_placed`

OK, TITLE_NOT_FOUND, NOT_IN_MODEL = "ok", "title_not_found", "not_in_model"


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests with `top_n` filled in; a `top_n` below 1 stops the job."""
    top_n = F.coalesce("top_n", F.lit(DEFAULT_TOP_N))
    message = F.lit("top_n must be at least 1")
    return requests.withColumn("top_n", F.when(top_n >= 1, top_n).otherwise(F.raise_error(message)))


def check_modeled(matched: DataFrame, modeled_ids: DataFrame) -> DataFrame:
    """Adds `in_model`: whether the matched item has a row in the model."""
    known = modeled_ids.select(F.col("id").alias("modeled_id"), F.lit(True).alias("in_model"))
    joined = lookup_join(matched, known, "matched_id", "modeled_id", ["request_id"])
    return joined.withColumn("in_model", F.coalesce("in_model", F.lit(False)))


def lookup_status(checked: DataFrame) -> DataFrame:
    """Adds `status`: ok, title_not_found or not_in_model."""
    status = (
        F.when(F.col("matched_id").isNull(), TITLE_NOT_FOUND)
        .when(~F.col("in_model"), NOT_IN_MODEL)
        .otherwise(OK)
    )
    return checked.withColumn("status", status).drop("in_model")


def neighbors_of(matched: DataFrame, neighbors: DataFrame) -> DataFrame:
    """The stored neighbours of each matched item; requests without any keep one row."""
    model = neighbors.select(
        F.col("id").alias("owner_id"),
        F.col("neighbor_id").alias("id"),
        "similarity",
        "rank",
    )
    return lookup_join(matched, model, "matched_id", "owner_id", ["request_id"])


def top_n(ranked: DataFrame) -> DataFrame:
    """The first `top_n` neighbours of each request; rows without a neighbour stay."""
    return ranked.filter(F.col("rank").isNull() | (F.col("rank") <= F.col("top_n")))


def attach_metadata(ranked: DataFrame, metadata: DataFrame, look_up: LookUp = lookup_join) -> DataFrame:
    """Title, description and tags of each recommended item, next to its score.

    An item without metadata is left out; rows without a neighbour stay.
    """
    details = metadata.select(
        F.col("id").alias("item_id"), "title", "description", "tags", F.lit(True).alias("described")
    )
    asked = ranked.withColumnRenamed("title", "request_title")
    joined = look_up(asked, details, "id", "item_id", ["request_id", "rank"])
    return joined.filter("id IS NULL OR described").drop("described")


def round_scores(answers: DataFrame) -> DataFrame:
    return answers.withColumn("similarity", numbers.round_score(F.col("similarity")))


def order_answers(answers: DataFrame) -> DataFrame:
    """By request and rank.  The rank is by unrounded score, so rounded scores descend."""
    return answers.orderBy("request_id", "rank")


def record_rows(answers: DataFrame) -> DataFrame:
    """`(request_id, rank, record)`: each recommendation as JSON, by request and rank."""
    record = F.to_json(F.struct("id", "title", "description", "tags", "similarity"))
    rows = answers.filter((F.col("status") == OK) & F.col("id").isNotNull())
    return rows.select("request_id", "rank", record.alias("record")).orderBy("request_id", "rank")


def to_records(answers: DataFrame) -> DataFrame:
    """One row per answered request with its records as one JSON array, in order of rank.

    The array of a request has `top_n` records; where that is not small use `record_rows`.
    """
    record = F.struct("rank", "id", "title", "description", "tags", "similarity")
    grouped = answers.filter(F.col("status") == OK).groupBy("request_id").agg(
        F.sort_array(F.collect_list(record)).alias("records")  # at most top_n of them
    )
    kept = F.transform(
        "records",
        lambda r: F.struct(r["id"].alias("id"), r["title"].alias("title"),
                           r["description"].alias("description"), r["tags"].alias("tags"),
                           r["similarity"].alias("similarity")),
    )
    return grouped.select("request_id", F.to_json(kept).alias("recommendations"))


def answer(
    matched: DataFrame,
    neighbors: DataFrame,
    metadata: DataFrame,
    modeled_ids: DataFrame | None = None,
) -> DataFrame:
    """Answers for requests whose `matched_id` is known; `matched` should be a table.

    `modeled_ids(id)` lists the items of the model; without it, those that have neighbours.
    Whether an item is in the model and what its neighbours are is found in one lookup: an item
    of the model without neighbours is given one empty row.
    """
    model = neighbors.select("id", "neighbor_id", "similarity", "rank")
    if modeled_ids is not None:
        model = model.unionByName(without_neighbors(modeled_ids, model), allowMissingColumns=True)
    return _with_details(_found(matched, model, lookup_join), metadata, lookup_join)


def without_neighbors(modeled_ids: DataFrame, neighbors: DataFrame) -> DataFrame:
    """`(id)`: items of the model that have no neighbour, as in a catalogue of one."""
    return modeled_ids.select("id").join(neighbors.filter(F.col("rank") == 1), "id", "left_anti")


def answer_placed(matched: DataFrame, model: DataFrame, metadata: DataFrame, features: DataFrame, stored_ranks: int) -> DataFrame:
    """The same where model and metadata are stored in buckets of their id.

    `model` holds the neighbours and an empty row for each item that has none.  A batch moves its
    own rows only.  Requests for more than the stored neighbours are answered from neighbours
    found anew (see `deep_items`).
    """
    deep = deep_items(matched, stored_ranks)
    if deep.isEmpty():
        return _with_details(_found(matched, model, lookup_placed), metadata, lookup_placed)
    shallow = matched.join(deep, F.col("matched_id") == deep.id, "left_anti")
    deeper = matched.join(deep, F.col("matched_id") == deep.id, "left_semi")
    anew = stored(neighbors_anew(deep, features), "anew")
    anew = anew.unionByName(deep.select("id").join(anew, "id", "left_anti"), allowMissingColumns=True)
    known = features.select("id")
    anew = anew.join(known, "id", "left_semi")
    found = _found(stored(shallow, "shallow"), model, lookup_placed)
    found = found.unionByName(_found(stored(deeper, "deeper"), anew, lookup_join))
    return _with_details(found, metadata, lookup_placed)


def _found(matched: DataFrame, model: DataFrame, look_up: LookUp) -> DataFrame:
    """Requests with their status and their first `top_n` neighbours."""
    rows = model.select(
        F.col("id").alias("owner_id"),
        F.col("neighbor_id").alias("id"),
        "similarity",
        "rank",
        F.lit(True).alias("in_model"),
    )
    requests = matched.select("request_id", "title", "top_n", "matched_id")
    found = look_up(requests, rows, "matched_id", "owner_id", ["request_id"])
    return top_n(lookup_status(found.withColumn("in_model", F.coalesce("in_model", F.lit(False)))))


def _with_details(found: DataFrame, metadata: DataFrame, look_up: LookUp) -> DataFrame:
    # The next lookup reads its left side more than once, so it becomes a table.
    return round_scores(attach_metadata(stored(found, "ranked"), metadata, look_up)).select(
        "request_id", "status", "rank", "id", "title", "description", "tags", "similarity"
    )


def recommend_exact(requests: DataFrame, neighbors: DataFrame, metadata: DataFrame) -> DataFrame:
    """Answers to requests that name a title exactly, whatever its case."""
    matched = stored(match_exact(valid_requests(requests), metadata), "matched")
    return order_answers(answer(matched, neighbors, metadata))


def recommend_fuzzy(
    requests: DataFrame,
    neighbors: DataFrame,
    metadata: DataFrame,
    threshold: int = FUZZY_THRESHOLD,
    normalize_case: bool = False,
) -> DataFrame:
    """Answers to requests that come close to a title."""
    matched = match_fuzzy(valid_requests(requests), metadata, threshold, normalize_case)
    matched = stored(matched, "matched")
    return order_answers(answer(matched, neighbors, metadata))


def extend_neighbors(
    matched: DataFrame, neighbors: DataFrame, features: DataFrame, stored_ranks: int
) -> DataFrame:
    """Neighbour table that also serves requests for more than the stored neighbours.

    Only the items such requests name are ranked again, each to the depth of its largest request,
    in one pass over the catalogue; none are where the model holds all there are.
    """
    deep = deep_items(matched, stored_ranks)
    if stored_ranks >= features.count() - 1 or deep.isEmpty():
        return neighbors
    return neighbors.join(deep, "id", "left_anti").unionByName(neighbors_anew(deep, features))


def deep_items(matched: DataFrame, stored_ranks: int) -> DataFrame:
    """`(id, depth)` of the items that some request wants more neighbours of than are stored."""
    deep = matched.filter((F.col("top_n") > stored_ranks) & F.col("matched_id").isNotNull())
    return stored(deep.groupBy(F.col("matched_id").alias("id")).agg(F.max("top_n").alias("depth")), "deep")


def neighbors_anew(deep: DataFrame, features: DataFrame) -> DataFrame:
    return topk_for(stored(features.join(deep, "id"), "asked"), features)

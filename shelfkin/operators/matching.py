"""Titles to items: exact lookup, and best fuzzy match by indel similarity.

The fuzzy match is exact as well: it finds the best title of all.  Requests that equal a
title are settled by a join.  The others meet only titles of a compatible length, block by
block; inside a tile an upper bound from character counts decides which pairs are aligned.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfkin.operators.frames import lookup_join, lookup_placed
from shelfkin.operators.tiles import TILE, spread
from shelfkin.sources.snapshots import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FUZZY_THRESHOLD = 70

BLOCK_CHARS = 1 << 20  # characters of titles or requests in one block
BLOCK_TITLES = 1 << 14  # titles or requests in one block
LENGTH_STEP = 1.3  # lengths within one bucket differ by at most this factor
PAIRS_AT_ONCE = 1 << 20  # pairs scored in one numpy step
MASK_WORDS = 1 << 22  # 64-bit words of query masks held at a time
CHARACTER_CLASSES = 256  # columns of the character counts

MATCH_SCHEMA = (
    "query string, matched_title string, ratio double, title_id bigint, owner_id bigint"
)


def first_ids(metadata: DataFrame) -> DataFrame:
    """`(known_title, first_id)`: the smallest id of each title, without null titles."""
    titles = metadata.filter(F.col("title").isNotNull())
    return titles.groupBy(F.lower("title").alias("known_title")).agg(F.min("id").alias("first_id"))


def match_exact(requests: DataFrame, metadata: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Requests with `matched_id`, the first item of that title whatever its case, or null.

    `known` is a `first_ids(metadata)` stored in buckets of its title, if there is one.
    """
    keyed = requests.withColumn("title_key", F.lower("title"))
    look_up, right = (lookup_join, first_ids(metadata)) if known is None else (lookup_placed, known)
    matched = look_up(keyed, right, "title_key", "known_title", ["request_id"])
    return matched.withColumnRenamed("first_id", "matched_id").drop("title_key")


def match_fuzzy(
    requests: DataFrame,
    metadata: DataFrame,
    threshold: int = FUZZY_THRESHOLD,
    normalize_case: bool = False,
    titles: DataFrame | None = None,
) -> DataFrame:
    """Requests with `matched_title`, `ratio` and `matched_id` of the best title, or nulls.

    The ratio is 100 * 2 * LCS / (sum of lengths); below the threshold there is no match,
    and equal ratios go to the title with the smallest id.  Requests are compared as typed
    unless `normalize_case` is set.  `titles` is a stored `distinct_titles(metadata)`, if there
    is one; without it the titles are made from the metadata.
    """
    query = F.lower("title") if normalize_case else F.col("title")
    keyed = requests.withColumn("query", query)
    queries = keyed.select("query").filter(F.col("query").isNotNull()).distinct()
    known = titles if titles is not None else stored(distinct_titles(metadata), "titles")
    best = best_titles(queries, known, threshold).select(
        F.col("query").alias("known_query"),
        "matched_title",
        "ratio",
        F.col("owner_id").alias("matched_id"),
    )
    return lookup_join(keyed, best, "query", "known_query", ["request_id"]).drop("query")


def distinct_titles(metadata: DataFrame) -> DataFrame:
    """Each title once: `title_id` is its first id, `owner_id` the first whatever the case."""
    any_case = Window.partitionBy(F.lower("title"))
    return (
        metadata.filter(F.col("title").isNotNull())
        .groupBy("title")
        .agg(F.min("id").alias("title_id"))
        .withColumn("owner_id", F.min("title_id").over(any_case))
    )


def best_titles(queries: DataFrame, titles: DataFrame, threshold: int) -> DataFrame:
    """Best title at or above the threshold for each distinct query.

    `queries(query)` and `titles(title, title_id, owner_id)` hold each string once.  Titles are
    read several times, so they should be a table.
    """
    same = F.col("query") == F.col("title")
    looked_up = stored(queries.join(titles, same, "left"), "queries")
    found = F.col("title").isNotNull()
    equal = looked_up.filter(found).select(
        "query", F.col("title").alias("matched_title"), F.lit(100.0).alias("ratio"), "owner_id"
    )
    rest = looked_up.filter(~found).select("query")
    tiles = _tiles(rest, titles, threshold)
    if tiles is None:
        return equal
    left, right = tiles
    rated = left.groupBy(*TILE).cogroup(right.groupBy(*TILE)).applyInArrow(
        _tile_matches(threshold), MATCH_SCHEMA
    )
    order = Window.partitionBy("query").orderBy(F.desc("ratio"), "title_id")
    near = rated.withColumn("place", F.row_number().over(order)).filter(F.col("place") == 1)
    return equal.unionByName(near.select(equal.columns))


def _length_bucket(text: str):
    return F.floor(F.log(LENGTH_STEP, F.length(text) + 1)).cast("int")


def _buckets(queries: DataFrame, titles: DataFrame) -> tuple[list, list]:
    """Length statistics of both sides, a row per bucket.

    At most 82 rows a side reach the driver, as lengths are below 2**31.
    """
    both = queries.select(F.lit("query").alias("side"), F.col("query").alias("text")).unionAll(
        titles.select(F.lit("title").alias("side"), F.col("title").alias("text"))
    )
    rows = (
        both.groupBy("side", _length_bucket("text").alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.length("text")).alias("chars"),
            F.min(F.length("text")).alias("shortest"),
            F.max(F.length("text")).alias("longest"),
        )
        .collect()
    )
    return [r for r in rows if r.side == "query"], [r for r in rows if r.side == "title"]


def _compatible(a, b, threshold: int) -> bool:
    """Whether some lengths of the two buckets can reach the threshold together."""
    short, long = (a, b) if a.shortest <= b.shortest else (b, a)
    gap_short, gap_long = short.longest, long.shortest
    if gap_short >= gap_long:
        return True  # the length ranges overlap
    return 200 * gap_short >= threshold * (gap_short + gap_long)


def _blocks_of(bucket) -> int:
    return int(max(1, -(-bucket.n // BLOCK_TITLES), -(-bucket.chars // BLOCK_CHARS)))


def _tiles(queries: DataFrame, titles: DataFrame, threshold: int):
    """Both sides keyed by tile: (length bucket, block) of a title x the same of a query."""
    spark = queries.sparkSession
    query_buckets, title_buckets = _buckets(queries, titles)
    pairs, count = [], 0
    for q in query_buckets:
        for t in title_buckets:
            if _compatible(q, t, threshold):
                q_blocks, t_blocks = _blocks_of(q), _blocks_of(t)
                pairs.append((q.bucket, t.bucket, q_blocks, t_blocks, count))
                count += q_blocks * t_blocks
    if not pairs:
        return None
    # At most 82 x 82 rows, whatever the data; `first` numbers the tiles of each pair.
    plan = spark.createDataFrame(
        pairs, "q_bucket int, t_bucket int, q_blocks int, t_blocks int, first int"
    )

    def keyed(df: DataFrame, text: str, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64(text), F.col(f"{own}_blocks")).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))
        tiled = (
            df.withColumn("bucket", _length_bucket(text))
            .join(F.broadcast(plan), F.col("bucket") == F.col(f"{own}_bucket"))
            .withColumn(f"{own}_block", block)
            .withColumn(f"{other}_block", copies)
            .withColumn("tile", F.col("first") + F.col("q_block") * F.col("t_blocks") + F.col("t_block"))
        )
        return spread(tiled.select("tile", *df.columns), count)

    return keyed(queries, "query", "q", "t"), keyed(titles, "title", "t", "q")


class _Strings:
    """Strings of a tile as a matrix of alphabet positions; 0 pads the ends."""

    def __init__(self, texts: list[str], alphabet: np.ndarray):
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        self.code = np.zeros((len(texts), int(self.length.max(initial=0))), dtype=np.int32)
        points = _code_points(texts)
        self.words = max(1, -(-self.code.shape[1] // 64))  # 64-bit words per string
        inside = np.arange(self.code.shape[1]) < self.length[:, None]
        self.code[inside] = np.searchsorted(alphabet, points) + 1

    def counts(self) -> np.ndarray:
        """Characters of each class, by string.

        A class is a position modulo CHARACTER_CLASSES.  Characters that share a class can
        only raise the bound made from these counts, so it stays a bound.
        """
        n, width = len(self.length), CHARACTER_CLASSES + 1
        kind = np.where(self.code > 0, (self.code - 1) % CHARACTER_CLASSES + 1, 0)
        flat = kind + np.arange(n)[:, None] * width
        return np.bincount(flat.ravel(), minlength=n * width).reshape(n, width)[:, 1:]


def _code_points(texts: list[str]) -> np.ndarray:
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, dtype="<u4")


def _common_characters(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum over characters of the smaller count, for every pair: never below the LCS.

    Written as a product: min(a, b) is the number of levels that both counts reach.
    """
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    for level in range(1, int(min(left.max(initial=0), right.max(initial=0))) + 1):
        used = np.flatnonzero((left >= level).any(axis=0) & (right >= level).any(axis=0))
        if len(used):
            total += (left[:, used] >= level).astype(np.float32) @ (
                right[:, used] >= level
            ).astype(np.float32).T
    return total.astype(np.int64)


def _lcs(queries: _Strings, titles: _Strings, q: np.ndarray, t: np.ndarray, size: int):
    """Longest common subsequence of the pairs (q[i], t[i]), bit-parallel over the query.

    Each query is a row of 64-bit words; a zero bit in the state marks one more common
    character, and one step takes in one character of every title at once.
    """
    words = queries.words
    rows, at = np.unique(q, return_inverse=True)
    masks = np.zeros((len(rows), size + 1, words), dtype=np.uint64)
    for j in range(queries.code.shape[1]):
        letter = queries.code[rows, j]
        live = letter > 0
        masks[np.flatnonzero(live), letter[live], j // 64] |= np.uint64(1 << (j % 64))
    state = np.full((words, len(q)), ~np.uint64(0))
    for j in range(int(titles.length[t].max(initial=0))):
        mask = masks[at, titles.code[t, j]]
        carry = np.zeros(len(q), dtype=np.uint64)
        for w in range(words):
            hit = state[w] & mask[:, w]
            total = state[w] + hit
            over = total < hit
            total += carry
            carry = (over | (total < carry)).astype(np.uint64)
            state[w] = total | (state[w] - hit)
    return np.bitwise_count(~state).sum(axis=0).astype(np.int64)


def _tile_matches(threshold: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best title of a tile for each query of it, if one reaches the threshold."""

    def matches(query_table: pa.Table, title_table: pa.Table) -> pa.Table:
        query_text = query_table["query"].to_pylist()
        title_text = title_table["title"].to_pylist()
        ids, owners = (title_table[c].to_numpy() for c in ("title_id", "owner_id"))
        best = np.full(len(query_text), -1.0)
        chosen = np.zeros(len(query_text), dtype=np.int64)
        if query_text and title_text:
            alphabet = np.unique(_code_points(query_text + title_text))
            queries, titles = _Strings(query_text, alphabet), _Strings(title_text, alphabet)
            size = len(alphabet)
            title_counts, query_counts = titles.counts(), queries.counts()
            at_once = max(1, PAIRS_AT_ONCE // queries.words)
            most = MASK_WORDS // (queries.words * (size + 1))
            step = max(1, min(PAIRS_AT_ONCE // len(title_text), most))
            for start in range(0, len(query_text), step):
                rows = np.arange(start, min(start + step, len(query_text)))
                total = queries.length[rows, None] + titles.length
                bound = 2 * _common_characters(query_counts[rows], title_counts)
                bound = np.where(total > 0, 100.0 * bound / np.maximum(total, 1), 100.0)
                # First the most promising title of each query, then all that may beat it.
                first = bound.argmax(axis=1)
                for attempt in ("promising", "remaining"):
                    if attempt == "promising":
                        r, t = np.arange(len(rows)), first
                    else:
                        r, t = np.nonzero(bound >= np.maximum(best[rows], threshold)[:, None])
                    lcs = np.concatenate(
                        [
                            _lcs(queries, titles, rows[r[i : i + at_once]], t[i : i + at_once], size)
                            for i in range(0, max(1, len(r)), at_once)
                        ]
                    )
                    length = total[r, t]
                    ratio = np.where(length > 0, 200.0 * lcs / np.maximum(length, 1), 100.0)
                    order = np.lexsort((ids[t], -ratio, r))
                    r, t, ratio = r[order], t[order], ratio[order]
                    lead = np.flatnonzero(np.diff(r, prepend=-1))
                    r, t, ratio = rows[r[lead]], t[lead], ratio[lead]
                    better = (ratio > best[r]) | ((ratio == best[r]) & (ids[t] < ids[chosen[r]]))
                    best[r[better]], chosen[r[better]] = ratio[better], t[better]
        keep = np.flatnonzero(best >= threshold)
        return pa.table(
            {
                "query": pa.array([query_text[i] for i in keep], pa.string()),
                "matched_title": pa.array([title_text[chosen[i]] for i in keep], pa.string()),
                "ratio": pa.array(best[keep], pa.float64()),
                "title_id": pa.array(ids[chosen[keep]], pa.int64()),
                "owner_id": pa.array(owners[chosen[keep]], pa.int64()),
            }
        )

    return matches

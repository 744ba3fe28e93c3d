"""Exact top-k by inner product, with norm order and Cauchy-Schwarz bounds.

Vectors are turned to whole numbers, so that scores are exact.  They are rotated by the
eigenvectors of their second moments (the right singular vectors of the whole table), which puts
most of a product into the first few coordinates.  A task takes its candidates by descending
length; for each block of them the product over the first coordinates plus the product of the
residual lengths bounds the score, and only pairs whose bound reaches the query's k-th best so
far are scored exactly.  When even the longest vector left cannot reach any query's k-th best,
the task is done.

Queries and candidates are cut into groups of bounded size by hash; one task has one group of
each, and keeps k rows per query, of which the last shuffle takes the best.  The work is the
product of both counts less what the bounds prune, and is spread evenly whatever the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfkin.llm.common import stored

GROUP_ROWS = 1 << 16  # rows of one side in one task, about
BLOCK = 1024  # candidates bounded and scored at a time
EXACT = 2.0**53  # whole numbers up to here are exact in a double


def whole_vectors(table: DataFrame, scale: int) -> DataFrame:
    """(vec_id, vec, mark, copies): vec is floor(scale * x) as doubles, mark its hash.

    Rows take part if they have an id and a vector all of whose components are finite; `copies`
    tells how many rows have this id and vector.  They are stored, as they are read several times.
    """
    wide = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    tidy = table.select(F.col("vec_id").cast("long").alias("vec_id"), wide.alias("vec"))
    sound = tidy.filter(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~bad)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vec")
            values = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale) + 0.0  # no -0.0
            ends = np.r_[0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]
            vec = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vec], ["vec_id", "vec"])

    whole = sound.mapInArrow(floors, "vec_id long, vec array<double>")
    whole = whole.groupBy("vec_id", "vec").agg(F.count(F.lit(1)).alias("copies"))
    return stored(whole.withColumn("mark", F.xxhash64("vec")), "vectors", lasting=True)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are filled up with zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of the second moments of all vectors, strongest first: width x width."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            rows = matrix(batch.column("vec"), width)
            most = np.abs(rows).max(axis=1, initial=0.0)  # directions count, not lengths: no overflow
            rows = rows / np.where(most > 0, most, 1.0)[:, None]
            total += rows.T @ rows
        i, j = np.triu_indices(width)
        arrays = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])]
        yield pa.RecordBatch.from_arrays(arrays, ["i", "j", "value"])

    parts = vectors.select("vec").mapInArrow(moments, "i int, j int, value double")
    total = np.zeros((width, width))
    for row in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():  # width² / 2 rows
        total[row.i, row.j] = total[row.j, row.i] = row.value
    _, directions = np.linalg.eigh(total)
    return np.ascontiguousarray(directions[:, ::-1])


def _exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers: doubles where they are exact, Python integers else."""
    most = float(np.abs(queries).max(initial=0.0)) * float(np.abs(rows).max(initial=0.0)) * max(1, queries.shape[1])
    if most < EXACT:
        return (queries @ rows.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in rows]
    return np.array(
        [[sum(int(a) * b for a, b in zip(query, row)) for row in whole] for query in queries], dtype=object
    ).reshape(len(queries), len(whole))


def _scaled(scores: np.ndarray, top: float) -> np.ndarray:
    """Scores divided by the square of `top`, which brings them into the range of doubles."""
    if scores.dtype == object:
        return np.array([float(Fraction(int(s)) / Fraction(top) ** 2) for s in scores.ravel()]).reshape(scores.shape)
    return scores / top / top


def _k_best(query: np.ndarray, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best rows of each query, in order, and their places from 0; ties go to the smaller id."""
    height = np.unique(scores, return_inverse=True)[1].reshape(-1) if scores.dtype == object else scores
    order = np.lexsort((rows, ids, -height, query))
    query, rows, scores = query[order], rows[order], scores[order]
    place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
    keep = place < k
    return query[keep], rows[keep], scores[keep], place[keep]


def search(
    q_key: np.ndarray, q_vec: np.ndarray, c_key: np.ndarray, c_id: np.ndarray, c_vec: np.ndarray, k: int, turn: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the query, position of the candidate, score) of the k best candidates of each query.

    A candidate with the query's key is left out.  `turn` is any orthonormal matrix; the result
    does not depend on it, only the pruning does.
    """
    width = q_vec.shape[1]
    top = max([1.0, np.abs(q_vec).max(initial=0.0), np.abs(c_vec).max(initial=0.0)])
    q, c = (q_vec / top) @ turn, (c_vec / top) @ turn  # scaled, so that squares stay finite
    order = np.argsort(-(c * c).sum(axis=1), kind="stable")
    c, c_vec, c_key, c_id = c[order], c_vec[order], c_key[order], c_id[order]
    head = max(1, width // 4)
    q_rest, c_rest = (np.sqrt((x[:, head:] ** 2).sum(axis=1)) for x in (q, c))
    q_norm, c_norm = (np.sqrt((x * x).sum(axis=1)) for x in (q, c))
    slack = 1e-9 * (width + 1) * (1.0 + q_norm * (c_norm[0] if len(c) else 0.0))  # rounding, generously
    floor = np.full(len(q), -np.inf)  # the k-th best score so far, scaled as the bounds are
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    start = 0
    while start < len(c) and not (q_norm * c_norm[start] + slack < floor).all():
        stop = min(len(c), start + (BLOCK if start else 4 * k))
        bound = q[:, :head] @ c[start:stop, :head].T + q_rest[:, None] * c_rest[start:stop]
        alive = bound + slack[:, None] >= floor[:, None]
        some_q, some_c = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if len(some_q):
            scores = _exact(q_vec[some_q], c_vec[start + some_c])
            own = q_key[some_q][:, None] == c_key[start + some_c]
            near = _scaled(scores, top) + slack[some_q][:, None] >= floor[some_q][:, None]
            at_q, at_c = np.nonzero(near & ~own)
            new = (some_q[at_q], start + some_c[at_c], scores[at_q, at_c])
            query, row, score = (np.concatenate(x) for x in zip(best, new))
            *best, place = _k_best(query, c_id[row], row, score, k)
            full = place == k - 1
            floor[best[0][full]] = _scaled(best[2][full], top)
        start = stop
    query, row, score = best
    return query, order[row], score


def exact_top_k(table: DataFrame, every: int, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each row with vec_id % every = 0.

    Candidates are all rows but the query's own; ties go to the smaller vec_id.  Rows are told apart
    even where they repeat: a repeated row is a candidate as often as it stands there, and a query
    as often, each time with ranks of its own; a row with the query's vec_id that is not the query
    itself is a candidate like others.
    Rows without an id, with a null vector or with a null or non-finite component take no part.
    Vectors of different lengths are compared as if filled up with zeros; an empty vector is all
    zeros.  A score outside the range of a long is null, and ranked by its
    nearest double.  Other columns are not read; an empty table gives an empty result.
    """
    schema = "query_id long, rank int, vec_id long, score long"
    vectors = whole_vectors(table, scale)
    is_query = F.pmod("vec_id", F.lit(every)) == 0
    shape = vectors.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(is_query).alias("queries"), F.max(F.size("vec")).alias("width")
    ).first()
    if not shape.queries:
        return table.sparkSession.createDataFrame([], schema)
    width = max(1, shape.width)
    turn = rotation(vectors, width)
    q_groups = math.ceil(shape.queries / GROUP_ROWS)
    partitions = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c_groups = max(math.ceil(shape.rows / GROUP_ROWS), math.ceil(partitions / q_groups))

    def group(n: int):
        return F.pmod(F.xxhash64("vec_id", "mark"), F.lit(n))

    def copies(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")

    kept = ("vec_id", "vec", "mark", "copies")
    queries = vectors.filter(is_query).select("*", group(q_groups).alias("group"), copies(c_groups))
    rows = vectors.select("*", group(c_groups).alias("group"), copies(q_groups))
    tiled = queries.select(
        *kept, (F.col("group") * c_groups + F.col("other")).cast("int").alias("tile"), F.lit(0).alias("side")
    ).unionByName(
        rows.select(
            *kept, (F.col("other") * c_groups + F.col("group")).cast("int").alias("tile"), F.lit(1).alias("side")
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for batch in batches:
            side = batch.column("side").to_numpy(zero_copy_only=False)
            for i in (0, 1):
                part = batch.filter(pa.array(side == i))
                numbers = [part.column(n).to_numpy(zero_copy_only=False) for n in ("vec_id", "mark", "copies")]
                sides[i].append((*numbers, matrix(part.column("vec"), width)))
        if not sides[0]:
            return
        (q_id, q_mark, q_copies, q_vec), (c_id, c_mark, c_copies, c_vec) = (
            [np.concatenate(x) for x in zip(*side)] for side in sides
        )
        # A row that stands there once is no candidate for itself; of more copies one less is.
        keys = np.stack([np.r_[q_id, c_id], np.r_[q_mark, c_mark]], axis=1)
        key = np.unique(keys, axis=0, return_inverse=True)[1].reshape(-1)
        q_key, c_key = key[: len(q_id)], key[len(q_id) :]
        at, row, scores = search(q_key, q_vec, np.where(c_copies > 1, -1, c_key), c_id, c_vec, k, turn)
        times = c_copies[row] - (q_key[at] == c_key[row])
        whole = [int(s) for s in scores]
        nearest = [float(s) if abs(s) < 1 << 1023 else (math.inf if s > 0 else -math.inf) for s in whole]
        longs = [s if -(1 << 63) <= s < 1 << 63 else None for s in whole]
        arrays = [pa.array(x) for x in (q_id[at], q_mark[at], q_copies[at], c_id[row], np.minimum(times, k))]
        arrays += [pa.array(longs, pa.int64()), pa.array(nearest, pa.float64())]
        yield pa.RecordBatch.from_arrays(arrays, ["query_id", "mark", "copies", "vec_id", "times", "score", "nearest"])

    found = tiled.repartitionById(q_groups * c_groups, "tile").mapInArrow(
        run, "query_id long, mark long, copies long, vec_id long, times long, score long, nearest double"
    )
    found = found.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    order = (F.desc("nearest"), F.desc("score"), F.asc("vec_id"))
    place = F.row_number().over(Window.partitionBy("query_id", "mark").orderBy(*order))
    best = found.withColumn("rank", place).filter(F.col("rank") <= k)
    each = best.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("query_id", "rank", "vec_id", "score")

"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Only documents are labelled, so tokens are labelled through them: in a toxic document, the tokens
that have a feature (the word itself, or its beginning) much more frequent in toxic documents
than in clean ones are toxic, all others and all tokens of clean documents are not.  The field
has two states; a token's weight is the sum of its features' weights over a bias, and there are
three transition weights.  Tokens without any selected feature all have the same potentials, so
a run of g of them is one 2 x 2 matrix to the power g, taken through its eigenvalues:
forward-backward visits the other tokens only, and is exact.

A document's score is a logistic function of its marginals: the expected number of toxic tokens
and the largest marginal.  Tokens of marginal one half or more are the offending spans.

The model is fitted on at most SAMPLE labelled documents, those of the smallest hash of their id;
gradients are summed over them by Spark, and only sums come to the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfkin.llm.common import map_batches, passing_tables, stored, text_of

SAMPLE = 20_000  # labelled documents the model is fitted on, at most
FEATURES = 20_000  # features of the model, at most
LEAST_SHARE = 0.01  # of toxic documents a feature must occur in
LEAST_DOCS = 5
TOXIC_ODDS = 2.0  # log odds from which a feature makes a token of a toxic document toxic
PREFIXES = (4, 5, 6, 7)
SHARDS = 8
WINDOW = 64  # tokens with features in one training sequence; longer documents give several
ROUNDS = 24
PENALTY = 0.05
CACHED = 1_000_000  # words whose weights a Python worker holds

WORD = re.compile(r"[^\W\d_](?:.*[^\W\d_])?", re.DOTALL)
BLANKS = re.compile(r"\S+")


def features_of(word: str) -> list[str]:
    """The word without what surrounds its letters, lowered, and its beginnings."""
    m = WORD.search(word)
    if not m:
        return []
    core = m[0].lower()
    return [core, *(f"{core[:n]}-" for n in PREFIXES if len(core) >= n)]


class Field(NamedTuple):
    """Weights of the chain: bias, clean to toxic, toxic to clean, toxic to toxic."""

    bias: float
    enter: float
    leave: float
    stay: float

    def step(self) -> np.ndarray:
        """Transition factors, from the row's state to the column's."""
        return np.exp(np.array([[0.0, self.enter], [self.leave, self.stay]]))


class Runs:
    """Powers of the factor of one token without features, scaled by its larger eigenvalue."""

    def __init__(self, field: Field) -> None:
        self.step = field.step()
        one = self.step * np.array([1.0, math.exp(field.bias)])
        values, vectors = np.linalg.eig(one)
        order = np.argsort(-values.real)
        values, vectors = values.real[order], vectors.real[:, order]
        inverse = np.linalg.inv(vectors)
        self.first = np.outer(vectors[:, 0], inverse[0])
        self.second = np.outer(vectors[:, 1], inverse[1])
        self.ratio, self.log = values[1] / values[0], math.log(values[0])

    def __call__(self, lengths: np.ndarray) -> np.ndarray:
        """A 2 x 2 matrix for each length; the scale left out is `log` times the length."""
        return self.first + self.second * np.power(self.ratio, lengths)[:, None, None]


class Sequences(NamedTuple):
    """Tokens with features, in sequences laid end to end.

    `sizes` tokens each; `gaps` tokens without features before each token; `tails` after the last.
    """

    sizes: np.ndarray
    gaps: np.ndarray
    tails: np.ndarray

    def chunks(self, cells: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Sequences of like length together: their numbers and the places of their tokens,
        -1 where a sequence has ended; at most about `cells` places at a time."""
        begins = np.cumsum(self.sizes) - self.sizes
        order = np.argsort(-self.sizes, kind="stable")
        order = order[self.sizes[order] > 0]
        at = 0
        while at < len(order):
            longest = int(self.sizes[order[at]])
            some = order[at : at + max(1, cells // longest)]
            columns = np.arange(longest)
            places = np.where(columns < self.sizes[some][:, None], begins[some][:, None] + columns, -1)
            yield some, places
            at += len(some)


def forward_backward(field: Field, sequences: Sequences, weights: np.ndarray, marginals: bool = True):
    """(sum of log partition functions, marginal of each token): exact; `weights` without the bias."""
    runs = Runs(field)
    total = runs.log * float(sequences.gaps.sum() + sequences.tails.sum())
    empty = sequences.sizes == 0
    total += float(np.log(runs(sequences.tails[empty])[:, 0].sum(axis=1)).sum())
    out = np.zeros(len(weights))
    for some, places in sequences.chunks():
        alive = places >= 0
        height = np.where(alive, weights[places] + field.bias, 0.0)
        shift = np.maximum(height, 0.0)  # factors (exp(-shift), exp(height - shift))
        low, high = np.exp(-shift), np.exp(height - shift)
        total += float(shift[alive].sum())
        steps = runs(np.where(alive, sequences.gaps[places], 0).ravel()) @ runs.step
        steps = steps.reshape(*places.shape, 2, 2)
        a = np.zeros((len(some), 2))
        a[:, 0] = 1.0
        alphas = np.zeros((*places.shape, 2))
        for i in range(places.shape[1]):
            n = int(alive[:, i].sum())  # sequences are sorted, longest first
            new = np.einsum("sj,sjk->sk", a[:n], steps[:n, i])
            new *= np.stack([low[:n, i], high[:n, i]], axis=1)
            scale = new.sum(axis=1)
            total += float(np.log(scale).sum())
            a[:n] = new / scale[:, None]
            alphas[:n, i] = a[:n]
        b = runs(sequences.tails[some]).sum(axis=2)
        total += float(np.log((a * b).sum(axis=1)).sum())
        if marginals:
            for i in range(places.shape[1] - 1, -1, -1):
                n = int(alive[:, i].sum())
                both = alphas[:n, i] * b[:n]
                out[places[:n, i]] = both[:, 1] / both.sum(axis=1)
                new = np.einsum("sjk,sk->sj", steps[:n, i], b[:n] * np.stack([low[:n, i], high[:n, i]], axis=1))
                b[:n] = new / new.sum(axis=1)[:, None]
    return total, out


def gold_score(field: Field, sequences: Sequences, weights: np.ndarray, labels: np.ndarray) -> float:
    """Sum of the scores of the labelled paths; tokens without features are clean."""
    step = np.log(field.step())
    first = np.zeros(len(labels), bool)
    begins = np.cumsum(sequences.sizes) - sequences.sizes
    first[begins[sequences.sizes > 0]] = True
    before = np.where(first, 0, np.r_[0, labels[:-1]]) if len(labels) else labels
    direct, through = step[before, labels], step[before, 0] + step[0, labels]
    score = float(np.where(sequences.gaps > 0, through, direct).sum() + (labels * (weights + field.bias)).sum())
    last = (begins + sequences.sizes - 1)[(sequences.sizes > 0) & (sequences.tails > 0)]
    return score + float(step[labels[last], 0].sum())


class Model(NamedTuple):
    weights: dict[str, float]
    field: Field
    logistic: tuple[float, ...]  # of 1, log1p(expected tokens), largest marginal


class Weigher(dict):
    """Weight of each word, computed when first asked for; 0.0 where it has no features."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > CACHED:
            self.clear()
        known = self.weights
        value = sum(known.get(f, 0.0) for f in features_of(word))
        self[word] = value
        return value


def _gaps(marked: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Unmarked tokens before each marked one, and after the last."""
    if not len(marked):
        return marked, size
    return np.diff(np.r_[-1, marked]) - 1, size - 1 - int(marked[-1])


def _summary(sizes: np.ndarray, marginals: np.ndarray) -> np.ndarray:
    """(1, log1p of the expected toxic tokens, largest marginal) for each sequence."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    expected = np.bincount(owner, marginals, minlength=len(sizes))
    most = np.zeros(len(sizes))
    np.maximum.at(most, owner, marginals)
    return np.stack([np.ones(len(sizes)), np.log1p(expected), most], axis=1)


class Scorer:
    """Scores texts with a model; one for each task."""

    def __init__(self, model: Model) -> None:
        self.model, self.weigh = model, Weigher(model.weights)

    def marks(self, texts: list[str]) -> tuple[Sequences, np.ndarray, list[np.ndarray]]:
        """Sequences of the tokens with features, their weights, and their places among the words."""
        marked, values, gaps, tails = [], [], [], []
        for text in texts:
            words = text.split()
            weights = np.fromiter(map(self.weigh.__getitem__, words), float, len(words))
            at = np.flatnonzero(weights)
            gap, tail = _gaps(at, len(words))
            marked.append(at)
            values.append(weights[at])
            gaps.append(gap)
            tails.append(tail)
        sizes = np.array([len(m) for m in marked], np.int64)
        joined = [np.concatenate(x) if x else np.zeros(0) for x in (gaps, values)]
        return Sequences(sizes, joined[0].astype(np.int64), np.array(tails, np.int64)), joined[1], marked

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Score of each text, and its toxic spans (start, end, marginal) in code points."""
        sequences, weights, marked = self.marks(texts)
        _, marginals = forward_backward(self.model.field, sequences, weights)
        height = _summary(sequences.sizes, marginals) @ np.array(self.model.logistic)
        scores = 1.0 / (1.0 + np.exp(-np.clip(height, -500, 500)))
        ends = np.cumsum(sequences.sizes)
        spans = []
        for text, at, p in zip(texts, marked, np.split(marginals, ends[:-1])):
            toxic = {int(i): float(x) for i, x in zip(at, p) if x >= 0.5}
            found: list[tuple[int, int, float]] = []
            last = -2
            for i, m in enumerate(BLANKS.finditer(text) if toxic else ()):
                if i in toxic:
                    if last == i - 1:
                        start, _, p_before = found.pop()
                        found.append((start, m.end(), max(p_before, toxic[i])))
                    else:
                        found.append((m.start(), m.end(), toxic[i]))
                    last = i
            spans.append(found)
        return scores, spans


def is_held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text, mod 5, is 0; not so without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """(text, toxic) of at most `size` labelled documents that are not held out; equal texts once."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)  # so its broadcast is bounded
    texts = docs.select("doc_id", text_of()).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    return stored(texts.groupBy("text").agg(F.max("toxic").alias("toxic")).repartition(SHARDS, F.xxhash64("text")), "sample")


def _candidates(sample: DataFrame) -> tuple[dict[str, int], np.ndarray, dict[bool, int]]:
    """Feature numbers, log odds of each, and documents by label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            names = list(seen[0] | seen[1])
            arrays = [pa.array(names, pa.string()), *(pa.array([c[n] for n in names], pa.int64()) for c in seen)]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, ["feature", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                seen[toxic].update({f for w in set(text.split()) for f in features_of(w)})
                if len(seen[0]) + len(seen[1]) > CACHED:
                    yield flush()
        yield flush()

    totals = dict.fromkeys((False, True), 0) | {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not totals[True]:
        return {}, np.zeros(0), totals
    counts = sample.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature")
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * totals[True]))
    odds = F.log((F.col("toxic") + 0.5) / (totals[True] + 1.0)) - F.log((F.col("clean") + 0.5) / (totals[False] + 1.0))
    best = (
        counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("toxic") >= least)
        .withColumn("odds", odds)
        .filter("odds >= 1.0")
        .orderBy(F.desc(F.col("odds") * F.col("toxic")), "feature")
        .limit(FEATURES)
        .collect()
    )
    return {r.feature: i for i, r in enumerate(best)}, np.array([r.odds for r in best]), totals


_SHARD = "sizes binary, gaps binary, tails binary, labels binary, counts binary, features binary"


def _shards(sample: DataFrame, number: dict[str, int], odds: np.ndarray) -> DataFrame:
    """The sample as training sequences of feature numbers, in a few rows of packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            sizes, gaps, tails, labels, counts, features = [], [], [], [], [], []
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                tokens = text.split()
                for w in tokens:
                    if w not in words:
                        words[w] = tuple(number[f] for f in features_of(w) if f in number)
                at = np.array([i for i, w in enumerate(tokens) if words[w]], np.int64)
                gap, tail = _gaps(at, len(tokens))
                for start in range(0, max(1, len(at)), WINDOW):
                    own = at[start : start + WINDOW]
                    sizes.append(len(own))
                    tails.append(tail if start + WINDOW >= len(at) else 0)
                    gaps.extend(gap[start : start + WINDOW].tolist())
                    for i in own.tolist():
                        mine = words[tokens[i]]
                        labels.append(int(toxic and odds[list(mine)].max() >= TOXIC_ODDS))
                        counts.append(len(mine))
                        features.extend(mine)
            packed = [np.array(x, np.int64).tobytes() for x in (sizes, gaps, tails, labels, counts, features)]
            names = [f.split()[0] for f in _SHARD.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], names)

    return stored(sample.mapInArrow(run, _SHARD), "shards")


def _gradient(shards: DataFrame, params: np.ndarray) -> tuple[float, np.ndarray]:
    """Log likelihood of the training sequences and its gradient, summed by Spark tasks.

    Feature weights have exact gradients from the marginals; those of the four weights of the
    chain are differences of the likelihood.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(params) + 1)
        for batch in batches:
            for row in batch.to_pylist():
                sizes, gaps, tails, labels, counts, features = (np.frombuffer(row[n], np.int64) for n in row)
                sequences = Sequences(sizes, gaps, tails)
                owner = np.repeat(np.arange(len(labels)), counts)
                weights = np.bincount(owner, params[4:][features], minlength=len(labels))

                def likelihood(chain: np.ndarray, marginals: bool = False):
                    field = Field(*chain)
                    z, p = forward_backward(field, sequences, weights, marginals)
                    return gold_score(field, sequences, weights, labels) - z, p

                base, p = likelihood(params[:4], True)
                sums[-1] += base
                for i in range(4):
                    moved = params[:4] + 1e-4 * (np.arange(4) == i)
                    sums[i] += (likelihood(moved)[0] - base) / 1e-4
                sums[4:-1] += np.bincount(features, (labels - p)[owner], minlength=len(params) - 4)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    rows = shards.mapInArrow(run, "sums binary").collect()  # one row of fixed size for each task
    total = np.sum([np.frombuffer(r.sums) for r in rows], axis=0)
    return float(total[-1]), total[:-1]


def _climb(shards: DataFrame, features: int) -> np.ndarray:
    """Weights by resilient steps along the gradient's signs, with a quadratic penalty."""
    params = np.r_[-3.0, 0.0, 0.0, 0.5, np.full(features, 1.0)]
    step, last = np.full(len(params), 0.5), np.zeros(len(params))
    for _ in range(ROUNDS):
        _, gradient = _gradient(shards, params)
        gradient = gradient - PENALTY * params
        turned = gradient * last
        step = np.clip(np.where(turned > 0, step * 1.2, np.where(turned < 0, step * 0.5, step)), 1e-4, 2.0)
        gradient = np.where(turned < 0, 0.0, gradient)
        params = np.clip(params + np.sign(gradient) * step, -20.0, 20.0)
        last = gradient
    return params


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's steps, with a slight penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * w)
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from the labelled documents that are not held out; None if none of them is toxic.

    The driver gets feature counts (at most FEATURES), one gradient per task and round, and three
    numbers per sampled document.
    """
    with passing_tables(docs.sparkSession):
        return _fit(_sample(docs, labels, sample))


def _fit(chosen: DataFrame) -> Model | None:
    number, odds, totals = _candidates(chosen)
    if not totals[True]:
        return None
    params = _climb(_shards(chosen, number, odds), len(number))
    field = Field(*params[:4].tolist())
    weights = {f: float(params[4 + i]) for f, i in number.items()}
    model = Model(weights, field, (0.0, 0.0, 0.0))

    def summarise(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer = Scorer(model)
        sequences, values, _ = scorer.marks(batch.column("text").to_pylist())
        x = _summary(sequences.sizes, forward_backward(field, sequences, values)[1])
        toxic = batch.column("toxic").cast(pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(x[:, 1]), pa.array(x[:, 2]), toxic], ["expected", "most", "toxic"])

    rows = map_batches(chosen, summarise, "expected double, most double, toxic double").collect()  # `sample` at most
    values = np.array([tuple(r) for r in rows])
    x = np.column_stack([np.ones(len(values)), values[:, :2]])
    return model._replace(logistic=_logistic(x, values[:, 2]))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))
_SPAN = T.StructType().add("start", T.LongType()).add("end", T.LongType()).add("p", T.DoubleType())
SCORED = T.StructType().add("score", T.DoubleType()).add("spans", T.ArrayType(_SPAN))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` with `score` (0 to 1) and `spans` (start, end, marginal; code points) added.

    Whole texts are scored; null and empty texts get the score of a text without toxic words.
    Without a model (nothing toxic to learn from) every score is 0.  All other columns are kept;
    columns of `docs` that are named like a result are replaced.
    """
    plain = docs.drop("score", "spans")
    if model is None:
        none = F.array().cast(SCORED["spans"].dataType)
        return plain.withColumns({"score": F.lit(0.0), "spans": none})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            if not batch.num_rows:
                continue
            scores, spans = scorer([t or "" for t in batch.column("text").to_pylist()])
            found = [[{"start": a, "end": b, "p": p} for a, b, p in s] for s in spans]
            columns = [*batch.columns, pa.array(scores), pa.array(found, _SPANS)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "score", "spans"])

    return plain.mapInArrow(run, T.StructType([*plain.schema, *SCORED]))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) for every row of `docs`.

    `labels` (doc_id, toxic) is read for fitting only, and only rows that are not held out; rows
    that repeat a doc_id count once, as toxic if any says so; null labels are left out.  Rows of
    `docs` that repeat a doc_id or have none each get a row; an empty table gives an empty result.
    """
    model = fit(docs, labels, sample)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of())
    return score(narrow, model).select(
        "doc_id",
        is_held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "spans",
    )

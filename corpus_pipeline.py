"""From raw documents to token ids, in five stages, each of which calls one operator.

Each stage is a function of (session, documents, table folder); what it returns is written as
Parquet and read again as the next one's documents.  All but the last return the columns of the
table `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfkin.llm import decontaminate, line_dedup, sentencepiece_codec, simhash, toxicity
from shelfkin.llm.common import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter(F.col("score") < 0.5).select(docs.columns)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that an earlier one has; those of which nothing is left go.

    `n_chars` is set anew where text was deleted.
    """
    done = line_dedup.dedup_lines(docs)
    changed = F.size("deleted") > 0
    left = done.filter(~changed | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        count = F.length("text").cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(changed, count).otherwise(F.col("n_chars")))
    return left.select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, see `simhash.one_of_each_group`."""
    return simhash.one_of_each_group(docs, shingle=3, reach=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): SentencePiece ids of each document."""
    encoded = sentencepiece_codec.encode(docs)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", delete_repeated_lines),
    ("simhash_near_dedup", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

ORACLE_SQL = None  # neither the model nor the fingerprints can be had in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name, lasting=True)
    return docs

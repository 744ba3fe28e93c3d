"""Which rows of a catalogue can be neighbours by the labels they share.

When a unit row lacks `n` labels of another one, a, at most a length of sqrt(1 - n * label_weight^2) of
a can count towards their cosine, as no row is longer than 1.  With `slack` = 1 - bar^2, rows a and b can
reach a's bar only when b lacks no more than slack / label_weight^2 of a's labels, and a no more
of b's by b's weight.

A row first meets the rows with its very labels, or where these are few all rows with one of its rare
labels, which gives its bar.  Then, if a neighbour must have all its labels, it meets those that have
more labels and a weight small enough, on the list of its rarest label.  If a neighbour may lack m of
them, it has one of any m + 1, so the row meets the lists of its m + 1 rarest labels.  Only a row that
may have neighbours without any of its labels meets the whole catalogue.

What a row asks for is a `QUESTION`: a list of rows, and which of them.  The rows that ask it and those
that answer are cut into blocks of bounded size, and each two blocks make a tile.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfkin.operators import tiles
from shelfkin.sources.snapshots import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 1 << 14  # of a list, held by a task
SEED_ROWS = 64  # of a list that is met first, or 8 k: too short a one gives no useful bar

ROW = ("id", "unit", "labels", "label_weight")
# Kinds of lists: rows with the same labels, rows with a label, all rows.
SAME, LABEL, ALL = 0, 1, 2
# Of a list, the rows with more than `above` labels whose squared weight is at most 2^-light.
QUESTION = ("kind", "list", "light", "above")


class Asked(NamedTuple):
    """Rows with what they ask (`asking`, an array), the questions with their blocks, and what that takes."""

    asking: DataFrame
    questions: DataFrame
    tiles: int
    pairs: int
    sent: int
    block_rows: int


def _question(kind: int, of: Column, light: Column | None = None, above: Column | None = None) -> Column:
    values = F.lit(kind), of.cast("long"), F.lit(0) if light is None else light, F.lit(-1) if above is None else above
    return F.struct(*[value.cast("long" if n == "list" else "int").alias(n) for n, value in zip(QUESTION, values)])


def with_lists(units: DataFrame, k: int) -> DataFrame:
    """Adds `same`, the list of rows with the same labels, `rarest`, a row's labels with the rows that have
    them, the rarest first (null without labels), and `seed`, the question a row asks first."""
    labelled = units.select(F.col("id").alias("labelled"), F.explode("labels").alias("label"))
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    order = F.sort_array(F.collect_list(F.struct("members", "label")))
    rarest = labelled.join(stored(counts, "labels"), "label").groupBy("labelled").agg(order.alias("rarest"))
    known = units.withColumn("same", F.xxhash64(F.sort_array("labels")))
    copies = known.groupBy("same").agg(F.count(F.lit(1)).alias("copies"))
    known = known.join(copies, "same").join(rarest, F.col("id") == F.col("labelled"), "left")
    least = max(SEED_ROWS, 8 * k)
    enough = F.filter("rarest", lambda x: x["members"] >= least)
    label = F.coalesce(F.get(enough, F.lit(0)), F.element_at("rarest", -1))["label"]
    by_labels = (F.col("copies") >= least) | F.col("rarest").isNull()
    seed = F.when(by_labels, _question(SAME, F.col("same"))).otherwise(_question(LABEL, label))
    return known.select(*ROW, "same", "rarest", seed.alias("seed"))


def further(rows: int) -> Column:
    """What a row has to ask after its `seed`, which gave it `bar` (null: not enough rows)."""
    size = F.size("labels")
    slack = 1 - F.pow(F.col("bar") - tiles.MARGIN, 2)
    lacking = F.floor(F.least(slack * F.pow("label_weight", F.lit(-2)) + tiles.MARGIN, F.lit(1e6))).cast("int")
    light = F.greatest(F.floor(-F.log2(slack) - tiles.MARGIN), F.lit(0))
    of_label = F.col("seed.kind") == LABEL
    others = F.filter("rarest", lambda x: ~of_label | (x["label"] != F.col("seed.list")))
    some = F.slice(others, 1, F.greatest(lacking, F.lit(0)) + F.when(of_label, 0).otherwise(1))
    cost = F.aggregate(some, F.lit(0).cast("long"), lambda total, x: total + x["members"])
    lists = F.transform(some, lambda x: _question(LABEL, x["label"], above=size - lacking - 1))
    nothing = F.slice(F.array(_question(ALL, F.lit(0))), 1, 0)
    return (
        F.when(F.col("bar").isNull() | (F.col("bar") <= tiles.MARGIN), F.array(_question(ALL, F.lit(0))))
        .when(size == 0, F.array(_question(ALL, F.lit(0), light, F.lit(0))))
        .when((lacking == 0) & of_label, nothing)
        .when(lacking == 0, F.array(_question(LABEL, F.get("rarest", F.lit(0))["label"], light, size)))
        .when((lacking < size) & (cost < rows), lists)
        .otherwise(F.array(_question(ALL, F.lit(0))))
    )


def _asking(asking: DataFrame, *kept: str) -> DataFrame:
    return asking.select(*kept, F.explode("asking").alias("question")).select(*kept, "question.*")


def _answering(listed: DataFrame, questions: DataFrame, *kept: str) -> DataFrame:
    """Rows once for each question they answer."""
    places = F.concat(
        F.array(F.struct(F.lit(SAME).alias("kind"), F.col("same").alias("list"))),
        F.array(F.struct(F.lit(ALL).alias("kind"), F.lit(0).cast("long").alias("list"))),
        F.transform("labels", lambda x: F.struct(F.lit(LABEL).alias("kind"), x.cast("long").alias("list"))),
    )
    # A row without a proper weight is left out of nothing.
    weight = F.when((F.col("label_weight") > 0) & ~F.isnan("label_weight"), F.floor(-2 * F.log2("label_weight")).cast("int"))
    rows = listed.select(*kept, F.size("labels").alias("size"), F.coalesce(weight, F.lit(1 << 20)).alias("weight"), F.explode(places).alias("place"))
    rows = rows.select(*kept, "size", "weight", "place.*")
    fits = (F.col("size") > F.col("above")) & ((F.col("light") == 0) | (F.col("weight") >= F.col("light")))
    return rows.join(questions, ["kind", "list"]).filter(fits).drop("size", "weight")


def asked(asking: DataFrame, listed: DataFrame, most: int = BLOCK_ROWS) -> Asked:
    """How questions are cut into tiles, with blocks of `most` rows if not of `BLOCK_ROWS`.

    One row per question is stored, one row reaches the driver.
    """
    block_rows = min(most, BLOCK_ROWS)

    def blocks(rows: str) -> Column:
        return F.ceil(F.col(rows) / block_rows)

    askers = stored(_asking(asking).groupBy(*QUESTION).agg(F.count(F.lit(1)).alias("askers")), "asked")
    answers = _answering(listed, askers).groupBy(*QUESTION, "askers").agg(F.count(F.lit(1)).alias("answers"))
    sizes = {"askers_blocks": blocks("askers"), "answers_blocks": blocks("answers")}
    questions = stored(answers.withColumns(sizes), "questions")
    total = {
        "tiles": F.col("askers_blocks") * F.col("answers_blocks"),
        "pairs": F.col("askers") * F.col("answers"),
        "sent": F.col("askers") * F.col("answers_blocks") + F.col("answers") * F.col("askers_blocks"),
    }
    found = questions.agg(*[F.sum(c).alias(n) for n, c in total.items()]).first()
    return Asked(asking, questions, *(found[n] or 0 for n in total), block_rows)


def met(plan: Asked, listed: DataFrame, k: int, least_tasks: int, schema: str) -> DataFrame:
    """The best k, in every tile of a question, of each row that asks it."""

    def copies(rows: DataFrame, others: str) -> DataFrame:
        return rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)))

    def place(askers: Column, answers: Column) -> Column:
        return (askers * F.col("answers_blocks") + answers).alias("part")

    def block(of: str) -> Column:
        return F.pmod(F.xxhash64("id"), F.col(of))

    kept = (*ROW, "bar", *QUESTION)
    left = copies(_asking(plan.asking, *ROW, "bar").join(plan.questions, list(QUESTION)), "answers_blocks")
    left = left.select(*kept, place(block("askers_blocks"), F.col("other")), F.lit(0).alias("side"))
    right = copies(_answering(listed, plan.questions, *ROW), "askers_blocks").withColumn("bar", F.lit(-2.0))
    right = right.select(*kept, place(F.col("other"), block("answers_blocks")), F.lit(1).alias("side"))
    # Short lists share tasks; a tile of two whole blocks makes one, about.
    tasks = max(least_tasks, min(plan.tiles, -(-2 * plan.pairs // plan.block_rows**2), tiles.MOST_TASKS))
    task = F.pmod(F.xxhash64(*QUESTION, "part"), F.lit(tasks)).cast("int")
    spread = left.unionByName(right).withColumn("task", task).repartitionById(tasks, "task")
    return spread.groupBy("task", *QUESTION, "part").applyInArrow(_tile_asked(k), schema)


def _tile_asked(k: int) -> Callable[[pa.Table], pa.Table]:
    """The best k of side 1, at or above its bar if it has one, for each row of side 0."""

    def best(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        asking, answering = (tiles.Block(table.filter(pa.array(side == s))) for s in (0, 1))
        of_asking = tiles.Best(asking.ids, k, asking.bar)
        if len(asking.ids) and len(answering.ids):
            tiles.fill(asking, answering, of_asking)
        return of_asking.table()

    return best

"""Column expressions on edge rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from shelfkin.functions import dates, numbers, text


def evaluate(spark, values, dtype, expression):
    """Results of `expression` on a column of the given values, in order."""
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {dtype}").repartition(3)
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_title_shapes(spark):
    values = [
        json.dumps({"english": "", "romaji": "ABC", "native": None}),
        json.dumps({"english": None, "romaji": None, "native": None}),
        json.dumps([1, 2]),
        None,
        json.dumps("Plain STR"),
        json.dumps(""),
        json.dumps("{odd} title"),
        json.dumps({"native": "ÀÉ"}),
        json.dumps({}),
        "5",
    ]
    got = evaluate(spark, values, "string", lambda x: text.clean_title(F.parse_json(x)))
    assert got == ["abc", None, None, None, "plain str", "", "{odd} title", "àé", None, None]


def test_tag_shapes(spark):
    values = [
        json.dumps([{"name": "A"}, {"name": ""}, {"name": None}, {"name": "a"}]),
        None,
        "[]",
        json.dumps(["x"]),
        json.dumps([{"name": "Q"}, "bare"]),
        json.dumps("Solo"),
        json.dumps({"name": "object"}),
    ]
    got = evaluate(spark, values, "string", lambda x: text.clean_tags(F.parse_json(x)))
    assert got == [["a", "a"], [], [], [], ["q"], ["solo"], []]


def test_description_steps(spark):
    cases = {
        "A tale.\n\n(Source: Lantern House)": "A tale.",
        "A. Note: one sentence.": "A.",
        "A. Note: one. two.": "A. Note: one. two.",
        "A.<br>Note: z.<br>": "A. Note: z.",
        "(Source: a(b) c) d": "c) d",
        "(Source:)x": "(Source:)x",
        "[  SOURCE: q] tail": "tail",
        "a 　b": "a b",
        "　 a\tb\x1c": "a\tb",
        "x<BR  />y<br/>z<p>": "x y z<p>",
        "end. Note: last\n": "end.",
        "a\x1c\x1fb": "a b",
    }
    got = evaluate(spark, [*cases, None], "string", text.clean_description)
    assert got == [*cases.values(), None]


def test_whitespace_is_that_of_python(spark):
    points = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, chr(c)) for c in points], "c int, x string")
    found = df.filter(F.col("x").rlike(rf"(?U)^{text.WHITESPACE}$")).collect()
    assert {r.c for r in found} == {c for c in points if chr(c).isspace()}
    assert set(text.WHITESPACE_CHARACTERS) == {chr(c) for c in points if chr(c).isspace()}


def test_end_date_counts_only_keys_present(spark):
    values = [{"month": 5, "year": 2000}, {"month": None, "year": 2000}, None, {}, {"year": 2000}]
    assert evaluate(spark, values, "map<string,bigint>", dates.has_end_date) == [1, 0, 0, 1, 1]


def test_month_start(spark):
    values = [
        (1, 2020), (13, 2020), (0, 2020), (1, None), (None, 2020), (1, 3000), (1, 1600), (5, 5),
        (-1, 2020), (9, 1677), (10, 1677), (4, 2262), (5, 2262),
    ]
    got = evaluate(spark, values, "struct<month:bigint,year:bigint>", dates.month_start)
    first = dt.datetime(2020, 1, 1)
    limits = [None, dt.datetime(1677, 10, 1), dt.datetime(2262, 4, 1), None]
    assert got == [first, *[None] * 8, *limits]


def test_epoch_is_utc_in_any_session_zone(spark):
    values = ["0", "1700000000", None, "x", "1e20", "1.5"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = evaluate(
            spark, values, "string", lambda x: dates.epoch_to_ts(numbers.coerce_numeric(x))
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [
        dt.datetime(1970, 1, 1), dt.datetime(2023, 11, 14, 22, 13, 20), None, None, None,
        dt.datetime(1970, 1, 1, 0, 0, 1, 500000),
    ]


def test_coerce_numeric(spark):
    cases = {
        "12": 12.0, " 12 ": 12.0, "1e3": 1000.0, "abc": None, "1.5": 1.5, "1d": None, "2F": None,
        "3f ": None, "+5": 5.0, "": None, "NaN": None, "inf": float("inf"), "0x10": None,
        "0x1p3": None, "1_000": None, "1,000": None, "-0.5": -0.5,
    }
    assert evaluate(spark, list(cases), "string", numbers.coerce_numeric) == list(cases.values())


def test_logs(spark):
    got = evaluate(spark, [-1, 0, 1], "bigint", numbers.log_chapters)
    assert got == pytest.approx([0.0, 0.0, 0.6931471805599453])
    assert evaluate(spark, [0, 9], "bigint", numbers.log_popularity)[0] == 0.0


def test_status_weight_and_strength(spark):
    values = ["COMPLETED", "CURRENT", "PAUSED", "PLANNING", "DROPPED", "REPEATING", None]
    got = evaluate(spark, values, "string", numbers.status_weight)
    assert got == [1.0, 0.8, 0.5, 0.4, 0.1, None, None]
    row = spark.range(1).select(
        numbers.interaction_strength(F.lit(0.8), F.lit(5.0)).alias("a"),
        numbers.interaction_strength(F.lit(0.8), F.lit(None).cast("double")).alias("b"),
    ).first()
    assert row.a == pytest.approx(0.4) and row.b is None


def test_score_rounding(spark):
    got = evaluate(spark, [0.125, 1.015, 0.575, -0.125], "double", numbers.round_score)
    assert got == [0.12, 1.01, 0.57, -0.12]
    assert evaluate(spark, [0.57, 0.29, -0.12], "double", numbers.percent_score) == [57, 29, -12]


def test_render_tags(spark):
    assert evaluate(spark, [["a", "b"], []], "array<string>", text.render_tags) == ["a, b", ""]

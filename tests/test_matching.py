"""Title matching against a plain dynamic program."""

import random

import pytest
from pyspark.sql import functions as F

from shelfkin.operators import frames, matching


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    return 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def expected(query, titles, threshold=70):
    if query is None:
        return (None, None, None)
    scored = [(-ratio(query, t), i, t) for i, t in titles if t is not None]
    worst, _, title = min(scored)
    if -worst < threshold:
        return (None, None, None)
    owner = min(i for i, t in titles if t is not None and t.lower() == title.lower())
    return (title, -worst, owner)


def run(spark, requests, titles, **options):
    rq = spark.createDataFrame([(i, q, 5) for i, q in requests], "request_id bigint, title string, top_n int")
    md = spark.createDataFrame(titles, "id bigint, title string").repartition(3)
    rows = matching.match_fuzzy(rq, md, **options).collect()
    assert len(rows) == len(requests)
    return {r.request_id: (r.matched_title, r.ratio, r.matched_id) for r in rows}


def misspelt(rng, title):
    letters = list(title)
    for _ in range(rng.randint(0, 5)):
        if letters and rng.random() < 0.5:
            letters.pop(rng.randrange(len(letters)))
        else:
            letters.insert(rng.randint(0, len(letters)), rng.choice("abcxyé"))
    return "".join(letters)


@pytest.mark.parametrize(
    "block, pairs, classes", [(1 << 14, 1 << 20, 256), (9, 40, 3)]
)
def test_fuzzy_equals_brute_force(spark, monkeypatch, block, pairs, classes):
    monkeypatch.setattr(matching, "BLOCK_TITLES", block)
    monkeypatch.setattr(matching, "PAIRS_AT_ONCE", pairs)
    monkeypatch.setattr(matching, "CHARACTER_CLASSES", classes)
    rng = random.Random(block)

    def word(n):
        return "".join(rng.choice("abcdéf 漢😀") for _ in range(n))

    titles = [(i, word(rng.choice([0, 1, 3, 8, 12, 20, 70, 150]))) for i in range(120)]
    titles += [(200, None), (201, titles[3][1]), (202, "ABCDEF"), (203, "abcdef")]
    requests = [(i, misspelt(rng, rng.choice(titles[:120])[1])) for i in range(90)]
    requests += [(900, None), (901, ""), (902, "ABCDEFx"), (903, "no such title at all, no")]
    got = run(spark, requests, titles)
    for i, q in requests:
        want = expected(q, titles)
        assert got[i][0] == want[0] and got[i][2] == want[2], (q, got[i], want)
        assert want[1] is None or got[i][1] == pytest.approx(want[1])


def test_threshold_and_case(spark):
    titles = [(1, "sitting"), (2, "abc")]
    assert run(spark, [(1, "kitten")], titles)[1] == (None, None, None)
    assert run(spark, [(1, "kitten")], titles, threshold=61)[1][0] == "sitting"
    assert run(spark, [(1, "ABC")], titles)[1] == (None, None, None)
    assert run(spark, [(1, "ABC")], titles, normalize_case=True)[1] == ("abc", 100.0, 2)


def test_exactly_at_the_threshold(spark):
    assert run(spark, [(1, "abcdefgxyz")], [(1, "abcdefgkkk")])[1] == ("abcdefgkkk", 70.0, 1)


def test_equal_ratios_go_to_the_smallest_id(spark):
    titles = [(9, "abcdefgh1"), (4, "abcdefgh2"), (6, "abcdefgh3")]
    assert run(spark, [(1, "abcdefgh")], titles)[1][2] == 4


def test_exact_match(spark):
    md = spark.createDataFrame([(5, "Same"), (3, "same"), (7, None)], "id bigint, title string")
    rq = spark.createDataFrame([(1, "SAME"), (2, "other"), (3, None)], "request_id bigint, title string")
    got = {r.request_id: r.matched_id for r in matching.match_exact(rq, md).collect()}
    assert got == {1: 3, 2: None, 3: None}


def test_many_requests_for_one_title(spark):
    titles = [(i, f"title number {i:03d}") for i in range(60)]
    requests = [(i, "title numbr 007" if i % 3 else f"title number {i % 60:03d}") for i in range(600)]
    got = run(spark, requests, titles)
    assert all(got[i][2] == (7 if i % 3 else i % 60) for i, _ in requests)


def test_length_buckets_never_hide_a_match():
    class Bucket:
        def __init__(self, shortest, longest):
            self.shortest, self.longest = shortest, longest

    for a in range(0, 40):
        for b in range(0, 40):
            reachable = 200 * min(a, b) >= 70 * (a + b)
            assert matching._compatible(Bucket(a, a), Bucket(b, b), 70) == reachable
            assert not reachable or matching._compatible(Bucket(a, a + 3), Bucket(max(0, b - 2), b), 70)


ONE_HOT = "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 5 = 0 THEN NULL ELSE string(id) END AS k"


def test_hot_keys(spark):
    assert set(frames.hot_keys(spark.range(3000).selectExpr(ONE_HOT), "k")) == {"hot", None}


@pytest.mark.parametrize("partitions", [8, 200_000, 20_000_000])
def test_sketches_stay_within_what_spark_allows(spark, partitions):
    most, tracked = (F.lit(n) for n in frames.sketch_size(partitions))
    sketch = F.call_function("approx_top_k", F.col("k"), most, tracked).alias("top")
    top = spark.range(3000).coalesce(1).selectExpr(ONE_HOT).agg(sketch).first().top
    assert (top[0]["item"], top[0]["count"]) == ("hot", 1000)

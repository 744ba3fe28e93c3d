"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import pytest

from shelfkin.llm import collocations as col


def plain(rows, support, most=2000, longest=5):
    counts, sizes = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^ \t]+", piece)
            sizes[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        n = sizes[lang]
        many = {p: a for p, a in found.items() if len(p) > 1 and a >= support}
        inner = defaultdict(int)
        for p, a in many.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inner[p[i:j]] = max(inner[p[i:j]], a)
        ranked = []
        for p, a in many.items():
            if inner[p] >= a:
                continue
            cuts = [(1000 * a * n // (found[p[:k]] * found[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n, -score))
    return sorted(out)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "of", "A", "É", "x", "yy", "new", "York", "zß"]
    fixed = ["the new york times", "of a kind", "x x x x x x", "yy\tyy"]
    rows = []
    for _ in range(n):
        text = "".join(
            (rng.choice(words) if rng.random() < 0.8 else rng.choice(fixed)) + rng.choice([" ", " ", " ", "  ", ", ", ".", "\n", "\t"])
            for _ in range(rng.randint(0, 40))
        )
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), text))
    return rows + [("en", None), ("fr", ""), (None, " .,; ")]


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "lang string, text string").repartition(parts)


def result(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("seed, support, shards", [(1, 4, 16), (2, 9, 2), (3, 20, 1)])
def test_equal_to_plain_counting(spark, seed, support, shards):
    rows = corpus(seed)
    expected = plain(rows, support)
    assert expected
    assert result(col.collocations(frame(spark, rows), support, shards=shards)) == expected


def test_first_of_a_language(spark):
    rows = corpus(4)
    assert result(col.collocations(frame(spark, rows), 3, most=4)) == plain(rows, 3, most=4)


def test_two_words_at_most(spark):
    rows = corpus(5, 60)
    assert result(col.collocations(frame(spark, rows), 5, longest=2)) == plain(rows, 5, longest=2)


def test_a_crowded_bitmap_lets_nothing_be_lost(spark, monkeypatch):
    monkeypatch.setattr(col, "BITS", 1 << 15)
    rows = [("en", " ".join(f"w{random.Random(i).randrange(3000)}" for i in range(j, j + 300))) for j in range(0, 9000, 60)]
    assert result(col.collocations(frame(spark, rows), 4)) == plain(rows, 4)


def test_one_long_text_and_copies(spark):
    rng = random.Random(6)
    long = " ".join(rng.choices(["a", "b", "c", "d.", "e"], k=60_000))
    rows = [("en", long), *[("en", "a copy of the same text")] * 300]
    assert result(col.collocations(frame(spark, rows), 100)) == plain(rows, 100)


def test_products_beyond_64_bits(spark):
    counted = spark.createDataFrame(
        [("en", "x y", 10**12), ("en", "x", 3 * 10**12), ("en", "y", 7 * 10**12)], "lang string, phrase string, a long"
    )
    candidates = counted.filter("phrase = 'x y'").selectExpr("lang", "phrase", "2 AS k", "a")
    sizes = spark.createDataFrame([("en", 10**14)], "lang string, n long")
    row = col._with_score(candidates, counted, sizes).first()
    assert row.score == 1000 * 10**12 * 10**14 // (21 * 10**24)


def test_no_rows_and_clashing_columns(spark, docs_of, clashing):
    docs = clashing(docs_of((1, "a b " * 200)))
    extra = docs.withColumns({n: docs.text for n in ("words", "tokens", "shard", "need", "rank", "phrase", "k")})
    assert result(col.collocations(extra)) == plain([("en", "a b " * 200)], 100)
    assert col.collocations(docs.filter("false")).count() == 0

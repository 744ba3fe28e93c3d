"""The prefix trie against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from shelfkin.llm import prefix_trie as trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    whole = {}
    original = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    for conv, own in original.items():
        h = zlib.crc32(str(conv).encode()) % 9
        first = conv - (conv % 5 if conv >= 0 else -(-conv % 5))
        whole[conv] = tuple(original.get(first, [])[:h] + own[h:])
    members = defaultdict(list)
    for conv, seq in sorted(whole.items()):
        for d in range(len(seq) + 1):
            members[seq[:d]].append(conv)
    children = defaultdict(int)
    for seq in members:
        if seq:
            children[seq[:-1]] += 1
    saved, leaves = defaultdict(int), defaultdict(int)
    for seq, convs in members.items():
        for d in range(len(seq) + 1):
            saved[seq[:d]] += (len(convs) - 1) * (len(seq[-1][1]) if seq else 0)
            leaves[seq[:d]] += children[seq] == 0
    return sorted(
        (
            convs[0],
            len(seq),
            members[seq[:-1]][0] if seq else -1,
            len(convs),
            children[seq],
            leaves[seq],
            saved[seq],
            hashlib.sha256(",".join(str(c) for c in convs if whole[c] == seq).encode()).hexdigest(),
        )
        for seq, convs in members.items()
    )


def result(df):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in df.select(*COLUMNS).collect())


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts)


def corpus(seed, convs=80, longest=14):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-30, 200), convs):
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "long text"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_to_a_plain_trie(spark, seed):
    rows = corpus(seed)
    assert result(trie.prefix_trie(frame(spark, rows))) == plain(rows)


def test_cut_anywhere(spark, monkeypatch):
    """Blocks of few rows, short segments and runs: every sum crosses borders."""
    monkeypatch.setattr(trie, "BLOCK_ROWS", 3)
    monkeypatch.setattr(trie, "SEGMENT", 2)
    monkeypatch.setattr(trie, "RUN", 2)
    monkeypatch.setattr(trie, "CHUNK_IDS", 2)
    rows = corpus(4) + [(c, t, "user", "same") for c in range(1000, 1100) for t in range(12)]
    assert result(trie.prefix_trie(frame(spark, rows, 7))) == plain(rows)


def test_one_conversation_holds_most_turns(spark):
    rows = [(7, t, "user", str(t % 3)) for t in range(5000)] + [(8, t, "user", str(t % 3)) for t in range(600)] + corpus(5, 20)
    made = trie.prefix_trie(frame(spark, rows, 6))
    mine = {(r.conv_id, r.depth): r for r in made.collect()}
    turns = plain_lengths(rows)
    assert made.count() == len(mine)
    assert max(d for c, d in mine if c == 7) == turns[7]
    assert mine[min(turns), 0].n_convs == len(turns) and mine[7, 4000].n_leaves == 1


def plain_lengths(rows):
    own = defaultdict(int)
    for conv, *_ in rows:
        own[conv] += 1
    out = {}
    for conv, n in own.items():
        h = zlib.crc32(str(conv).encode()) % 9
        first = conv - (conv % 5 if conv >= 0 else -(-conv % 5))
        out[conv] = min(h, own.get(first, 0)) + max(0, n - h)
    return out


def test_rows_without_conversation_ties_and_copies(spark):
    rows = [(None, 1, "user", "x"), (1, None, None, None), (1, None, None, None), (2, 0, "b", "y"), (2, 0, "a", "z"), (2, 0, "a", "z")]
    extra = frame(spark, rows).selectExpr("*", "'x' AS depth", "'x' AS hi", "'x' AS at", "'x' AS size", "'x' AS c1")
    assert result(trie.prefix_trie(extra)) == plain(rows)


def test_empty_tables(spark):
    assert trie.prefix_trie(frame(spark, [(1, 1, "a", "b")]).filter("false")).count() == 0
    assert trie.prefix_trie(frame(spark, [(None, 1, "a", "b")])).count() == 0


def test_reach_and_least_equal_slow_search():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 6, 57)
    table = trie.RangeMin(values)
    for _ in range(300):
        start, bar = int(rng.integers(0, 58)), int(rng.integers(0, 7))
        ahead = next((i for i in range(start, 57) if values[i] < bar), 57) - start
        back = start - 1 - next((i for i in range(start - 1, -1, -1) if values[i] < bar), -1)
        at = np.array([start]), np.array([bar])
        assert table.reach(*at, True)[0] == ahead and table.reach(*at, False)[0] == back
        a, b = sorted(rng.integers(0, 57, 2))
        assert table.least(np.array([a]), np.array([b]))[0] == values[a : b + 1].min()

"""Circulant MinHash against all pairs of small corpora."""

import random

import numpy as np
import pytest

from shelfkin.llm import minhash


def plain_set(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    return {" ".join(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def plain(pairs, percent=80):
    sets = [plain_set(t) for _, t in pairs]
    group = list(range(len(pairs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    out = []
    for at, (doc, _) in enumerate(pairs):
        ids = [d for g, (d, _) in zip(group, pairs) if g == group[at] and d is not None]
        low = min(ids) if ids else None
        out.append((doc, len(sets[at]), low if sets[at] else doc, doc == (low if sets[at] else doc)))
    return sorted(out, key=str)


def result(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def corpus(seed, n=120):
    """Texts at all similarities: copies, chains of edits, and pieces that many share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    shared = " ".join(rng.choices(vocabulary, k=25))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.5:
            words = rng.choice(texts).split(" ")
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        elif kind < 0.7:
            texts.append(shared + " " + " ".join(rng.choices(vocabulary, k=rng.randint(1, 30))))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(docs_of, seed):
    pairs = list(enumerate(corpus(seed)))
    assert result(minhash.near_duplicates(docs_of(*pairs))) == plain(pairs)


def test_small_tiles_and_a_full_filter(docs_of, monkeypatch):
    """Tiles of two members, a filter that lets everything through: the same result."""
    monkeypatch.setattr(minhash, "TILE_MEMBERS", 2)
    monkeypatch.setattr(minhash, "FILTER_BITS", 1 << 15)
    pairs = list(enumerate(corpus(3, 60)))
    assert result(minhash.near_duplicates(docs_of(*pairs))) == plain(pairs)


def test_tiles_alone_find_every_link(docs_of, monkeypatch):
    """Without the first checks all links come from the tiles."""
    empty = lambda shared, nodes, percent: shared.selectExpr("first AS a", "node AS b").limit(0)
    monkeypatch.setattr(minhash, "first_links", empty)
    pairs = list(enumerate(corpus(4, 60)))
    assert result(minhash.near_duplicates(docs_of(*pairs))) == plain(pairs)


def test_hostile_rows(docs_of, clashing):
    pairs = [
        (5, None), (4, ""), (3, " \n\t"), (9, "One"), (8, "one"), (7, "one two"), (None, "One  TWO"), (None, "alone here"),
        (2, "a b c d e f g h i j k l"), (2, "a b c d e f g h i j k l"), (1, "x " * 50), (6, "X x"), (11, "É é"), (12, "é é"),
        (0, "a b c d e f g h i j k l m"),
    ]
    assert result(minhash.near_duplicates(clashing(docs_of(*pairs)))) == plain(pairs)


def test_empty_table(docs_of):
    assert minhash.near_duplicates(docs_of((1, "x")).filter("false")).count() == 0


def test_long_text(docs_of):
    rng = random.Random(5)
    words = [str(rng.randrange(10**6)) for _ in range(200_000)]
    edited = [w if i % 30 else "new" for i, w in enumerate(words)]
    other = [w if i % 5 else "new" for i, w in enumerate(words)]
    pairs = [(2, " ".join(words)), (1, " ".join(edited)), (0, " ".join(other))]
    assert result(minhash.near_duplicates(docs_of(*pairs))) == plain(pairs)


def test_signature_estimates_the_similarity():
    rng = np.random.default_rng(0)
    both = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = both[:2500], both[500:]
    agree = (minhash.signature(np.unique(a)) == minhash.signature(np.unique(b))).mean()
    assert abs(agree - 2000 / 3000) < 0.1


def test_coordinates_are_one_permutation_shifted():
    sigma, pieces = minhash._permutations(minhash.BANDS * minhash.ROWS)
    assert len(set(sigma.tolist())) == minhash.UNIVERSE and len(set(pieces[:, 0].tolist())) == minhash.UNIVERSE
    assert (pieces[:, 7] == np.roll(pieces[:, 0], -7)).all()
    member = np.array([12345], np.uint64)
    assert (minhash.signature(member) == pieces[sigma[12345]]).all()

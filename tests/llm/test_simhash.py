"""SimHash near-duplicates against the definition, bit by bit and pair by pair."""

import random

import numpy as np
import pytest
import xxhash

from shelfkin.llm import common, simhash


def plain_fingerprint(text, n=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in lowered).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", " \n\t", "One", "one two", "One two three", "a b c d e f g", "É é x\x1cy Z z", "x " * 50]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_in_chunks(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=500))
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def plain_components(ids, marks, reach):
    forest = simhash.Forest()
    marks = np.array(marks, np.uint64)
    for i, mark in enumerate(marks):
        for j in np.flatnonzero(np.bitwise_count(marks ^ mark) <= reach).tolist():
            forest.joins(ids[i], ids[j])
    return [forest.root(i) for i in ids]


@pytest.mark.parametrize("levels", [2, 4, 8, 16, 32, 64])
@pytest.mark.parametrize("reach", [0, 1, 2, 3])
def test_values_within_reach_share_a_leaf(levels, reach):
    if levels > 16 and reach > 2:
        return
    rng = np.random.default_rng(levels)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = base.copy()
    for _ in range(reach):
        near ^= np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)
    both = np.r_[base, near]
    leaf, at = simhash.leaves(both, levels, (reach + 1) // 2)
    own = [set(leaf[at == i].tolist()) for i in range(80)]
    assert all(own[i] & own[i + 40] for i in range(40))


@pytest.mark.parametrize("crowded", [4, 2048])
def test_components_equal_brute_force(spark, monkeypatch, crowded):
    """Random fingerprints, chains, and a dense group of near copies, also with deeper trees."""
    rng = np.random.default_rng(3)
    marks = rng.integers(0, 2**63, 200, dtype=np.uint64)
    chain = [marks[0]]
    for _ in range(60):
        chain.append(chain[-1] ^ np.uint64(1 << int(rng.integers(64))))
    dense = [marks[1] ^ np.uint64((1 << int(a)) | (1 << int(b))) for a, b in rng.integers(0, 64, (150, 2))]
    values = np.unique(np.r_[marks, chain, dense].astype(np.uint64))
    leaf, at = simhash.leaves(values, 8, 1)
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    order = np.argsort(leaf, kind="stable")
    forest = simhash.Forest()
    for a, b in simhash._search(leaf[order], values[at[order]], 2, 8):
        assert (np.bitwise_count(a ^ b) <= 2).all()
        for x, y in zip(a.tolist(), b.tolist()):
            forest.joins(x, y)
    mine = [forest.root(x) for x in values.tolist()]
    assert mine == plain_components(values.tolist(), values, 2)


def test_star_rounds_find_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)]
    edges += [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(7, 7)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    forest = simhash.Forest()
    for a, b in edges:
        forest.joins(a, b)
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {x: forest.root(x) for x in nodes}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_copies(n=40):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = rng.choices(words, k=300)
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(i % 3):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    return out


def test_documents(docs_of, clashing):
    texts = near_copies() + ["", None, "  ", "alone in here", "alone IN here"] + ["same text again now"] * 30
    rows = list(enumerate(texts)) + [(None, "alone in here"), (None, "only here"), (3, texts[3])]
    got = simhash.near_duplicates(clashing(docs_of(*rows))).collect()
    assert len(got) == len(rows)
    ids = [i for i, _ in rows if i is not None]
    marks = [plain_fingerprint(t or "") for i, t in rows if i is not None]
    want = {i: (format(m, "016x"), c) for i, m, c in zip(ids, marks, plain_components(ids, marks, 2))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got if r.doc_id is not None} == want
    nameless = {r.fingerprint: r.component_id for r in got if r.doc_id is None}
    assert nameless[format(plain_fingerprint("alone in here"), "016x")] == want[43][1]
    assert nameless[format(plain_fingerprint("only here"), "016x")] is None
    assert simhash.near_duplicates(docs_of()).count() == 0


def test_one_row_of_each_group_stays(spark, docs_of):
    """Different texts under one id are each judged on their own, rows without id too."""
    words = [f"w{i}" for i in range(200)]
    text = " ".join(words)
    near = " ".join([*words[:-1], "end"])
    assert 0 < (simhash.fingerprint(text) ^ simhash.fingerprint(near)).bit_count() <= 2
    other, third, fourth = (" ".join(f"{c}{i}" for i in range(150)) for c in "xyz")
    docs = docs_of(
        (7, near), (3, text), (7, other), (9, other), (None, third), (None, third), (None, fourth), (None, text), (5, third),
        (4, fourth + " more"), (8, ""), (6, None), (3, text),
    )
    kept = simhash.one_of_each_group(docs).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:2]) for r in kept) == sorted(
        [("3", "w0"), ("7", "x0"), ("5", "y0"), ("6", ""), ("4", "z0")]
        + ([] if (simhash.fingerprint(fourth) ^ simhash.fingerprint(fourth + " more")).bit_count() <= 2 else [("None", "z0")])
    )

"""Chat rendering and exact top-k against the plainest form of each."""

import hashlib
import random

import numpy as np
import pytest

from shelfkin.llm import chat_format, topk
from shelfkin.llm.chat_format import Turn

SCRAPS = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "<\\/s>", "[\\\\INST]", "<", "[", "é", "😀", " ", "\n", "ok", "/s>"]


def talk(rng, n):
    roles = ["user", "assistant", "system", "", "[INST]"]
    return [Turn(rng.choice(roles), "".join(rng.choices(SCRAPS, k=rng.randint(0, 8)))) for _ in range(n)]


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choices(SCRAPS, k=rng.randint(0, 10)))
        shown = chat_format.escape(text)
        assert chat_format.unescape(shown) == text
        assert not any(c in shown for c in ("<s>", "</s>", "[INST]", "[/INST]"))


@pytest.mark.parametrize("context", [None, 1, 3])
def test_renders_read_back(context):
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 40):
        turns = talk(rng, n)
        got = chat_format.render(turns, context=context)
        assert got.text == chat_format.template(turns) and chat_format.parse(got.text) == turns
        assert [b for _, b in got.spans] == [a for a, _ in got.spans[1:]] + [len(got.text)] * bool(turns)
        under = [chat_format.unescape(got.text[a:b]) for a, b in got.mask]
        assert under == [t.text for t in turns if t.role == "assistant"]
        assert not got.rewrites


def forgetful(turns, open_role=None):
    """A template that drops the thoughts of all assistant turns but the last."""
    out = ""
    for i, t in enumerate(turns):
        text = t.text if i == len(turns) - 1 else t.text.split("|")[-1]
        out += f"<{t.role}>{text}\n"
    return out if open_role is None else f"{out}<{open_role}>"


def test_tables_compare_whole_prefixes_unless_told_otherwise(spark):
    def fickle(turns, open_role=None):
        """Leaves out the first turn's text where there are three turns."""
        out = "".join(f"<{t.role}>{'' if i == 0 and len(turns) == 3 else t.text}\n" for i, t in enumerate(turns))
        return out if open_role is None else f"{out}<{open_role}>"

    rows = [(1, i, r, f"text {i}") for i, r in enumerate(("user", "assistant", "user", "assistant"))]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert chat_format.format_conversations(df, fickle).first().rewrites
    assert not chat_format.format_conversations(df, fickle, 1).first().rewrites


@pytest.mark.parametrize("context", [None, 1])
def test_rewritten_history_is_detected(context):
    turns = [Turn("user", "a"), Turn("assistant", "think|b"), Turn("user", "c"), Turn("assistant", "d")]
    got = chat_format.render(turns, forgetful, context=context)
    assert got.rewrites == [2] and got.mask == [] and got.text == forgetful(turns)
    assert chat_format.render(turns[:2], forgetful, context=context).rewrites == []


def with_header(turns, open_role=None):
    return "BEGIN " + chat_format.template(turns, open_role)


def test_a_header_is_no_turn():
    turns = talk(random.Random(3), 12)
    whole, cut = (chat_format.render(turns, with_header, context=c) for c in (None, 1))
    assert whole == cut and whole.text.startswith("BEGIN ") and whole.spans[0][0] == 6


def test_conversations(spark):
    rng = random.Random(4)
    rows = [(c, i, *t) for c in range(8) for i, t in enumerate(talk(rng, c * 3))]
    rows += [(20, 1, "user", None), (20, 0, None, "x"), (20, 0, None, "x"), (None, 0, "assistant", "no id"), (20, None, "user", "first")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    path = chat_format.write_formatted(df.selectExpr("*", "'x' AS formatted", "1 AS mask"))
    got = {r.conv_id: r for r in chat_format.read_back(spark.read.parquet(path)).collect()}
    by_conv = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by_conv.setdefault(conv, []).append(Turn(role or "", text or ""))
    assert got.keys() == by_conv.keys()
    for conv, turns in by_conv.items():
        r, own = got[conv], "".join(t.text for t in turns if t.role == "assistant")
        whole = "".join(f"{t.role}\n{t.text}\n" for t in turns)
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_chars == len(own) and r.loss_sha256 == hashlib.sha256(own.encode()).hexdigest()
        assert r.formatted_chars == len(chat_format.template(turns))
    assert chat_format.format_conversations(df.filter("false")).count() == 0


# -- top-k ---------------------------------------------------------------------------------

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain_top(rows, every, k, scale=256):
    """Sorted (query, rank, candidate, score), every row on its own."""
    whole = [
        (i, [int(np.floor(x * scale)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for at, (q, a) in enumerate(whole):
        if q % every == 0:
            scored = [(-sum(x * y for x, y in zip(a, b)), c) for other, (c, b) in enumerate(whole) if other != at]
            out += [(q, rank, c, -s) for rank, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("group_rows, block", [(1 << 16, 1024), (40, 16)])
def test_equal_to_scoring_all(spark, monkeypatch, group_rows, block):
    monkeypatch.setattr(topk, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=12) * rng.choice([0.01, 1, 5])).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]  # one common vector: ties
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(4)
    assert found(topk.exact_top_k(df, 10)) == plain_top(rows, 10, 5)


def test_bounds_prune_and_stay_exact(monkeypatch):
    """A fast-falling spectrum: most candidates are never scored."""
    rng, scored = np.random.default_rng(6), []
    c = np.floor(rng.normal(size=(5000, 32)) * 400 / np.arange(1, 33) ** 2)
    monkeypatch.setattr(topk, "_exact", lambda q, r: scored.append(q.shape[0] * r.shape[0]) or (q @ r.T).astype(np.int64))
    ids, turn = np.arange(5000), np.linalg.eigh(c.T @ c)[1][:, ::-1]
    at, got, score = topk.search(ids[:20], c[:20], ids, ids, c, 5, turn)
    for q in range(20):
        s = (c @ c[q]).astype(np.int64)
        s[q] = -(2**60)
        want = np.lexsort((ids, -s))[:5]
        assert got[at == q].tolist() == want.tolist() and score[at == q].tolist() == s[want].tolist()
    assert sum(scored) < 0.5 * 20 * 5000


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, [1.0]), (2, []), (3, None), (4, [nan, 1.0]), (5, [inf]), (6, [None, 1.0]),
        (None, [1.0, 1.0]), (-50, [0.5, -0.5]), (50, [0.0, 0.0]), (7, [-0.001, 0.001]),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows + rows[:3]], SCHEMA)
    got = found(topk.exact_top_k(df.selectExpr("*", "1 AS mark", "2 AS tile"), 50))
    padded = [(i, None if v is None else v + [0.0] * (2 - len(v))) for i, v in rows + rows[:3]]
    assert got == plain_top(padded, 50, 5)
    assert topk.exact_top_k(df.filter("false"), 50).count() == 0
    assert topk.exact_top_k(df.filter("vec_id = 1"), 50).count() == 0
    assert topk.exact_top_k(df.filter("vec_id = 50"), 50).count() == 0


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(0, [3e7, 1.0]), (1, [3e7, 1.0]), (2, [3e7, 2.0]), (3, [1e300, 0.0]), (4, [-1e300, 0.0])]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = sorted((r["rank"], r.vec_id, r.score) for r in topk.exact_top_k(df, 50).collect())
    assert got == [(1, 3, None), (2, 2, None), (3, 1, None), (4, 4, None)]


def test_repeated_rows_are_rows_of_their_own_as_in_the_sql(spark, tmp_path):
    import duckdb

    from shelfkin.llm import queries

    a, b, c, d = [1.0, 0.5], [0.25, 2.0], [3.0, 1.0], [-1.0, 0.0]
    rows = [(50, a), (50, b), (50, b), (1, c), (1, c), (1, c), (2, d), (2, c), (100, a), (3, c), (3, a)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(3)
    got = found(topk.exact_top_k(df, 50))
    assert got == plain_top(rows, 50, 5)
    df.coalesce(1).write.parquet(str(tmp_path / "embeddings"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings/*.parquet'")
    sql = db.execute(queries.ORACLES["op9_exact_top_k"]).df()
    assert sorted(sql[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None)) == got

"""Registered queries of this subpackage and the SQL that checks them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfkin.llm import (
    chat_format,
    collocations,
    decontaminate,
    line_dedup,
    minhash,
    prefix_trie,
    secret_scan,
    sentencepiece_codec,
    simhash,
    token_counts,
    token_store,
    topk,
    toxicity,
)
from shelfkin.llm.common import shared_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"), shingle=3, reach=2)


@query("op5_secret_scans")
def secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf, "documents")))


CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query(
    "op8_chat_formatting",
    r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        sum(length('[INST][/INST]</s>') + length(role) + length(text)
            + len(regexp_extract_all(role, '<\\*/?s>|\[\\*/?INST\]'))
            + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]')))::BIGINT AS formatted_chars
    FROM turns GROUP BY conv_id
    """,
)
def chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame(
        [(-7, i, role, CONTROL_TEXT) for i, role in enumerate(("user", "assistant"))], turns.schema
    )
    path = chat_format.write_formatted(turns.unionByName(control), context=chat_format.TEMPLATE_CONTEXT)
    return chat_format.read_back(spark.read.parquet(path))


@query(
    "op9_exact_top_k",
    """
    WITH whole AS (
        SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.row_id, q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.vec, c.vec)::BIGINT AS score
        FROM whole q, whole c WHERE q.vec_id % 50 = 0 AND c.row_id <> q.row_id)
    SELECT query_id, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
    FROM scored QUALIFY rank <= 5
    """,
)
def exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf, "embeddings"), every=50, k=5, scale=256)


@query("op2_sentencepiece_encoding_decoding")
def sentencepiece_encoding_decoding(spark: SparkSession, sf: str) -> DataFrame:
    return sentencepiece_codec.digest(table(spark, sf, "documents"))


@query("op3_token_counts")
def count_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf, "documents"))


@query("op6_token_ids_binary_output")
def token_ids_binary_output(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_store.write(table(spark, sf, "documents"), path, end_id=2)
    return token_store.digest(spark, path)


@query("op4_toxicity")
def toxic_documents(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op7_line_dedup")
def deduplicate_lines(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf, "documents"))


@query("op10_benchmark_decontamination")
def benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


LOWER_WORDS = r"translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_phrase_collocations",
    rf"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, w FROM (
            SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
                SELECT lang, unnest(string_split_regex({LOWER_WORDS}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents))),
    sizes AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
    counted AS (
        SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM (
            SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (
                SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i
                FROM pieces, (SELECT unnest(generate_series(1, 5)) AS k) WHERE len(w) >= k))
        GROUP BY ALL HAVING count(*) >= 100),
    cuts AS (
        SELECT lang, phrase, k, a, c, array_to_string(list_slice(words, 1, c), ' ') AS head,
            array_to_string(list_slice(words, c + 1, k), ' ') AS tail FROM (
            SELECT lang, phrase, k, a, string_split(phrase, ' ') AS words, unnest(generate_series(1, k - 1)) AS c
            FROM counted WHERE k > 1)),
    scored AS (
        SELECT cuts.lang, cuts.phrase, cuts.k, cuts.a, c, x.a AS l, y.a AS r, n, (1000 * cuts.a * n) // (x.a * y.a) AS score
        FROM cuts JOIN sizes ON sizes.lang = cuts.lang JOIN counted x ON x.lang = cuts.lang AND x.phrase = head
        JOIN counted y ON y.lang = cuts.lang AND y.phrase = tail
        QUALIFY row_number() OVER (PARTITION BY cuts.lang, cuts.phrase ORDER BY score, c) = 1),
    inner_spans AS (
        SELECT DISTINCT lang, array_to_string(list_slice(words, i, i + s - 1), ' ') AS phrase, a FROM (
            SELECT lang, words, k, a, s, unnest(generate_series(1, k - s + 1)) AS i FROM (
                SELECT lang, string_split(phrase, ' ') AS words, k, a, unnest(generate_series(2, k - 1)) AS s
                FROM counted WHERE k > 2))),
    kept AS (
        SELECT * FROM scored s WHERE NOT EXISTS (
            SELECT 1 FROM inner_spans i WHERE i.lang = s.lang AND i.phrase = s.phrase AND 100 * i.a >= 100 * s.a))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INT AS rank, phrase,
        a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM kept QUALIFY rank <= 2000
    """,
)
def phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


@query(
    "op12_minhash_near_dedup",
    rf"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(string_split_regex({LOWER_WORDS}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents),
    sets AS (
        SELECT doc_id, CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_distinct(list_transform(
            generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
    different AS (SELECT s, len(s) AS n, min(doc_id) AS node FROM sets WHERE len(s) > 0 GROUP BY s),
    shingles AS (SELECT node, n, hash(unnest(s)) AS g FROM different),
    links AS (
        SELECT a.node AS x, b.node AS y FROM shingles a JOIN shingles b
            ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
        GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    both_ways AS (SELECT x, y FROM links UNION SELECT y AS x, x AS y FROM links),
    reached AS (
        SELECT node, node AS other FROM different
        UNION SELECT reached.node, y AS other FROM reached JOIN both_ways ON x = other),
    lowest AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node)
    SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id,
        doc_id = coalesce(component_id, doc_id) AS kept
    FROM sets LEFT JOIN different ON sets.s = different.s LEFT JOIN lowest USING (node)
    """,
)
def minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf, "documents"))


@query(
    "op13_conversation_prefix_trie",
    """
    WITH turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
            PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (
        SELECT conv_id, conv_id - conv_id % 5 AS family, xor(4294967295, list_reduce(
            flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
            lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295)) % 9 AS h
        FROM (SELECT DISTINCT conv_id FROM turns)),
    rebuilt AS (
        SELECT conv_id, list({'role': role, 'text': text} ORDER BY own, pos) FILTER (own IS NOT NULL) AS seq FROM (
            SELECT c.conv_id, false AS own, pos, role, text FROM convs c JOIN turns t ON t.conv_id = family AND pos <= h
            UNION ALL SELECT c.conv_id, true, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND pos > h
            UNION ALL SELECT conv_id, NULL, NULL, NULL, NULL FROM convs)
        GROUP BY conv_id),
    whole AS (SELECT conv_id, coalesce(seq, []) AS seq FROM rebuilt),
    prefixes AS (
        SELECT conv_id, d, list_slice(seq, 1, d) AS p, d = len(seq) AS at_end
        FROM (SELECT conv_id, seq, unnest(generate_series(0, len(seq))) AS d FROM whole)),
    nodes AS (
        SELECT p, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256,
            (count(*) - 1) * CASE d WHEN 0 THEN 0 ELSE strlen(p[d].text) END AS saved
        FROM prefixes GROUP BY p, d),
    linked AS (
        SELECT n.*, u.conv_id AS parent_conv_id, coalesce(k.n_children, 0) AS n_children
        FROM nodes n LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.p = list_slice(n.p, 1, n.depth - 1)
        LEFT JOIN (SELECT list_slice(p, 1, depth - 1) AS up, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up) k
            ON k.up = n.p),
    below AS (SELECT list_slice(p, 1, d) AS p, n_children, saved FROM (
        SELECT p, n_children, saved, unnest(generate_series(0, depth)) AS d FROM linked))
    SELECT conv_id, depth, parent_conv_id, n_convs, linked.n_children, ends_sha256,
        count(*) FILTER (below.n_children = 0) AS n_leaves, sum(below.saved)::BIGINT AS saved_tokens
    FROM linked JOIN below ON below.p = linked.p
    GROUP BY linked.p, conv_id, depth, parent_conv_id, n_convs, linked.n_children, ends_sha256
    """,
)
def conversation_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))

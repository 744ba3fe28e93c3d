"""Phrase collocations by SON partitioning.

The texts are dealt over a fixed number of shards.  A phrase that occurs `support` times among
the n words of a language occurs at least support * n_s / n times in one of the shards, n_s being
the shard's words of that language.  So every shard is mined completely at that lowered support,
the phrases that are frequent in some shard are united, and all of them are then counted exactly
over everything.

A shard is mined level by level: a phrase of k words can be frequent only if its first and its
last k - 1 words are.  What a level has found travels to the next as a bitmap of fixed size over
phrase hashes.  Hashes and bitmaps can only let more phrases through, never fewer.  The last count
is made in two steps: of hashes, which leaves those that may have the support, and then of the
phrases themselves.  The number of shards does not grow with the input, as the local support would
sink to one; a shard's counts are made by as many tasks as hold its words.

Counts of hashes travel as sorted runs of 32 bits each with counts as wide as the support needs,
one run for each range of hashes; the number of ranges grows with the words, so that the runs of a
range that meet in one task have a bounded number of hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfkin.llm.common import parts_of, passing_tables, rows_per_batch, stored, text_of
from shelfkin.llm.line_dedup import words_of

SEED = 42
SHARDS = 16
LONGEST = 5  # words of a phrase
BITS = 1 << 24  # of the bitmap of a level: 2 MB
BUCKET = 1 << 15  # bits of one row of Spark's bitmap functions
PART_BYTES = 256 << 10  # text of one row of the table of words, about
ROWS_AT_ONCE = 32  # rows of the table of words in a batch
ROW_GROUP = 8 << 20  # of the table of words: what a reader holds at once
PARTS_OF_A_SHARD = 32  # rows of the table of words in a row that go to one shard
HELD = 1 << 22  # hashes that a task counts before it hands them on, about
PHRASES_HELD = 1 << 18  # phrases, likewise
RANK_GROUPS = 64  # of the phrases of a language, ranked apart first
RANGE_WORDS = 1 << 22  # words whose hashes may meet in one range
FOLD = np.uint64(0x9E3779B97F4A7C15)  # an odd number, 2^64 over the golden ratio
# A piece ends at . , ; : ! ? and at line feed to carriage return; words are parted
# by blanks and tabs.
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
NO_LANGUAGE = "und"

_PLAIN = bytes.maketrans(
    bytes(range(ord("A"), ord("Z") + 1)) + PIECE_ENDS + b"\t",
    bytes(range(ord("a"), ord("z") + 1)) + b"\n" * len(PIECE_ENDS) + b" ",
)

TOKENS = "shard int, lang string, words binary, tokens binary, n_words long"


def split_words(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows of words in order: some texts of one language, numbered by their own word list.

    `words` are parted by blanks, and `tokens` holds a 32-bit place among them for each word and -1
    where a piece ends.
    """
    schema = pa.schema(
        [
            ("shard", pa.int32()),
            ("lang", pa.string()),
            ("words", pa.binary()),
            ("tokens", pa.binary()),
            ("n_words", pa.int64()),
        ]
    )

    def numbered(texts: list[bytes]) -> tuple | None:
        plain = b"\n".join(texts).translate(_PLAIN).replace(b"\n", b" \n ")
        found = [w for w in plain.split(b" ") if w]
        coded = pa.array(found, pa.binary()).dictionary_encode()
        words = coded.dictionary.to_pylist()
        tokens = coded.indices.to_numpy().astype(np.int32)
        if b"\n" in words:  # the mark becomes -1 and the last word takes its number
            mark, last = words.index(b"\n"), len(words) - 1
            tokens = np.where(tokens == mark, -1, np.where(tokens == last, mark, tokens)).astype(np.int32)
            words[mark] = words[last]
            words.pop()
        if not words:
            return None
        return b" ".join(words), tokens.tobytes(), int((tokens >= 0).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n_parts = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in parts_of(batch, PART_BYTES) if batch.num_rows else ():
                shard = (task + 5 * (n_parts // PARTS_OF_A_SHARD)) % shards  # 5: neighbouring tasks part ways
                n_parts += 1
                langs = part.column("lang")
                texts = part.column("text").cast(pa.binary())
                for lang in pc.unique(langs).to_pylist():
                    rows = numbered(texts.filter(pc.equal(langs, lang)).to_pylist())
                    if rows:
                        values = (shard, lang, *rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([v], field.type) for v, field in zip(values, schema)], schema=schema
                        )

    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang")
    return docs.select(lang, text_of()).mapInArrow(run, TOKENS)


def _levels(lang: str, words: bytes, tokens: pa.Buffer, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, hash of the phrase of k words that begins at each token, whether there is one)."""
    place = np.frombuffer(tokens, np.int32)
    word = words_of(words) ^ np.uint64(xxhash.xxh64_intdigest(lang.encode(), SEED))
    each, inside = np.append(word, np.uint64(0))[place], place >= 0  # the last one is never used
    phrase, fits = each, inside
    for k in range(1, longest + 1):
        if k > 1:
            phrase = phrase[:-1] * FOLD + each[k - 1 :]
            phrase ^= phrase >> np.uint64(29)
            fits = fits[:-1] & inside[k - 1 :]
        yield k, phrase, fits
        if len(phrase) < 2:
            return


def _passes(bitmap: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Whether the bit of each phrase is set in a bitmap packed with the lowest bit first."""
    bit = phrase >> np.uint64(64 - (8 * len(bitmap)).bit_length() + 1)
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _whole(levels, bitmaps: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, hashes, starts) of the phrases that pass the bitmap of their level, as do their first and last words."""
    before: np.ndarray | None = None
    for k, phrase, fits in levels:
        here = fits & _passes(bitmaps[k - 1], phrase)
        if before is not None:
            here &= before[:-1] & before[1:]
        before, at = here, np.flatnonzero(here)
        yield k, phrase[at], at


def _surviving(levels, bitmaps: list[np.ndarray], k: int) -> np.ndarray:
    """Hashes of the phrases of k words whose first and last k - 1 words may be frequent."""
    fits = None
    for level, phrase, inside in levels:
        if level == k - 1:
            may = inside & _passes(bitmaps[level - 1], phrase)
            fits = may[:-1] & may[1:]
        if level == k:
            return phrase[inside if fits is None else inside & fits]
    return np.zeros(0, np.uint64)


def _packed(hashes: np.ndarray) -> bytes:
    """Ascending hashes as the planes of bytes of their differences."""
    steps = np.diff(hashes, prepend=np.uint32(0))
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(planes: bytes) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32)
    return np.cumsum(steps.ravel(), dtype=np.uint32)


RUNS = "part long, kind int, need long, prefix long, hashes binary, counts binary"


def _runs(part: int, kind: int, need: int, prefix_bits: int, phrases: list[np.ndarray]) -> pa.RecordBatch:
    """Hashes and their counts, one row for each range of hashes; a range shares its first bits.

    No count above `need` matters, so counts are cut there and are as wide as it needs.  Hashes
    are written as differences, first their lowest bytes, then the next: the highest are nearly
    all zero and compress away.
    """
    phrase, count = np.unique(np.concatenate(phrases), return_counts=True)
    prefix = (phrase >> np.uint64(32)) >> np.uint64(32 - prefix_bits)
    rest = ((phrase << np.uint64(prefix_bits)) >> np.uint64(32)).astype(np.uint32)
    count = np.minimum(count, need).astype(np.min_scalar_type(need))
    edges = np.flatnonzero(np.diff(prefix, prepend=prefix[:1])) if len(prefix) else np.zeros(0, np.int64)
    starts = np.r_[0, edges] if len(prefix) else edges
    ends = np.r_[starts[1:], len(prefix)]
    n = len(starts)
    arrays = [
        pa.array(np.full(n, part, np.int64)),
        pa.array(np.full(n, kind, np.int32)),
        pa.array(np.full(n, need, np.int64)),
        pa.array(prefix[starts].astype(np.int64)),
        pa.array([_packed(rest[a:b]) for a, b in zip(starts, ends)], pa.binary()),
        pa.array([count[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["part", "kind", "need", "prefix", "hashes", "counts"])


def _frequent(runs: DataFrame, prefix_bits: int) -> DataFrame:
    """(kind, bit): bits of the hashes whose counts come to `need` within their part and kind."""
    shift = prefix_bits + 32 - (BITS.bit_length() - 1)

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, kind, need, prefix = (k.as_py() for k in key)
        hashes = np.concatenate([_unpacked(run) for run in table.column("hashes").to_pylist()])
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.min_scalar_type(need))
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]))
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        many = hashes[first[total >= need]].astype(np.uint64) | np.uint64(prefix << 32)
        bits = np.unique(many >> np.uint64(shift) if shift >= 0 else many << np.uint64(-shift)).astype(np.int64)
        return pa.table({"kind": pa.array(np.full(len(bits), kind, np.int32)), "bit": bits})

    return runs.groupBy("part", "kind", "need", "prefix").applyInArrow(merged, "kind int, bit long")


def _prefix_bits(words: int) -> int:
    """Bits of the prefix that parts the hashes of so many words into ranges."""
    return min(32, (words // RANGE_WORDS).bit_length())


def _bitmaps(frequent: DataFrame, longest: int) -> list[bytes]:
    """For each kind from 1 on, BITS bits: at most BITS / BUCKET rows of 4 KB."""
    rows = (
        frequent.groupBy("kind", F.floor(F.col("bit") / BUCKET).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.pmod("bit", F.lit(BUCKET))).alias("bits"))
        .collect()
    )
    whole = [bytearray(BITS // 8) for _ in range(longest)]
    for row in rows:
        whole[row.kind - 1][row.bucket * (BUCKET // 8) : (row.bucket + 1) * (BUCKET // 8)] = row.bits
    return [bytes(w) for w in whole]


def _known(bitmaps: list[Broadcast]) -> list[np.ndarray]:
    return [np.frombuffer(b.value, np.uint8) for b in bitmaps]


def local_counts(tokens: DataFrame, k: int, bitmaps: list[Broadcast], prefix_bits: int) -> DataFrame:
    """`RUNS` of the phrases of k words that can be frequent, by shard and language.

    `tokens` has the columns `part`, a hash of its shard and language, and `need`, the least
    count that is frequent there.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(bitmaps)
        for batch in batches:
            found: dict[tuple[int, int], list[np.ndarray]] = {}
            columns = (batch.column(c) for c in ("part", "need", "lang", "words", "tokens"))
            for part, need, lang, words, packed in zip(*columns):
                levels = _levels(lang.as_py(), words.as_py(), packed.as_buffer(), k)
                found.setdefault((part.as_py(), need.as_py()), []).append(_surviving(levels, known, k))
            for (part, need), phrases in found.items():
                yield _runs(part, k, need, prefix_bits, phrases)

    return tokens.mapInArrow(rows, RUNS)


def locally_frequent(tokens: DataFrame, longest: int, prefix_bits: int) -> list[Broadcast]:
    """A bitmap for each number of words: the phrases that are frequent in some shard."""
    found: list[Broadcast] = []
    for k in range(1, longest + 1):
        frequent = _frequent(local_counts(tokens, k, found, prefix_bits), prefix_bits)
        found.append(tokens.sparkSession.sparkContext.broadcast(_bitmaps(frequent, k)[k - 1]))
    return found


def globally_frequent(rows: DataFrame, bitmaps: list[Broadcast], support: int, prefix_bits: int) -> list[Broadcast]:
    """Bitmaps of those phrases of `bitmaps` whose hashes have the support over everything."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(bitmaps)
        found: dict[int, list[np.ndarray]] = {}
        size = 0
        for batch in batches:
            for lang, words, packed in zip(*(batch.column(c) for c in ("lang", "words", "tokens"))):
                levels = _levels(lang.as_py(), words.as_py(), packed.as_buffer(), len(known))
                for k, phrase, _ in _whole(levels, known):
                    found.setdefault(k, []).append(phrase)
                    size += len(phrase)
            if size >= HELD:
                for k, phrases in found.items():
                    yield _runs(0, k, support, prefix_bits, phrases)
                found, size = {}, 0
        for k, phrases in found.items():  # a phrase hash is of one language
            yield _runs(0, k, support, prefix_bits, phrases)

    frequent = _frequent(rows.mapInArrow(counted, RUNS), prefix_bits)
    context = rows.sparkSession.sparkContext
    return [context.broadcast(bits) for bits in _bitmaps(frequent, len(bitmaps))]


def global_counts(tokens: DataFrame, bitmaps: list[Broadcast], support: int, prefix_bits: int) -> DataFrame:
    """(lang, phrase, k, a): the count a >= `support` of every phrase that passes the bitmaps.

    Phrases travel sorted and compressed, one row for each range of hashes.
    """
    blank = pa.scalar(b" ", pa.binary())
    shift = np.uint64(32 - prefix_bits)

    def rows(lang: str, words: bytes, packed: pa.Buffer, known: list[np.ndarray]) -> Iterator[pa.Table]:
        place = np.frombuffer(packed, np.int32)
        names = pa.array(words.split(b" "), pa.binary())
        for k, phrase, at in _whole(_levels(lang, words, packed, len(known)), known):
            if not len(at):
                continue
            # Hashes bring equal phrases together, word numbers tell phrases apart; should
            # two phrases share a hash, one may be counted in several parts.
            order = np.argsort(phrase, kind="stable")
            told = np.stack([place[at[order] + i] for i in range(k)], axis=1)
            first = np.flatnonzero(np.r_[True, (told[1:] != told[:-1]).any(axis=1)])
            count = np.diff(np.r_[first, len(told)]).astype(np.int64)
            texts = [names.take(pa.array(told[first, i])) for i in range(k)]
            text = pc.binary_join_element_wise(*texts, blank) if k > 1 else texts[0]
            prefix = ((phrase[order[first]] >> np.uint64(32)) >> shift).astype(np.int64)
            yield pa.table({"lang": pa.array([lang] * len(text), pa.string()), "prefix": prefix, "phrase": text, "n": count})

    def once(tables: list[pa.Table]) -> pa.Table:
        table = pa.concat_tables(tables).group_by(["lang", "prefix", "phrase"]).aggregate([("n", "sum")])
        return table.select(["lang", "prefix", "phrase", "n_sum"]).rename_columns(["lang", "prefix", "phrase", "n"])

    def packed(table: pa.Table) -> pa.RecordBatch:
        table = table.sort_by([("lang", "ascending"), ("prefix", "ascending"), ("phrase", "ascending")]).combine_chunks()
        kinds = table.group_by(["lang", "prefix"], use_threads=False).aggregate([("phrase", "count")])
        at, phrases, counts = 0, [], []
        for size in kinds.column("phrase_count").to_pylist():
            part = table.slice(at, size)
            phrases.append(zlib.compress(b"\n".join(part.column("phrase").to_pylist())))  # no word has a line end
            counts.append(zlib.compress(part.column("n").to_numpy().tobytes()))
            at += size
        keys = [kinds.column(c).combine_chunks() for c in ("lang", "prefix")]
        arrays = [*keys, pa.array(phrases, pa.binary()), pa.array(counts, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["lang", "prefix", "phrases", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(bitmaps)
        held: list[pa.Table] = []
        for batch in batches:
            columns = (batch.column(c) for c in ("lang", "words", "tokens"))
            found = [t for a, b, c in zip(*columns) for t in rows(a.as_py(), b.as_py(), c.as_buffer(), known)]
            if found:
                held = [once([*held, *found])]
                if held[0].num_rows >= PHRASES_HELD:
                    yield packed(held[0])
                    held = []
        if held:
            yield packed(held[0])

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = []
        for phrases, counts in zip(table.column("phrases"), table.column("counts")):
            phrase = pa.array(zlib.decompress(phrases.as_py()).split(b"\n"), pa.binary())
            n = np.frombuffer(zlib.decompress(counts.as_py()), np.int64)
            parts.append(pa.table({"phrase": phrase, "n": n}))
        total = pa.concat_tables(parts).group_by("phrase").aggregate([("n", "sum")])
        total = total.filter(pc.greater_equal(total.column("n_sum"), support))
        phrase = total.column("phrase")
        return pa.table(
            {
                "lang": pa.array([key[0].as_py()] * total.num_rows, pa.string()),
                "phrase": phrase.cast(pa.string()),
                "k": pc.add(pc.count_substring(phrase, b" "), 1).cast(pa.int32()),
                "a": total.column("n_sum"),
            }
        )

    runs = tokens.mapInArrow(run, "lang string, prefix long, phrases binary, counts binary")
    return runs.groupBy("lang", "prefix").applyInArrow(merged, "lang string, phrase string, k int, a long")


def _with_score(candidates: DataFrame, counted: DataFrame, sizes: DataFrame) -> DataFrame:
    """Candidates with l, r, n and score of their lowest-scoring cut, ties to the first cut."""
    words = F.split("phrase", " ")

    def joined(start: Column, length: Column) -> Column:
        return F.array_join(F.slice("words", start, length), " ")

    cuts = (
        candidates.withColumn("words", words)
        .withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
        .withColumns(
            {"left_part": joined(F.lit(1), F.col("cut")), "right_part": joined(F.col("cut") + 1, F.col("k") - F.col("cut"))}
        )
        .drop("words")
    )
    counts = counted.select("lang", F.col("phrase").alias("part"), "a")
    left = counts.withColumnsRenamed({"part": "left_part", "a": "l"})
    right = counts.withColumnsRenamed({"part": "right_part", "a": "r"})
    parts = cuts.join(left, ["lang", "left_part"]).join(right, ["lang", "right_part"]).join(sizes, "lang")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r")}
    over = (wide["a"] * wide["n"] * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")
    under = (wide["l"] * wide["r"]).cast("decimal(38,0)")
    scored = parts.withColumns({"over": over, "under": under}).withColumn("score", F.expr("`over` div `under`"))
    lowest = F.min(F.struct("score", "cut", "l", "r", "n")).alias("lowest")
    return scored.groupBy("lang", "phrase", "k", "a").agg(lowest).select("lang", "phrase", "k", "a", "lowest.*").drop("cut")


def _contained(candidates: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, most): the highest count of the longer candidates that hold a phrase."""
    words = F.split("phrase", " ")
    none = F.array().cast("array<string>")

    def inside(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.col("k") - size + 1)
        spans = F.transform(starts, lambda at: F.array_join(F.slice("words", at, size), " "))
        return F.when(F.col("k") > size, spans).otherwise(none)

    inner = F.concat(none, *[inside(size) for size in range(2, longest)])
    held = candidates.filter("k > 2").withColumn("words", words).select("lang", F.explode(inner).alias("phrase"), "a")
    return held.groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def collocations(
    docs: DataFrame, support: int = 100, longest: int = LONGEST, most: int = 2000, shards: int = SHARDS
) -> DataFrame:
    """The first `most` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts have A-Z lowered and are cut into pieces and words (see `PIECE_ENDS`).  A candidate is a
    phrase of 2 to `longest` words inside a piece that occurs a >= `support` times in its
    language, overlaps included; n is the number of words of the language.  The candidate is cut
    in two, l and r being the counts of both parts, so that floor(1000 * a * n / (l * r)), its
    score, is lowest.  One whose words lie inside a longer candidate that occurs as often is left
    out.  The rest are ranked by score and a, both descending, and phrase in byte order.

    A null lang is `und`, together with rows that say so; an empty one is a language of its own.
    Null and empty texts have no words; repeated rows count each time.  Other columns of `docs`
    are not read.  An empty table, and a language without candidates, give no rows.
    """
    with passing_tables(docs.sparkSession):
        rows = stored(split_words(docs, shards), "tokens", block_bytes=ROW_GROUP)
        held = stored(rows.groupBy("shard", "lang").agg(F.sum("n_words").alias("held")), "held")
        sizes = stored(held.groupBy("lang").agg(F.sum("held").alias("n")), "sizes")
        need = F.expr(f"cast(ceil(cast({support} * held AS decimal(38,0)) / n) AS bigint)")
        part = F.xxhash64("shard", "lang").alias("part")
        needs = held.join(sizes, "lang").select("shard", "lang", F.greatest(need, F.lit(1)).alias("need"), part)
        tokens = rows.join(F.broadcast(needs), ["shard", "lang"])  # a row per shard and language
        most_held, all_words = held.agg(F.max("held"), F.sum("held")).first()
        with rows_per_batch(docs.sparkSession, ROWS_AT_ONCE):
            local = locally_frequent(tokens, longest, _prefix_bits(most_held or 0))
            bitmaps = globally_frequent(rows, local, support, _prefix_bits(all_words or 0))
            counted = stored(global_counts(rows, bitmaps, support, _prefix_bits(all_words or 0)), "counted")
        candidates = counted.filter("k > 1")
        scored = _with_score(candidates, counted, sizes)
        kept = scored.join(_contained(candidates, longest), ["lang", "phrase"], "left")
        kept = kept.filter(F.col("most").isNull() | (F.col("most") < F.col("a")))
        order = F.desc("score"), F.desc("a"), "phrase"
        # Each of some groups of a language keeps its first phrases, so that no task ranks them all.
        kept = kept.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS)))
        for group in (["lang", "group"], ["lang"]):
            rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
            kept = kept.withColumn("rank", rank).filter(F.col("rank") <= most)
        result = stored(kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations", lasting=True)
        for bitmap in (*local, *bitmaps):
            bitmap.unpersist()
    return result

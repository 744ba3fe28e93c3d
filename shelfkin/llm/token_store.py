"""Token ids of a corpus in a compact file format, and back.

A store is a folder: `table` holds the one frequency table (symbols and frequencies), `blocks`
one row for each block.  A block has whole documents, in ascending doc_id order, about BLOCK
tokens, and can be read alone: position of its first token in the corpus, doc_ids, sizes, and
the ids as coded by `rans` with checkpoints and checksums.  Spark's Parquet writer commits the
rows, so a lost executor leaves no half-written store.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfkin.llm import rans
from shelfkin.llm.common import parts_of, passing_tables, stored, text_of

BLOCK = 1 << 20
TOGETHER = 1 << 23  # bytes of text whose words are made distinct together
HELD = 1_000_000  # distinct words whose ids a Python worker holds, some 200 MB
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # parted from letters before them; not the apostrophe
# The letters that stand for bytes in byte-level models: printable ones for themselves, the others
# from 256 on.
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = {b: chr(b) for b in PLAIN} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*PLAIN}))}


class Words(dict):
    """Encodes texts with a tokenizer that drops white space; maps words to the bytes of their ids.

    Such a tokenizer gives a text the ids of its words, one after another.  Words are what the
    six ASCII white-space characters part; A-Z are lowered first, as the tokenizer does it, where
    the text holds no special token that might appear by that.  Words of letters that its
    normaliser leaves as they are go to the library's model at once, apart from the marks behind
    them; all others are encoded by the whole tokenizer.  Ids are numbers of `kind`; beyond HELD words the memory is emptied,
    which changes no result.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.packed = [int(i).to_bytes(self.kind.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.parts = drops_blanks(rules)
        self.lowers = self.parts and "Lowercase" in str(rules["normalizer"])
        self.letters = self.lowers and r"[\p{L}]+" in rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = {t["content"][:2] for t in rules["added_tokens"]}

    def whole(self, text: str) -> bytes:
        """The ids of a text by the whole tokenizer."""
        packed = self.packed
        return b"".join([packed[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(MARKS)
        if not (self.letters and core.isalpha() and core == core.lower() and is_normalized("NFC", core)):
            ids = self.whole(word)
        elif len(core) < len(word):
            ids = self[core] + self[word[len(core) :]]
        else:
            shown = core if core.isascii() else core.encode().decode("latin-1").translate(BYTE_LETTERS)
            packed = self.packed
            ids = b"".join([packed[t.id] for t in self.tokenize(shown)])
        self[word] = ids
        return ids

    def encode(self, texts: pa.Array, tail: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, `tail` after each, and how many each text has.

        The words of all texts are made distinct by Arrow; only these are looked up one by one.
        """
        if not self.parts:
            return self._apart(texts.to_pylist(), tail)
        if self.lowers:
            for two in self.special:  # lowering might make a special token appear
                if pc.any(pc.match_substring(texts, two)).as_py():
                    return self._apart(texts.to_pylist(), tail)
            texts = pc.ascii_lower(texts)
        if len(self) > HELD:
            self.clear()
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        width = self.kind.itemsize
        known = [self[w] if w else b"" for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()]
        flat = np.frombuffer(b"".join(known), self.kind)
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // width
        at = words.indices.to_numpy(zero_copy_only=False)
        sizes, starts = lengths[at], (np.cumsum(lengths) - lengths)[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]
        offsets = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        per_text = np.diff(np.r_[0, ends][offsets])
        if not tail:
            return ids, per_text
        extra = np.frombuffer(tail, self.kind)
        out = np.empty(total + len(extra) * len(texts), self.kind)
        order = np.arange(len(texts)) * len(extra)
        out[np.arange(total) + np.repeat(order, per_text)] = ids
        for i, value in enumerate(extra):
            out[np.cumsum(per_text) + order + i] = value
        return out, per_text + len(extra)

    def _apart(self, texts: list[str], tail: bytes) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.whole(t) + tail for t in texts]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        return np.frombuffer(b"".join(parts), self.kind), sizes


def drops_blanks(rules: dict) -> bool:
    """Whether a tokenizer file parts texts at white space and drops it before anything else."""
    steps = rules["pre_tokenizer"].get("pretokenizers", [rules["pre_tokenizer"]]) if rules["pre_tokenizer"] else []
    first = steps[0] if steps else {}
    pattern = first.get("pattern", {}).get("Regex", "")
    normal = rules["normalizer"].get("normalizers", [rules["normalizer"]]) if rules["normalizer"] else []
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and bool(first.get("invert"))
        and " " not in pattern
        and pattern.count(r"\s") == pattern.count(r"[^\s")
        and all(n["type"] in ("NFC", "Replace", "Lowercase") for n in normal)
        and rules["post_processor"] is None
    )


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


_CHUNK = "part int, before long, doc_ids array<long>, sizes array<long>, n_tokens long, width int, ids binary, used binary, counts binary"


def _chunks(docs: DataFrame, path: str, end_id: int | None, block: int) -> DataFrame:
    """Token ids in ascending doc_id order, in rows of about `block` tokens of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box, part = words(path), TaskContext.get().partitionId()
        width = box.kind.itemsize
        tail = b"" if end_id is None else np.array([end_id], box.kind).tobytes()
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        before = held = 0

        def row() -> pa.RecordBatch:
            data = b"".join(ids)
            seen = np.bincount(np.frombuffer(data, box.kind))
            used = np.flatnonzero(seen)
            packed = (data, used.astype("<i4").tobytes(), seen[used].astype("<i4").tobytes())
            columns = ([part], [before], [doc_ids], [sizes], [held], [width], *([x] for x in packed))
            longs = pa.list_(pa.int64())
            kinds = (pa.int32(), pa.int64(), longs, longs, pa.int64(), pa.int32(), *[pa.binary()] * 3)
            names = [f.split()[0] for f in _CHUNK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for some in parts_of(batch, TOGETHER):
                found, counts = box.encode(some.column("text"), tail)
                at = first = 0
                for i, (doc, n) in enumerate(zip(some.column("doc_id").to_pylist(), counts.tolist())):
                    at += n
                    doc_ids.append(doc)
                    sizes.append(n)
                    held += n
                    if held >= block or i == len(counts) - 1:
                        ids.append(found[first:at].tobytes())
                        first = at
                    if held >= block:
                        yield row()
                        before += held
                        ids, doc_ids, sizes, held = [], [], [], 0
        if doc_ids:
            yield row()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of())
    tied = narrow.withColumn("tie", F.xxhash64("text"))
    order = ("doc_id", "tie")
    ordered = tied.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.select("doc_id", "text").mapInArrow(run, _CHUNK)


def _counts(chunks: DataFrame) -> DataFrame:
    """How often each id occurs, from the counts that each chunk has of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for used, counts in zip(batch.column("used"), batch.column("counts")):
                own = np.frombuffer(used.as_buffer(), "<i4")
                if len(own) and own[-1] >= len(total):
                    total = np.r_[total, np.zeros(own[-1] + 1 - len(total), np.int64)]
                total[own] += np.frombuffer(counts.as_buffer(), "<i4")
        found = np.flatnonzero(total)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    spread = chunks.select("used", "counts").mapInArrow(run, "id long, n long")
    return spread.groupBy("id").agg(F.sum("n").alias("n"))


_BLOCK = (
    "start long, doc_ids array<long>, sizes array<long>, n_tokens long, states binary, offsets array<long>, "
    "checks array<long>, payload binary"
)


def write(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 2, block: int = BLOCK
) -> None:
    """Encode whole texts (null: empty), append `end_id` to each, and write a store at `path`.

    Rows are put in ascending doc_id order: null ids first, ties by a hash of the text.  Rows
    that repeat a doc_id are documents of their own.  Other columns are not read.  An empty table
    gives a store without blocks.  The driver sees one number per partition and one count per id
    of the vocabulary.
    """
    with passing_tables(docs.sparkSession):
        chunks = _chunks(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), end_id, block)
        _write(stored(chunks, "chunks", "zstd"), path)


def _write(chunks: DataFrame, path: str) -> None:
    spark = chunks.sparkSession
    ends = chunks.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("n")).orderBy("part").collect()
    starts = dict(zip([r.part for r in ends], np.cumsum([0, *(r.n for r in ends)]).tolist()))
    counts = _counts(chunks).orderBy("id").collect()
    table = rans.fit([r.id for r in counts], [r.n for r in counts])
    columns = [(table.symbols.tolist(), table.freqs.tolist())]
    spark.createDataFrame(columns, "symbols array<long>, freqs array<long>").write.parquet(f"{path}/table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                width = batch.column("width")[i].as_py()
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), f"<u{width}").astype(np.int64)
                coded = rans.encode(ids, table)
                start = starts[batch.column("part")[i].as_py()] + batch.column("before")[i].as_py()
                copied = [batch.column(n).slice(i, 1) for n in ("doc_ids", "sizes", "n_tokens")]
                kinds = (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
                values = ([coded.states], [coded.offsets], [coded.checks], [coded.payload])
                arrays = [pa.array([start]), *copied, *(pa.array(v, k) for v, k in zip(values, kinds))]
                names = ["start", "doc_ids", "sizes", "n_tokens", "states", "offsets", "checks", "payload"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    body = chunks.drop("used", "counts")
    body.mapInArrow(run, _BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[dict, rans.Block]]:
    for row in batch.to_pylist():
        yield row, rans.Block(row["n_tokens"], row["payload"], row["states"], row["offsets"], row["checks"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document of a store; `start` counts the ids before it."""
    return _read(spark, path, "doc_id long, start long, ids array<int>", _ids)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a store."""
    return _read(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", _crcs)


def _ids(parts: list[np.ndarray]) -> list[pa.Array]:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int32)))]


def _crcs(parts: list[np.ndarray]) -> list[pa.Array]:
    sums = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
    return [pa.array([len(p) for p in parts], pa.int64()), pa.array(sums, pa.int64())]


def _read(spark: SparkSession, path: str, schema: str, columns) -> DataFrame:
    head = spark.read.parquet(f"{path}/table").first()
    table = rans.Table(np.array(head.symbols, np.int64), np.array(head.freqs, np.int64))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = rans.Decoder(table)
        for batch in batches:
            for row, block in _blocks(batch):
                ends = np.cumsum(row["sizes"])
                parts = np.split(decode(block), ends[:-1])
                starts = row["start"] + ends - np.array(row["sizes"])
                arrays = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts), *columns(parts)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, schema)

"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file is parsed (`piece_model`) and rebuilt as a tokenizer of the tokenizers library:
normaliser, blank mark, scores or merges, byte fallback.  Where no piece has a blank inside, the
words of a text are encoded apart and each distinct word once (`word_cache`).  Every distinct
word is also encoded by the SentencePiece library; where the two differ, the text keeps
SentencePiece's ids and is marked, so ids are right even then.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfkin.llm import piece_model
from shelfkin.llm.common import map_batches, parts_of, text_of
from shelfkin.llm.piece_model import SPACE
from shelfkin.llm.word_cache import WordCache

WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")


class Codec:
    """Encodes and decodes texts as the model file says; one for each Python worker."""

    def __init__(self, path: str, threads: int = 1) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")
        self.threads = threads
        self.model = piece_model.load(path)
        self.whole = piece_model.backend(self.model)
        self.normalised = piece_model.backend(self.model, normalise=False)
        self.normaliser = piece_model.normalizer(self.model)
        self.check = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cut = self.model.cuts_at_blanks() and self.model.plain()
        self.table = piece_model.byte_table(self.model)
        self.cache = WordCache(self._encode_words)

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words, each put after one mark; a first number tells whether both libraries agree."""
        texts = [SPACE + w for w in words]
        fast = getattr(self.normalised, "encode_batch_fast", self.normalised.encode_batch)
        ours = [e.ids for e in fast(texts, add_special_tokens=False)]
        theirs = self.check.encode([w.replace(SPACE, " ") for w in words], num_threads=self.threads)
        # SentencePiece has no ids for an empty text, which here is a lone mark at a text's end.
        return [[1, *a] if a == b or not w else [0, *b] for w, a, b in zip(words, ours, theirs)]

    def words(self, text: str) -> list[str]:
        """A text's words without their first mark; only for models that cut at blanks."""
        if not text:
            return []
        if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [w[1:] for w in WORDS.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of each text, and whether the two libraries agree on it."""
        if not self.cut:
            ours = [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]
            theirs = self.check.encode(texts, num_threads=self.threads)
            return [np.array(b, np.int32) for b in theirs], [a == b for a, b in zip(ours, theirs)]
        out, agree = [], []
        for text in texts:
            ids, sizes = self.cache(self.words(text))
            first = np.cumsum(sizes) - sizes
            agree.append(bool(ids[first].all()))
            out.append(np.delete(ids, first))
        return out, agree

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.table.__getitem__, ids.tolist())).decode(errors="replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str, threads: int) -> Codec:
    return Codec(path, threads)


def model_path(path: str | None) -> str:
    return path or public_tokenizers.path("piece_bpe_32k.model")


def id_arrays(ids: list[np.ndarray]) -> pa.Array:
    ends = np.r_[0, np.cumsum([len(x) for x in ids])]
    values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, model: str | None = None, threads: int = 1) -> DataFrame:
    """(doc_id, text, ids, agree) for every row of `docs`, whole texts; a null text counts as empty.

    `ids` are those of the SentencePiece library without special tokens; `agree` tells whether
    the tokenizers library gave the same.  An empty text has no ids.  Rows that repeat a doc_id
    or have none each get a row; other columns are not read; an empty table gives an empty result.
    `model` is a public model file known to all executors by that path.
    """
    path = model_path(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        box = codec(path, threads)
        for batch in batches:
            for part in parts_of(batch, 1 << 23):
                ids, agree = box.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, id_arrays(ids), pa.array(agree)], ["doc_id", "text", "ids", "agree"]
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of())
    return narrow.mapInArrow(run, "doc_id long, text string, ids array<int>, agree boolean")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, decoded) from (doc_id, ids)."""
    path = model_path(model)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        box = codec(path, 1)
        texts = [box.decode(np.array(i, np.int64)) for i in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "decoded"])

    return map_batches(encoded.select("doc_id", "ids"), rows, "doc_id long, decoded string")


def digest(docs: DataFrame, model: str | None = None, threads: int = 1) -> DataFrame:
    """Per document: number of ids, their crc32 (little-endian, 32 bits each), whether the two
    libraries agree, and whether decoding gives the text back."""
    path = model_path(model)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        box = codec(path, threads)
        column, texts = batch.column("ids"), batch.column("text").to_pylist()
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(pc.list_value_length(column))
        parts = np.split(flat, ends[:-1])
        arrays = [
            batch.column("doc_id"),
            pa.array([len(p) for p in parts], pa.int64()),
            pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()),
            batch.column("agree"),
            pa.array([box.decode(p) == t for p, t in zip(parts, texts)]),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_crc32", "agree", "restored"])

    return map_batches(
        encode(docs, model, threads), rows, "doc_id long, n_tokens long, ids_crc32 long, agree boolean, restored boolean"
    )

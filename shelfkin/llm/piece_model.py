"""A SentencePiece model file read without its library: pieces, scores and how text is normalised."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from tokenizers import Regex, Tokenizer, decoders, models, normalizers

SPACE = "▁"  # stands for a blank inside pieces

# Field numbers and enumerations of the public model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, SCORE, TYPE = 1, 2, 3
MODEL_TYPE, BYTE_FALLBACK, UNK_ID = 3, 35, 40
CHARSMAP, DUMMY_PREFIX, REMOVE_EXTRA, ESCAPE = 2, 3, 4, 5
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: whole numbers, or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceModel(NamedTuple):
    pieces: list[tuple[str, float, int]]  # text, score, type
    kind: int
    byte_fallback: bool
    unk_id: int
    charsmap: bytes
    dummy_prefix: bool
    remove_extra: bool
    escape: bool

    def plain(self) -> bool:
        """Whether text is taken as it is, but for the mark of blanks and the leading one."""
        return not self.charsmap and not self.remove_extra and self.escape and self.dummy_prefix

    def cuts_at_blanks(self) -> bool:
        """Whether no piece has a blank after another character: then words can be encoded apart."""
        matched = (t for t, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))
        return all(SPACE not in t.lstrip(SPACE) for t in matched)

    def user_defined(self) -> list[str]:
        return [t for t, _, kind in self.pieces if kind == USER_DEFINED]


def parse(data: bytes) -> PieceModel:
    pieces: list[tuple[str, float, int]] = []
    trainer: dict[int, int | bytes] = {}
    normal: dict[int, int | bytes] = {}
    for number, value in fields(data):
        if number == PIECES:
            piece = dict(fields(value))
            score = struct.unpack("<f", piece[SCORE])[0] if SCORE in piece else 0.0
            pieces.append((piece.get(PIECE, b"").decode(), score, piece.get(TYPE, NORMAL)))
        elif number == TRAINER:
            trainer = dict(fields(value))
        elif number == NORMALIZER:
            normal = dict(fields(value))
    return PieceModel(
        pieces,
        trainer.get(MODEL_TYPE, UNIGRAM),
        bool(trainer.get(BYTE_FALLBACK, 0)),
        trainer.get(UNK_ID, 0),
        normal.get(CHARSMAP, b""),
        bool(normal.get(DUMMY_PREFIX, 1)),
        bool(normal.get(REMOVE_EXTRA, 1)),
        bool(normal.get(ESCAPE, 1)),
    )


@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    with open(path, "rb") as file:
        return parse(file.read())


def normalizer(model: PieceModel) -> normalizers.Normalizer:
    """The model's normalisation as the tokenizers library does it."""
    steps: list[normalizers.Normalizer] = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", SPACE))
    return normalizers.Sequence(steps)


def _merges(model: PieceModel) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, best-scored pieces first."""
    known = {t for t, _, kind in model.pieces if kind == NORMAL}
    ways = []
    for order, (text, score, kind) in enumerate(model.pieces):
        if kind == NORMAL:
            halves = ((text[:i], text[i:]) for i in range(1, len(text)))
            ways += [(-score, order, a, b) for a, b in halves if a in known and b in known]
    ways.sort(key=lambda w: w[:2])
    return [(a, b) for _, _, a, b in ways]


def unigram(model: PieceModel) -> models.Unigram:
    """The pieces and scores as a unigram model, whatever the file was trained as."""
    vocabulary = [(t, score) for t, score, _ in model.pieces]
    return models.Unigram(vocabulary, unk_id=model.unk_id, byte_fallback=model.byte_fallback)


def backend(model: PieceModel, normalise: bool = True) -> Tokenizer:
    """A tokenizer of the tokenizers library for the model.

    Without `normalise` it takes text that is normalised already.
    """
    if model.kind == BPE:
        vocabulary = {t: i for i, (t, _, _) in enumerate(model.pieces)}
        unknown = model.pieces[model.unk_id][0]
        core = models.BPE(
            vocabulary, _merges(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback
        )
    elif model.kind == UNIGRAM:
        core = unigram(model)
    else:
        raise ValueError("only unigram and BPE models are read")
    tokenizer = Tokenizer(core)
    if normalise:
        tokenizer.normalizer = normalizer(model)
    steps = [decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        steps.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(steps)
    return tokenizer


def byte_table(model: PieceModel) -> list[bytes]:
    """What each id decodes to, as bytes."""
    table = []
    for text, _, kind in model.pieces:
        if kind == BYTE:
            table.append(bytes([int(text[3:5], 16)]))
        elif kind == CONTROL:
            table.append(b"")
        elif kind == UNKNOWN:
            table.append(" ⁇ ".encode())
        else:
            table.append(text.replace(SPACE, " ").encode())
    return table

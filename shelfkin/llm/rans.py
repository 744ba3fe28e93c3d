"""Static range asymmetric numeral coding of whole numbers, many lanes at a time.

One frequency table, scaled to 2 ** SCALE_BITS, serves all blocks.  Lane i of a block codes the
symbols i, i + LANES, i + 2 * LANES, ...; all lanes share one stream of 32-bit words.  A lane's
state is a 64-bit number of at least 2 ** 31.  Every CHECKPOINT steps (rows of LANES symbols) the
states and the place in the stream are kept, so that decoding can start there; each such segment
has its own checksum.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

SCALE_BITS = 18
LANES = 1024
CHECKPOINT = 512
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
SCALE = np.uint64(SCALE_BITS)
MASK = np.uint64((1 << SCALE_BITS) - 1)


class Table(NamedTuple):
    """Symbols that occur, ascending and not negative; their frequencies sum to 2 ** SCALE_BITS."""

    symbols: np.ndarray
    freqs: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.freqs) - self.freqs

    def places(self, values: np.ndarray) -> np.ndarray:
        """Where each value stands among the symbols."""
        top = int(self.symbols[-1]) if len(self.symbols) else -1
        if len(values) and (values.min() < 0 or values.max() > top):
            raise ValueError("a value is not in the table")
        place = np.full(top + 1, -1)
        place[self.symbols] = np.arange(len(self.symbols))
        at = place[values]
        if (at < 0).any():
            raise ValueError("a value is not in the table")
        return at


def fit(symbols: Sequence[int], counts: Sequence[int]) -> Table:
    """Frequencies in proportion to the counts, at least one each."""
    order = np.argsort(np.asarray(symbols, np.int64), kind="stable")
    symbols, counts = np.asarray(symbols, np.int64)[order], np.asarray(counts, np.float64)[order]
    if len(symbols) > 1 << SCALE_BITS:
        raise ValueError(f"more than {1 << SCALE_BITS} different symbols")
    if not len(symbols):
        return Table(symbols, symbols)
    room = (1 << SCALE_BITS) - len(symbols)
    shares = counts / counts.sum() * room
    freqs = np.floor(shares).astype(np.int64)
    rest = room - int(freqs.sum())
    freqs[np.argsort(freqs - shares, kind="stable")[:rest]] += 1
    return Table(symbols, freqs + 1)


class Block(NamedTuple):
    size: int
    payload: bytes  # 32-bit words
    states: bytes  # LANES 64-bit states for each segment
    offsets: list[int]  # the first word of each segment
    checks: list[int]  # crc32 of the words of each segment


def encode(values: np.ndarray, table: Table) -> Block:
    """Code `values`, all of which must be in the table."""
    at = table.places(values)
    steps = -(-len(values) // LANES)
    padded = np.full(steps * LANES, int(np.argmax(table.freqs)) if len(table.freqs) else 0, np.int64)
    padded[: len(values)] = at
    rows = padded.reshape(steps, LANES)
    freqs, starts = table.freqs.astype(np.uint64), table.starts.astype(np.uint64)
    limits = freqs << np.uint64(63 - SCALE_BITS)
    state = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    states: list[np.ndarray] = []
    marks: list[int] = []
    done = 0
    for step in range(steps - 1, -1, -1):
        symbol = rows[step]
        freq = freqs[symbol]
        full = np.flatnonzero(state >= limits[symbol])
        out = state[full].astype(np.uint32)
        state[full] >>= WORD
        words.append(out)
        done += len(out)
        quotient = state // freq
        state = (quotient << SCALE) + (state - quotient * freq) + starts[symbol]
        if step % CHECKPOINT == 0:
            states.append(state.copy())
            marks.append(done)
    stream = np.concatenate(words[::-1]).astype("<u4") if words else np.zeros(0, "<u4")
    offsets = [done - m for m in reversed(marks)]
    ends = [*offsets[1:], done]
    checks = [zlib.crc32(stream[a:b].tobytes()) for a, b in zip(offsets, ends)]
    kept = np.concatenate(states[::-1]).astype("<u8").tobytes() if states else b""
    return Block(len(values), stream.tobytes(), kept, offsets, checks)


class Decoder:
    """Decodes blocks of one table."""

    def __init__(self, table: Table) -> None:
        self.symbols = table.symbols
        self.slots = np.repeat(np.arange(len(table.freqs)), table.freqs)
        self.freqs, self.starts = table.freqs.astype(np.uint64), table.starts.astype(np.uint64)

    def segment(self, block: Block, index: int) -> np.ndarray:
        """The values of one segment, from its checkpoint alone."""
        steps = -(-block.size // LANES)
        first, last = index * CHECKPOINT, min(steps, (index + 1) * CHECKPOINT)
        end = block.offsets[index + 1] if index + 1 < len(block.offsets) else len(block.payload) // 4
        stream = np.frombuffer(block.payload, "<u4")[block.offsets[index] : end]
        if zlib.crc32(stream.tobytes()) != block.checks[index]:
            raise ValueError(f"segment {index} of a block is damaged")
        state = np.frombuffer(block.states, "<u8")[index * LANES : (index + 1) * LANES].astype(np.uint64)
        out = np.empty((last - first, LANES), np.int64)
        at = 0
        for row in out:
            slot = state & MASK
            symbol = self.slots[slot.astype(np.int64)]
            row[:] = symbol
            state = self.freqs[symbol] * (state >> SCALE) + slot - self.starts[symbol]
            low = np.flatnonzero(state < LOW)
            state[low] = (state[low] << WORD) | stream[at : at + len(low)]
            at += len(low)
        return self.symbols[out.ravel()[: block.size - first * LANES]]

    def __call__(self, block: Block) -> np.ndarray:
        parts = [self.segment(block, i) for i in range(len(block.offsets))]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

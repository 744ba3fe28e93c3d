"""Numbers of tokens under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton lists all vocabulary matches that end at each character; dynamic
programming carries the best score and, with it, the number of tokens.  The rules are those of
the tokenizers library's unigram model: scores are added from the left in doubles, a better score
must be strictly better, so that of equal ones the longest last piece wins; a character that is
no piece costs ten less than the worst score; unknown characters in a row are one token, or with
byte fallback as many as their bytes.

Where no piece has a blank after another character and all scores are whole numbers (so that sums
are exact in any order), the best path of a text is that of its words, and each distinct word is
scored once.  Otherwise the whole text is scored.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfkin.llm import piece_model
from shelfkin.llm.common import map_batches, text_of
from shelfkin.llm.piece_model import SPACE
from shelfkin.llm.sentencepiece_codec import WORDS, model_path
from shelfkin.llm.word_cache import LIMIT

UNKNOWN_PENALTY = 10.0  # fixed value of the tokenizers library


class Counter:
    """Counts tokens of texts; one for each Python worker."""

    def __init__(self, model: piece_model.PieceModel, limit: int = LIMIT) -> None:
        self.model, self.limit = model, limit
        self.normaliser = piece_model.normalizer(model)
        self.automaton = ahocorasick.Automaton()
        for i, (text, score, _) in enumerate(model.pieces):
            if text:  # of equal pieces the last counts, as in a dictionary
                self.automaton.add_word(text, (len(text), score, i == model.unk_id))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s, _ in model.pieces) - UNKNOWN_PENALTY
        names = {t for t, _, _ in model.pieces}
        self.bytes = model.byte_fallback and all(f"<0x{b:02X}>" in names for b in range(256))
        whole = all(s == int(s) for _, s, _ in model.pieces)
        self.cut = whole and model.plain() and model.cuts_at_blanks()
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        """Tokens of a normalised text."""
        n = len(text)
        if not n:
            return 0
        at: list[list[tuple[int, float, bool]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            at[end].append(match)
        best = [0.0] * (n + 1)
        count = [0] * (n + 1)  # tokens before the run of unknown ones that ends here
        run: list[tuple[int, bool]] = [(0, False)] * (n + 1)  # its bytes, and whether it is one unknown piece
        for end in range(1, n + 1):
            start, score, lost, single = -1, 0.0, False, True
            for length, value, is_unknown in at[end - 1]:  # longest first
                candidate = best[end - length] + value
                if start < 0 or candidate > score:
                    start, score, lost = end - length, candidate, is_unknown
                single = single and length != 1
            if single and (start < 0 or best[end - 1] + self.unknown > score):
                start, score, lost = end - 1, best[end - 1] + self.unknown, True
            best[end] = score
            if lost:
                size, _ = run[start]
                count[end] = count[start]
                run[end] = (size + len(text[start:end].encode()), not size and end - start > 1)
            else:
                count[end] = count[start] + self._run(run[start]) + 1
        return count[n] + self._run(run[n])

    def _run(self, run: tuple[int, bool]) -> int:
        size, piece = run
        return 0 if not size else size if self.bytes and not piece else 1

    def __call__(self, text: str) -> int:
        """Tokens of a text as it is."""
        if not text:
            return 0
        if not self.cut:
            return self.count(self.normaliser.normalize_str(text))
        if SPACE not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            words = text.split(" ")
        else:
            words = [w[1:] for w in WORDS.findall(SPACE + text.replace(" ", SPACE))]
        known = self.known
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for word in words:
                if word not in known:
                    known[word] = self.count(SPACE + word)
            return sum(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(piece_model.load(path))


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) for every row of `docs`, whole texts; a null or empty text has none.

    Rows that repeat a doc_id or have none each get a row; other columns are not read; an empty
    table gives an empty result.  `model` is a public model file known to all executors by that
    path, whose pieces and scores are taken as a unigram vocabulary.
    """
    path = model_path(model)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        count = counter(path)
        totals = np.fromiter(map(count, batch.column("text").to_pylist()), np.int64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(totals)], ["doc_id", "n_tokens"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of())
    return map_batches(narrow, rows, "doc_id long, n_tokens long")

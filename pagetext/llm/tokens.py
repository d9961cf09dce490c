"""Token counts: count-only Viterbi over a unigram vocabulary.

The vocabulary is that of a public tokenizer file (its path is a parameter);
nothing is trained. Piece scores are log probabilities by Zipf's law of the
piece's rank in the file, rounded to multiples of 2^-20: sums of them are exact
in doubles, so a text can be cut where no piece can span (before each word
mark that follows another character, and around characters of no piece) and the
parts counted on their own, whatever the order of additions.

Per part an Aho-Corasick automaton enumerates the pieces that end at each
place; the dynamic programme carries best score and piece count. Rules as in
the unigram model of the public ``tokenizers`` library: a blank becomes the
word mark, one is put in front of the text, of equally good paths the one whose last
piece starts earliest wins, a character that is no piece costs the lowest score
less 10 and counts one token per UTF-8 byte (byte fallback).

Counting is per document and narrow: one scan, no shuffle. Workers keep the
counts of parts seen, at most ``MEMORY`` of at most ``MEMORY_PART`` characters. A null or empty text has no
tokens. Equal rows get equal counts. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packed import chunks

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
MEMORY = 1 << 19
MEMORY_PART = 64      # characters; longer parts (scripts without blanks) hardly come again
PART = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


@lru_cache(maxsize=2)
def vocabulary(path: str = VOCABULARY) -> tuple[tuple[str, float], ...]:
    """(piece, score) of the ordinary pieces, in file order."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return tuple((p, round(-math.log(rank + 2.0) * 2 ** 20) / 2 ** 20) for rank, p in enumerate(pieces))


class Counter(dict):
    """Token counts by part of a text; a part is computed when first asked for."""

    def __init__(self, pieces: tuple[tuple[str, float], ...]):
        import ahocorasick
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        # cutting before a word mark and around line ends is exact only if no piece spans such a place
        if any(MARK in p.lstrip(MARK) or "\n" in p for p, _ in pieces):
            raise ValueError("a piece spans a cut between parts")

    def viterbi(self, part: str) -> tuple[int, float]:
        """(tokens, score) of the best path."""
        n = len(part)
        best, count = [0.0] + [None] * n, [0] * (n + 1)
        ends: dict[int, list[tuple[int, float]]] = {}
        for end, (length, score) in self.automaton.iter(part):
            ends.setdefault(end + 1, []).append((end + 1 - length, score))
        for end in range(1, n + 1):
            found = sorted(ends.get(end, ()))
            if not found or found[-1][0] != end - 1:
                found.append((end - 1, None))
            top = None
            for start, score in found:
                total = best[start] + (self.unknown if score is None else score)
                if top is None or total > top:      # a tie keeps the earlier start
                    top = total
                    count[end] = count[start] + (len(part[start].encode()) if score is None else 1)
            best[end] = top
        return count[n], best[n]

    def __missing__(self, part: str) -> int:
        if len(part) > MEMORY_PART:
            return self.viterbi(part)[0]
        if len(self) >= MEMORY:
            self.clear()
        n = self[part] = self.viterbi(part)[0]
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        return sum(map(self.__getitem__, PART.findall(text)))


@lru_cache(maxsize=2)
def counter(path: str = VOCABULARY) -> Counter:
    """One automaton per worker process and vocabulary."""
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_chars, n_bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for b in chunks(batches, "text"):
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.array([count(t) for t in texts], np.int64)),
                 pa.array(np.array([len(t) for t in texts], np.int64)),
                 pa.array(np.array([len(t.encode()) for t in texts], np.int64))],
                names=["doc_id", "n_tokens", "n_chars", "n_bytes"])
    ids = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    return ids.mapInArrow(run, "doc_id long, n_tokens long, n_chars long, n_bytes long")

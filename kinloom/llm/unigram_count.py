"""Token counts without tokens: Viterbi over unigram pieces that an Aho-Corasick automaton finds.

The tokenizer is a unigram model over a public vocabulary of scored pieces, applied to words: blanks become the mark ``▁``,
one more is put in front, and each mark begins a word. The best segmentation's score and number of pieces are carried along; the
segmentation itself is never built. Ties follow the exact tokenizer: of equal scores that end at one place, the
piece that begins first stays. A character that no single-character piece covers costs the lowest score less 10; it counts as its UTF-8
bytes if the vocabulary has all byte pieces, else neighbouring ones count as one unknown piece.

Counts of words are kept (a bounded table per worker), so frequent words are segmented once. A newline or other character that
occurs in no piece splits a word into parts that are kept on their own.

Edge cases: null and empty texts have no tokens and score 0; a text that begins with a blank gets no further mark in
front; equal texts have equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import Shared
from kinloom.shipping import ship

MARK = "▁"
PENALTY = 10.0
_loaded: dict[str, Counter] = {}


class Counter:
    """Counts pieces of words for a vocabulary of (piece, score)."""

    def __init__(self, vocabulary: list[tuple[str, float]], keep: int = 500_000):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        singles, letters = set(), set()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
                letters.update(piece)
                if len(piece) == 1:
                    singles.add(piece)
        self.automaton.make_automaton()
        self.singles = singles
        self.unknown = min((s for _, s in vocabulary), default=0.0) - PENALTY
        names = {p for p, _ in vocabulary}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.other = re.compile(f"([^{''.join(map(re.escape, sorted(letters)))}]+)") if letters and self.bytes else None
        self.keep, self.known = keep, {}

    def best(self, word: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation."""
        n, unknown, singles = len(word), self.unknown, self.singles
        if singles.issuperset(word):  # no unknown character; matches come by end, the earliest beginning first
            totals, counts = [0.0] + [-math.inf] * n, [0] * (n + 1)
            for e, (size, s) in self.automaton.iter(word):
                at = e + 1 - size
                if (v := totals[at] + s) > totals[e + 1]:
                    totals[e + 1], counts[e + 1] = v, counts[at] + 1
            return counts[n], totals[n]
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        loose = [False] * (n + 1)  # whether the path to here ends in an unknown character
        ends: list[list] = [[] for _ in range(n + 1)]
        for e, piece in self.automaton.iter(word):
            ends[e + 1].append(piece)
        for e in range(1, n + 1):
            top = None
            for size, s in sorted(ends[e], reverse=True):
                before = score[e - size] + s
                if top is None or before > top:
                    top, at, new = before, e - size, False
            if word[e - 1] not in singles:
                before = score[e - 1] + unknown
                if top is None or before > top:
                    top, at, new = before, e - 1, True
            score[e], loose[e] = top, new
            if not new:
                count[e] = count[at] + 1
            elif self.bytes:
                count[e] = count[at] + len(word[at].encode("utf-8", "surrogatepass"))
            else:
                count[e] = count[at] + (not loose[at])
        return count[n], score[n]

    def of_word(self, word: str) -> tuple[int, float]:
        if (got := self.known.get(word)) is None:
            if self.other is not None and len(word) > 1 and self.other.search(word):
                got = 0, 0.0
                for part in self.other.split(word):
                    if part:
                        c, s = self.best(part) if self.other.match(part) else self.of_word(part)
                        got = got[0] + c, got[1] + s
            else:
                got = self.best(word)
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[word] = got
        return got

    def of_text(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(MARK, " ")
        words = text.replace(" ", " " + MARK).split(" ")
        words = words[1:] if not words[0] else [MARK + words[0], *words[1:]]
        known, of_word, count, score = self.known, self.of_word, 0, 0.0
        for w in words:
            c, s = known.get(w) or of_word(w)
            count += c
            score += s
        return count, score


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


def counter(pieces) -> Counter:
    """The counter of a broadcast vocabulary, once per process."""
    if pieces.id not in _loaded:
        _loaded[pieces.id] = Counter(pieces.value)
    return _loaded[pieces.id]


def count(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens, score`` for every document."""
    spark = docs.sparkSession
    ship(spark)
    pieces = Shared(spark, vocabulary(model_path))  # the file need not be where workers run

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(pieces)
        for b in batches:
            got = [c.of_text(t) for t in b.text]
            out = pd.DataFrame({"doc_id": b.doc_id.astype("Int64"), "n_tokens": [x[0] for x in got], "score": [x[1] for x in got]})
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_tokens long, score double")

"""Token counts by count-only Viterbi under a unigram vocabulary.

The vocabulary is the piece list of a sentencepiece file with its scores. White space is written as the mark U+2581.
An Aho-Corasick automaton enumerates every vocabulary match of a segment; dynamic programming over the end positions
carries the best score and its number of pieces, nothing else. Ties go as in the public tokenizers library: of equal
scores the candidate that starts first wins. A character without a piece of its own costs the lowest score less 10, and
counts as many pieces as it has UTF-8 bytes (byte fallback).

No piece holds the mark behind another character, so a text falls into segments (marks, then other characters) that
every path respects; scores are whole numbers, so cutting there changes no tie. Segments repeat, so the counts of those up to
LONG characters are kept in a table of bounded size. A segment is never cut: in one that is longer (a text without blanks) only
the last ends that a piece can reach back to are held, in a ring, so that no text is too long.

Edge cases: null or empty text has 0 tokens. Repeated rows are each answered.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_pieces, shipped, texts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Segments whose counts a worker keeps, and their length at most.
KEPT, LONG = 1_500_000, 64


@lru_cache(maxsize=2)
def vocabulary(file: bytes) -> tuple[tuple[str, float], ...]:
    """(piece, score) by id, of a sentencepiece file's bytes."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=file)
    return tuple((sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()))


class Counter(dict):
    """Segment -> number of pieces, filled on demand."""

    def __init__(self, file: bytes):
        import ahocorasick

        super().__init__()
        pieces = vocabulary(file)
        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece holds the mark behind another character; texts can't be cut into segments")
        if any(s != int(s) for _, s in pieces):
            raise ValueError("scores must be whole numbers, so that sums are exact")
        self.unknown = min(s for _, s in pieces) - 10
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.inside = {c for p, _ in pieces for c in p}
        self.least = float("-inf")
        self.ring = 1 + max((len(p) for p, _ in pieces), default=1)
        line = "" if "\n" in self.inside else "\n"  # a line end that no piece holds parts segments too
        self.segments = re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+" + ("|\n+" if line else ""))
        self.parts = re.compile(f"[{re.escape(''.join(sorted(self.inside)))}]+|.", re.DOTALL)

    def __missing__(self, segment: str) -> int:
        n = self.viterbi(segment) if self.single.issuperset(segment) else sum(self.part(m[0]) for m in self.parts.finditer(segment))
        if len(segment) <= LONG:
            if len(self) >= KEPT:
                self.clear()
            self[segment] = n
        return n

    def part(self, s: str) -> int:
        """A character that no piece holds parts every path: it counts its bytes. What stands between has pieces."""
        return len(s.encode("utf-8", "surrogatepass")) if len(s) == 1 and s not in self.inside else self.viterbi(s)

    def viterbi(self, s: str) -> int:
        """Best score and count by end. The automaton gives the matches of an end from the longest on: the first start wins ties."""
        if len(s) > LONG or not self.single.issuperset(s):
            return self.viterbi_in_ring(s)
        best = [0.0] + [self.least] * len(s)
        count = [0] * len(best)
        for end, (n, score) in self.automaton.iter(s):
            v = best[end + 1 - n] + score
            if v > best[end + 1]:
                best[end + 1] = v
                count[end + 1] = count[end + 1 - n] + 1
        return count[-1]

    def viterbi_in_ring(self, s: str) -> int:
        """The same over a ring of ends, and with characters that have no piece of their own."""
        size = self.ring
        best, count = [self.least] * size, [0] * size
        best[0] = 0.0
        matches = self.automaton.iter(s)
        at, match = next(matches, (len(s), None))
        for end, c in enumerate(s):
            top, pieces = self.least, 0
            while at == end and match:
                n, score = match
                k = (end + 1 - n) % size
                if best[k] + score > top:
                    top, pieces = best[k] + score, count[k] + 1
                at, match = next(matches, (len(s), None))
            if c not in self.single and best[end % size] + self.unknown > top:
                top, pieces = best[end % size] + self.unknown, count[end % size] + len(c.encode("utf-8", "surrogatepass"))
            best[(end + 1) % size], count[(end + 1) % size] = top, pieces
        return count[len(s) % size]

    def total(self, text: str) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        return sum(map(self.__getitem__, self.segments.findall(text))) if len(text) < 1 << 20 else sum(self[m[0]] for m in self.segments.finditer(text))


@lru_cache(maxsize=1)
def shared(file: bytes) -> Counter:
    """One table a worker process, so that its tasks share it."""
    return Counter(file)


def count(docs: DataFrame, vocabulary_path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars_counted (code points) and n_tokens of every whole text."""
    file = shipped(docs.sparkSession, vocabulary_path)

    def make():
        counter = shared(file.value)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ts = batch.column("text").to_pylist()
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in ts], pa.int64()), pa.array([counter.total(t) for t in ts], pa.int64())], ["doc_id", "n_chars_counted", "n_tokens"])

        return one

    return map_pieces(texts(docs, id_col=id_col, text_col=text_col), make, f"doc_id {dict(docs.dtypes)[id_col]}, n_chars_counted long, n_tokens long")

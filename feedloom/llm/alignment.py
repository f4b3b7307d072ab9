"""Alignment of two tokenizers: a label a byte, spans up to each common end, and links between tokens that end together.

Tokenizer A is byte-level BPE over a space and the text, B a sentencepiece model over the text, to which it adds the space itself. Every
byte of the joined tokens gets a label: none, A ends here, B ends here, or both. A regular expression scans the labels and extracts the
spans up to each label "both"; how many A-ends and B-ends a span holds gives its token group. As no token is empty, a common
end has one token of either, which are linked. How often an id pair is linked in the corpus is counted over all documents, and
each document's links are then held against the counts.

No token of either vocabulary goes on behind a single space between two other characters (B's pieces hold no mark behind another character, which
is checked; A's pieces are words with the space before). A text thus falls into segments that begin at such spaces, at each of
which both tokenizers begin anew, so the labels of a text are those of its segments laid end to end. Segments repeat: each different one
is labelled once and what came of it is kept: up to KEPT segments of LONG characters at most, and as many again that were met before these, so that
frequent ones stay. A text without such spaces is one segment.

A text whose joined bytes of A or B are not its own (characters that a tokenizer rewrites) has no tokens. Segments with such bytes are tried
again as one text, so that the text alone decides.

The pairs' counts are sent to all tasks up to BROADCAST_ROWS pairs; beyond that Spark shuffles documents' pairs and counts by pair.
Vocabulary files are broadcast (64 MB at most).

Edge cases: null and empty texts have no tokens: zeros and an empty digest. Strings of special tokens are plain text. doc_ids may be of
any type, null or repeated: rows are told apart by their place. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, fresh, map_pieces, numbered, shipped, stored
from .token_count import MARK, vocabulary

VOCABULARY_A, VOCABULARY_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: A pair of ids is one long: A's id times PAIR plus B's.
PAIR = 1 << 31
#: Segments kept by a worker, and their length at most; segments given to the tokenizers at once, and their bytes.
KEPT, LONG, AT_ONCE, BYTES = 250_000, 256, 4096, 1 << 20
#: A single space between two characters of which neither is white space, in any tokenizer's sense, nor without width.
BETWEEN = r"[^\s\x00-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u2581\u3000\ufeff]"
CUT = re.compile(f"(?<={BETWEEN}) (?={BETWEEN})")
#: Labels of a byte, and a span up to a common end.
A_END, B_END, BOTH = 1, 2, 3
SPAN = re.compile(rb"[\x00-\x02]*\x03")


def byte_of() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself, or for the others, in order, the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, file_a: bytes, file_b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_buffer(file_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        to_byte = byte_of()
        in_bytes = lambda s: bytes(to_byte[c] for c in s) if all(c in to_byte for c in s) else s.encode()
        self.bytes_a = {i: in_bytes(s) for s, i in self.a.get_vocab(with_added_tokens=True).items()}
        pieces = [p for p, _ in vocabulary(file_b)]
        self.bytes_b = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds the mark behind another character; texts can't be cut into segments")

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        a = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        return list(zip([e.ids for e in a], self.b.encode(texts, num_threads=1), strict=True))


def labels(ends_a: np.ndarray, ends_b: np.ndarray, size: int) -> bytes:
    """One label a byte. ends: how many bytes the tokens up to each have."""
    out = np.zeros(size, np.uint8)
    out[ends_a - 1] |= A_END
    out[ends_b - 1] |= B_END
    return out.tobytes()


def groups_of(label: bytes) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of A, and of B, each span up to a common end holds."""
    spans = SPAN.findall(label)
    return tuple(1 + np.fromiter(map(bytes.count, spans, itertools.repeat(end)), np.int64, len(spans)) for end in (A_END, B_END))


#: What came of a segment: its tokens of A and of B, its groups as written, and its linked pairs in order, as the bytes of longs.
Aligned = tuple[int, int, str, bytes]


class Aligner:
    """Segment -> Aligned, or None if a tokenizer changes its bytes; filled for many segments at once."""

    def __init__(self, file_a: bytes, file_b: bytes):
        self.tokenizers, self.known, self.older = Tokenizers(file_a, file_b), {}, {}
        #: Decimal ids with what follows them: inside a group, and at the end of a group's tokens of A, of B, and of the last group.
        self.inside, self.end_a, self.end_b, self.last = (np.array([f"{i}{c}" for i in range(1 + max(*self.tokenizers.bytes_a, *self.tokenizers.bytes_b))], object) for c in (",", "|", ";", "\n"))

    def written(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, last: np.ndarray) -> list[str]:
        """The groups of each segment as text. in_a, in_b: tokens by group; last: each segment's last group."""
        ends_a, ends_b = np.cumsum(in_a), np.cumsum(in_b)
        out = np.empty(len(a) + len(b), object)
        at_a = np.arange(len(a)) + np.repeat(ends_b - in_b, in_a)
        at_b = np.arange(len(b)) + np.repeat(ends_a, in_b)
        out[at_a], out[at_b] = self.inside[a], self.inside[b]
        out[at_a[ends_a - 1]], out[at_b[ends_b - 1]] = self.end_a[a[ends_a - 1]], self.end_b[b[ends_b - 1]]
        out[at_b[ends_b[last] - 1]] = self.last[b[ends_b[last] - 1]]
        return "".join(out.tolist()).split("\n")[:-1]

    def align(self, texts: list[str]) -> list[Aligned | None]:
        """Texts by the labels of their bytes, all in one string: every text ends with a common end."""
        ta, tb = self.tokenizers.bytes_a.__getitem__, self.tokenizers.bytes_b.__getitem__
        encoded = self.tokenizers.encode(texts)
        good, kept, one, two = [], [], [], []
        for t, (a, b) in zip(texts, encoded, strict=True):
            raw_a, raw_b, own = list(map(ta, a)), list(map(tb, b)), b" " + t.encode("utf-8", "surrogatepass")
            good.append(b"".join(raw_a) == own == b"".join(raw_b))
            if good[-1]:
                kept.append((a, b))
                one += raw_a
                two += raw_b
        if not kept:
            return [None] * len(texts)
        ends_a, ends_b = (np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))) for raw in (one, two))
        in_a, in_b = groups_of(labels(ends_a, ends_b, int(ends_a[-1])))
        a, b = (np.fromiter(itertools.chain.from_iterable(x), np.int64) for x in zip(*kept, strict=True))
        n_a, n_b = ([len(x) for x in side] for side in zip(*kept, strict=True))
        last = np.searchsorted(np.cumsum(in_a), np.cumsum(n_a))
        pairs = (a[np.cumsum(in_a) - 1] * PAIR + b[np.cumsum(in_b) - 1]).tobytes()
        cuts = [0, *(8 * (last + 1)).tolist()]
        done = zip(n_a, n_b, self.written(a, b, in_a, in_b, last), [pairs[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], strict=True)
        return [next(done) if ok else None for ok in good]

    def learn(self, segments: list[str]) -> None:
        """Segments that are not known yet, in parts of bounded size."""
        wanted = dict.fromkeys(segments)
        if len(self.known) + len(wanted) > KEPT:
            self.known, self.older = {}, self.known
        new = []
        for s in wanted:
            if s not in self.known:
                if s in self.older:
                    self.known[s] = self.older[s]
                else:
                    new.append(s)
        begin = size = 0
        for i, s in enumerate([*new, None]):
            if s is None or i - begin >= AT_ONCE or size > BYTES:
                if i > begin:
                    self.known.update(zip(new[begin:i], self.align(new[begin:i]), strict=True))
                begin, size = i, 0
            size += len(s or "")

    def texts(self, texts: list[str]) -> list[list[Aligned] | None]:
        """The segments of each text, aligned; None for texts without tokens."""
        cut = [CUT.split(t) if t else [] for t in texts]
        self.learn(list(itertools.chain.from_iterable(cut)))
        out = []
        for t, segments in zip(texts, cut, strict=True):
            found = list(map(self.known.__getitem__, segments))
            if None in found and len(found) > 1:
                found = self.align([t])
            out.append(None if None in found or not found else found)
        for s in {s for segments in cut for s in segments if len(s) > LONG}:
            del self.known[s]
        return out


@lru_cache(maxsize=1)
def shared(file_a: bytes, file_b: bytes) -> Aligner:
    """One a worker process, so that its tasks share what is known."""
    return Aligner(file_a, file_b)


def aligned(docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the different linked pairs with how often the document has them. docs: row, doc_id, text."""
    file_a, file_b = shipped(docs.sparkSession, path_a), shipped(docs.sparkSession, path_b)

    def make():
        aligner = shared(file_a.value, file_b.value)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: dict[str, list] = {c: [] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")}
            for found in aligner.texts(batch.column("text").to_pylist()):
                if found is None:
                    row = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
                else:
                    n_a, n_b, written, linked = zip(*found, strict=True)
                    pairs = np.frombuffer(b"".join(linked), np.int64)  # one for each group: no token is empty
                    row = (sum(n_a), sum(n_b), len(pairs), len(pairs), hashlib.sha256(";".join(written).encode()).hexdigest(), *np.unique(pairs, return_counts=True))
                for c, v in zip(cols.values(), row, strict=True):
                    c.append(v)
            ends = pa.array(np.cumsum([0, *map(len, cols["pairs"])]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(cols[c]).astype(np.int64))) for c in ("pairs", "times")]
            return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *(pa.array(cols[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(cols["groups_sha256"], pa.string()), *lists], ["row", "doc_id", *cols])

        return one

    kind = dict(docs.dtypes)["doc_id"]
    return map_pieces(docs, make, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<bigint>, times array<bigint>", 1 << 20)


def pair_counts(found: DataFrame) -> DataFrame:
    """pair, n (links of the whole corpus), and best: no other A id is linked to the B id more often."""
    each = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    each = each.withColumn("b", F.col("pair") % PAIR)
    return each.join(each.groupBy("b").agg(F.max("n").alias("top")), "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def scan(docs: DataFrame, path_a: str = VOCABULARY_A, path_b: str = VOCABULARY_B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    row = fresh(docs, "row")
    every = numbered(docs, row, made := [], [id_col, text_col]).select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = stored(aligned(every, path_a, path_b), [])
    discard(docs.sparkSession, made)
    counts = stored(pair_counts(found), made)
    known = F.broadcast(counts) if counts.count() <= BROADCAST_ROWS else counts
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times")
    sums = links.join(known, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = stored(sums, [])
    discard(docs.sparkSession, made)
    nil = F.lit(0).cast("long")
    out = found.drop("pairs", "times").join(sums, "row", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", nil).alias("n_best"), F.coalesce("count_sum", nil).alias("count_sum"), "groups_sha256")

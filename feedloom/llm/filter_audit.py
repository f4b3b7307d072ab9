"""How filters interact: what each one removes in every order, scanned from Arrow buffers.

Five conditions fail a text (words are runs of other bytes than U+0020 and U+0009 to U+000D, case-sensitive): A, fewer than 200
words; B, 100 times its different words are fewer than 50 times its words; C, 100 times its letters A to Z are more than 3 times
its code points; D, it holds one of # $ % & * |; E, a smaller doc_id anywhere in the table has the same text.

The scan works on the buffers of a batch: a byte's class is looked up, and prefix sums over the classes, taken at the texts' ends, count
words, capitals, symbols and code points. A word's hash is made of its bytes, eight at a time; a text's hashes are sorted, and
neighbours with equal hashes are compared byte by byte; should two of them differ, the text's words are counted by their bytes instead. A
document then has four bits, a digest (SHA-256) of its text, its part and its labels.

Copies share a digest, hence their bits; so for E only the number of documents with the digest's lowest doc_id is needed, which is
taken from counts per digest, part and labels, summed before they are shuffled. What is left is a table of counts by part, labels and
the five bits, from which all orders and steps follow.

Edge cases: null text counts as empty, a null part as ''. A null doc_id is neither smaller nor larger than any other, so its row
never fails E. Rows that repeat a doc_id with the same text are copies of each other but have no smaller doc_id. A document with
several rows in `labels` is good, or toxic, if any of them says so; null labels say nothing. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_pieces, stored

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, SYMBOLS = 200, 50, 3, b"#$%&*|"
#: Bits of a byte's class.
BLANK, CAPITAL, SYMBOL, STARTS = 1, 2, 4, 8
CLASS = np.zeros(256, np.uint8)
CLASS[[32, *range(9, 14)]] |= BLANK
CLASS[65:91] |= CAPITAL
CLASS[list(SYMBOLS)] |= SYMBOL
CLASS[[b for b in range(256) if not 0x80 <= b < 0xC0]] |= STARTS  # of a code point
#: Bytes whose classes are held at once, and words longer than LONG bytes are hashed and compared one by one.
CHUNK, LONG = 1 << 20, 64
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def scanned(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(begins, lengths of the words; counts of CAPITAL, SYMBOL and STARTS by text) of texts laid end to end. ends: their boundaries, 0 first."""
    begins, stops = [], []
    totals = {c: np.zeros(len(ends), np.int64) for c in (CAPITAL, SYMBOL, STARTS)}
    carry, before = dict.fromkeys(totals, 0), True  # what stands before the chunk is blank, or a word goes on
    for at in range(0, len(raw), CHUNK):
        kind = CLASS[raw[at : at + CHUNK]]
        n = len(kind)
        inside = slice(*np.searchsorted(ends, (at, at + n)))
        for c, t in totals.items():
            sums = np.concatenate([[0], np.cumsum((kind & c) != 0, dtype=np.int64)])
            t[inside] = carry[c] + sums[ends[inside] - at]
            carry[c] += int(sums[-1])
        word = (kind & BLANK) == 0
        edge = np.zeros(n + 1, bool)
        edge[ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + n, "right")] - at] = True
        prev = np.concatenate([[not before], word[:-1]])
        begins.append(at + np.flatnonzero(word & (edge[:-1] | ~prev)))
        stops.append(at + np.flatnonzero(prev & (edge[:-1] | ~word)))  # one behind the last byte
        before = not word[-1]
    if len(raw) and not before:
        stops.append(np.array([len(raw)]))
    for c, t in totals.items():
        t[ends == len(raw)] = carry[c]
    b, e = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (begins, stops))
    return b, e - b, {c: np.diff(t) for c, t in totals.items()}


class Words:
    """The words of texts laid end to end, by eights of bytes."""

    def __init__(self, raw: np.ndarray, begins: np.ndarray, lengths: np.ndarray):
        self.raw, self.begins, self.lengths = raw, begins, lengths
        self.padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        self.eights = np.ndarray(len(raw) + 1, "<u8", self.padded, strides=(1,))

    def eight(self, words: np.ndarray, k: int) -> np.ndarray:
        """The k-th eight bytes of words that have them, zero beyond their ends."""
        left = np.minimum(self.lengths[words] - 8 * k, 8).astype(U)
        return self.eights[self.begins[words] + 8 * k] & (U(0xFFFFFFFFFFFFFFFF) >> (U(64) - U(8) * left))

    def bytes(self, i: int) -> bytes:
        return self.raw[self.begins[i] : self.begins[i] + self.lengths[i]].tobytes()

    def hashes(self) -> np.ndarray:
        h = self.lengths.astype(U) * U(0x9E3779B97F4A7C15)
        left, k = np.flatnonzero(self.lengths <= LONG), 0
        while len(left):
            h[left] = mixed(h[left] ^ self.eight(left, k))
            k += 1
            left = left[self.lengths[left] > 8 * k]
        for i in np.flatnonzero(self.lengths > LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(self.bytes(i), digest_size=8).digest(), "big")
        return h

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the words at a are those at b, byte by byte."""
        same = self.lengths[a] == self.lengths[b]
        left, k = np.flatnonzero(same & (self.lengths[a] <= LONG)), 0
        while len(left):
            ok = self.eight(a[left], k) == self.eight(b[left], k)
            same[left[~ok]] = False
            k += 1
            left = left[ok & (self.lengths[a[left]] > 8 * k)]
        for i in np.flatnonzero(same & (self.lengths[a] > LONG)).tolist():
            same[i] = self.bytes(a[i]) == self.bytes(b[i])
        return same


def distinct_words(words: Words, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many different words each text has. bounds: where each text's words begin, and the end."""
    order = np.concatenate([np.zeros(0, np.int64), *(b + np.argsort(hashes[b:e]) for b, e in zip(bounds, bounds[1:], strict=False) if e > b)])
    h = hashes[order]
    again = np.flatnonzero(h[1:] == h[:-1]) + 1
    again = again[~np.isin(again, bounds)]  # the first word of a text has no neighbour before it
    verified = words.equal(order[again - 1], order[again])
    text = np.searchsorted(bounds, again, "right") - 1
    n = np.diff(bounds) - np.bincount(text, minlength=len(bounds) - 1)
    for d in np.unique(text[~verified]).tolist():
        n[d] = len({words.bytes(i) for i in range(bounds[d], bounds[d + 1])})
    return n


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings, and their boundaries, 0 first."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def measured(column: pa.Array) -> dict[str, np.ndarray]:
    """words, distinct, capitals, symbols and points (code points) of each text."""
    raw, ends = buffers(column)
    begins, lengths, totals = scanned(raw, ends)
    bounds = np.searchsorted(begins, ends)
    words = Words(raw, begins, lengths)
    return {"words": np.diff(bounds), "distinct": distinct_words(words, words.hashes(), bounds), "capitals": totals[CAPITAL], "symbols": totals[SYMBOL], "points": totals[STARTS]}


def failing(m: dict[str, np.ndarray]) -> np.ndarray:
    """The bits of A to D."""
    a, b = m["words"] < MIN_WORDS, 100 * m["distinct"] < DISTINCT_SHARE * m["words"]
    c, d = 100 * m["capitals"] > CAPITAL_SHARE * m["points"], m["symbols"] > 0
    return sum(x.astype(np.int32) << k for k, x in enumerate((a, b, c, d)))


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask (bits of A to D) and digest (of the text) of every document."""
    read = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, ends = buffers(batch.column("text"))
            view = memoryview(raw)
            digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            bits = failing(measured(batch.column("text")))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

        return one

    return map_pieces(read, make, f"doc_id {dict(docs.dtypes)[id_col]}, part string, mask int, digest binary")


def counted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask (bits of A to E) and n, the number of such documents. documents: masks(); labels: doc_id, quality, toxic."""
    said = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    # rows without a doc_id have no label and no place in the order, so they need not meet in one task
    lost = documents.where(F.col("doc_id").isNull()).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n")).select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "mask", "n")
    known = documents.where(F.col("doc_id").isNotNull()).join(said, "doc_id", "left")
    keys = ["digest", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")]
    each = known.groupBy(*keys, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = each.groupBy("digest", "part", "mask", "good", "toxic").agg(F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("firsts"), F.sum("n").alias("n"))
    lowest = F.min("low").over(Window.partitionBy("digest"))
    first = groups.select("part", "good", "toxic", "mask", "n", F.when(F.col("low") == lowest, F.col("firsts")).otherwise(0).alias("firsts"))
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("firsts").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(16)).alias("mask"), (F.col("n") - F.col("firsts")).alias("n"))))
    kept = first.select("part", "good", "toxic", both.alias("x")).select("part", "good", "toxic", "x.mask", "x.n")
    return kept.unionByName(lost).groupBy("part", "good", "toxic", "mask").agg(F.sum("n").alias("n"))


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a part, order and step, with counts of documents: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    groups = counted(documents, labels)
    orders = F.array(*(F.struct(F.lit("".join(o)).alias("filter_order"), F.array(*(F.lit(1 << FILTERS.index(x)) for x in o)).alias("bits")) for o in permutations(FILTERS)))
    rows = groups.select("part", "good", "toxic", "mask", "n", F.explode(orders).alias("o"))
    rows = rows.select("part", "good", "toxic", "mask", "n", "o.filter_order", F.posexplode("o.bits").alias("at", "bit"), F.col("o.bits").alias("bits"))
    before = F.aggregate(F.slice("bits", F.lit(1), F.col("at")), F.lit(0), lambda x, y: x + y)
    rows = rows.withColumn("passed", F.col("mask").bitwiseAND(before) == 0).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")) != 0)
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0)).cast("long")
    removed = F.col("passed") & F.col("fails")
    # a filter comes before all others that the document fails in as many orders as each of those does
    share = F.when(F.col("fails"), F.col("n") * F.expr("120 div bit_count(mask)")).otherwise(0)
    out = rows.groupBy("part", "filter_order", (F.col("at") + 1).cast("int").alias("step")).agg(
        total(F.col("passed") & ~F.col("fails")).alias("kept"), total(removed).alias("removed"), total(~F.col("passed") & F.col("fails")).alias("redundant"), total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(removed & F.col("good")).alias("good_lost"), total(removed & F.col("toxic")).alias("toxic_lost"), F.sum(share).cast("long").alias("shapley"),
    )
    return out


def scan(docs: DataFrame, labels: DataFrame, **names) -> DataFrame:
    """The audit of all documents, by part. The scan is written once, as rows with and without a doc_id are counted apart."""
    return audit(stored(masks(docs, **names), []), labels)

"""SimHash near-duplicates: exact comparison of fingerprints in tiles, with exclusive-or and bit counts in numpy.

A text's words are its runs of other bytes than blanks (U+0020, U+0009 to U+000D), A-Z lowered; its shingles are SHINGLE words that
follow each other, joined by spaces, repeats included (fewer words: all of them; none: no shingle). A shingle's hash is XXH64 with
SEED. A bit of the fingerprint is 1 if it is set in over half of the text's hashes. Two fingerprints link if RADIUS bits or fewer
differ; classes are the connected components.

Only different fingerprints are compared, so copies cost nothing. They are sorted by their bit count and by those of their four
quarters, and cut into tiles of about equal size. Bit counts of two fingerprints differ by no more than their bits do, and so does
the sum of the differences of their quarters' counts: tile pairs whose ranges of counts lie further apart than RADIUS are never
made, and inside a tile pair small tiles of SMALL rows are left out by the same test. What remains is compared whole.
A tile pair hands on each fingerprint's number of links, and the lowest fingerprint that it reaches inside the pair, never all links.

The work grows with the square of the number of different fingerprints, divided by what the counts exclude; no pair within the
radius is missed. Tiles have TILE fingerprints at most, so tasks are bounded at any size, and a tile is read from a written table.

Edge cases: null counts as empty; texts without words have fingerprint 0, which links like any other. doc_ids may be of any
ordered type; the component_id is the lowest one of the class, null if none of its rows has one. Repeated rows are documents of their
own. Words and texts may be of any length: a text is read in windows that end at a blank. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, map_pieces, stored, texts
from .near_dedup import components

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints of a tile: between these, by the size of the table, so that small tables give work to all tasks too.
TILE, TILE_LEAST, TILES = 1 << 16, 1 << 10, 64
#: Rows of the small tiles inside a tile pair, and links gathered there before classes are merged.
SMALL, LINKS = 256, 1 << 20
#: Comparisons of a task, about.
TASK = 1 << 30
#: Bytes of a text after which the next blank ends a window, and hashes whose bits are counted together.
WINDOW, HASHES = 1 << 20, 1 << 16
BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: The bit counts by which tiles are told apart: of the whole fingerprint and of its quarters.
COUNTS = ("p", "q0", "q1", "q2", "q3")


def hashes(data: bytes) -> Iterator[list[int]]:
    """The hashes of a text's shingles, in windows of bounded size."""
    from xxhash import xxh64_intdigest

    at, tail, some = 0, [], False
    while at < len(data):
        end = m.start() if len(data) > at + WINDOW and (m := BLANK.search(data, at + WINDOW)) else len(data)
        words = tail + data[at:end].lower().split()
        at = end
        if len(words) < SHINGLE:
            tail = words
            continue
        some = True
        line = b" ".join(words)
        begins = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
        yield list(map(xxh64_intdigest, [line[a : b - 1] for a, b in zip(begins, begins[SHINGLE:], strict=False)], repeat(SEED)))
        tail = words[1 - SHINGLE :]
    if not some and tail:
        yield [xxh64_intdigest(b" ".join(tail), SEED)]


def fingerprint(data: bytes) -> int:
    """The fingerprint of a text's UTF-8 bytes; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for window in hashes(data):
        h = np.array(window, ">u8")
        n += len(h)
        for at in range(0, len(h), HASHES):
            ones += np.unpackbits(h[at : at + HASHES].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every document."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t) for t in batch.column("text").cast(pa.large_binary()).to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

        return one

    return map_pieces(texts(docs, id_col=id_col, text_col=text_col), make, f"doc_id {dict(docs.dtypes)[id_col]}, fp long")


def counts(fp: np.ndarray) -> np.ndarray:
    """Bit counts of the whole and of the quarters, a row a fingerprint."""
    quarters = np.bitwise_count(np.ascontiguousarray(fp).view(np.uint16).reshape(-1, 4)).astype(np.int16)
    return np.column_stack([quarters.sum(1, dtype=np.int16), quarters])


def far(lo1, hi1, lo2, hi2):
    """How many bits two ranges of counts (last axis: COUNTS) are apart at least."""
    gap = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
    return np.maximum(gap[..., 0], gap[..., 1:].sum(-1))


def tiles(distinct: DataFrame, rows: int, size: int | None = None) -> DataFrame:
    """tile, the lowest and highest counts, fps and copies (arrays of longs as bytes) of tiles of the sorted fingerprints (fp, n)."""
    size = size or max(TILE_LEAST, min(TILE, rows // TILES))
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))) for k in range(4)]
    ordered = distinct.select("fp", "n", F.bit_count("fp").alias("p"), *(q.alias(f"q{k}") for k, q in enumerate(quarter)))
    parts = max(1, min(10_000, rows // (4 * size)))
    ordered = ordered.repartitionByRange(parts, *COUNTS, "fp").sortWithinPartitions(*COUNTS, "fp").select("fp", "n")

    def cut(batches):
        from pyspark import TaskContext

        k, held = TaskContext.get().partitionId() << 32, []

        def tile(block):
            fp, n = (block.column(c).to_numpy() for c in ("fp", "n"))
            c = counts(fp)
            row = {"tile": [k], "fps": [fp.tobytes()], "copies": [n.tobytes()]}
            return pa.RecordBatch.from_pydict(row | {x + e: [int(f(c[:, i]))] for i, x in enumerate(COUNTS) for e, f in (("_lo", min), ("_hi", max))}, schema)

        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= size:
                every = pa.Table.from_batches(held)
                yield tile(every.slice(0, size))
                k, held = k + 1, every.slice(size).to_batches()
        if any(x.num_rows for x in held):
            yield tile(pa.Table.from_batches(held))

    schema = pa.schema([("tile", pa.int64()), ("fps", pa.binary()), ("copies", pa.binary()), *((x + e, pa.int16()) for x in COUNTS for e in ("_lo", "_hi"))])
    return ordered.mapInArrow(cut, "tile long, fps binary, copies binary, " + ", ".join(f"{x}{e} short" for x in COUNTS for e in ("_lo", "_hi")))


def tile_pairs(every: DataFrame, radius: int) -> DataFrame:
    """a, b (a <= b): the pairs of tiles whose bit counts lie within the radius. They meet by the whole fingerprint's count, then the quarters' ranges decide."""
    meta = every.drop("fps", "copies")
    one = meta.select(*(F.col(c).alias(f"{c}_a") for c in meta.columns), F.explode(F.expr(f"sequence(p_lo - {radius}, p_hi + {radius})")).alias("at"))
    two = meta.select(*(F.col(c).alias(f"{c}_b") for c in meta.columns), F.explode(F.expr("sequence(cast(p_lo as int), cast(p_hi as int))")).alias("at"))
    gap = lambda c: F.greatest(F.lit(0), F.col(f"{c}_lo_a") - F.col(f"{c}_hi_b"), F.col(f"{c}_lo_b") - F.col(f"{c}_hi_a"))
    met = one.join(two, "at").where((F.col("tile_a") <= F.col("tile_b")) & (sum((gap(c) for c in COUNTS[1:]), F.lit(0)) <= radius))
    return met.select(F.col("tile_a").alias("a"), F.col("tile_b").alias("b")).distinct()


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Classes after links between places a and b. root holds each place's lowest place of its class, before and after."""
    while True:
        ra, rb = root[a], root[b]
        new = ra != rb
        if not new.any():
            return
        a, b, ra, rb = a[new], b[new], ra[new], rb[new]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root[:] = up


def compared(one: np.ndarray, two: np.ndarray, n1: np.ndarray, n2: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(lowest place of the class inside the pair, links) of both tiles' fingerprints, laid end to end; in a tile with itself those of the first count."""
    root, links, shift = np.arange(len(one) + len(two)), np.zeros(len(one) + len(two), np.int64), 0 if same else len(one)
    box = []
    for fp in (one, two):
        c, at = counts(fp), np.arange(0, len(fp), SMALL)
        box += [np.minimum.reduceat(c, at), np.maximum.reduceat(c, at)]
    ends, waiting = [], 0
    for i in range(len(box[0])):
        a0 = i * SMALL
        left, left_n = one[a0 : a0 + SMALL], n1[a0 : a0 + SMALL]
        near = np.flatnonzero(far(box[0][i], box[1][i], box[2], box[3]) <= radius)
        for j in near[near >= i] if same else near:
            b0 = int(j) * SMALL
            right = two[b0 : b0 + SMALL]
            hit = np.bitwise_count(left[:, None] ^ right[None, :]) <= radius
            if same and i == j:
                hit &= ~np.eye(len(left), dtype=bool)
            x, y = np.nonzero(hit)
            if not len(x):
                continue
            links[a0 : a0 + len(left)] += np.bincount(x, n2[b0 + y], len(left)).astype(np.int64)
            if not (same and i == j):
                links[shift + b0 : shift + b0 + len(right)] += np.bincount(y, left_n[x], len(right)).astype(np.int64)
            ends.append((a0 + x, shift + b0 + y))
            waiting += len(x)
            if waiting > LINKS:
                merge(root, *map(np.concatenate, zip(*ends, strict=True)))
                ends, waiting = [], 0
    if ends:
        merge(root, *map(np.concatenate, zip(*ends, strict=True)))
    return root, links


def linked(distinct: DataFrame, rows: int, made: list[str], radius: int = RADIUS, size: int | None = None) -> DataFrame:
    """fp, root, links: for each tile pair, every fingerprint with links there, a fingerprint of its class, and its links to documents. distinct: fp, n (documents)."""
    every = stored(tiles(distinct, rows, size), made)
    pairs = stored(tile_pairs(every, radius), made)
    one, two = (every.select(F.col("tile").alias(k), F.col("fps").alias(f"fps_{k}"), F.col("copies").alias(f"copies_{k}")) for k in "ab")
    # tile pairs cost the same, so they are dealt evenly, so many to a task as make TASK comparisons
    longest = every.agg(F.max(F.length("fps") / 8)).first()[0] or 1
    both = pairs.join(one, "a").join(two, "b").repartition(max(1, min(20_000, int(pairs.count() * longest**2 / TASK))))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                same = row["a"] == row["b"]
                fa, fb, na, nb = (np.frombuffer(row[c], t) for c, t in (("fps_a", np.uint64), ("fps_b", np.uint64), ("copies_a", np.int64), ("copies_b", np.int64)))
                root, links = compared(fa, fb, na, nb, same, radius)
                fps = np.concatenate([fa, fb]).view(np.int64)
                has = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array(fps[has]), pa.array(fps[root[has]]), pa.array(links[has])], ["fp", "root", "links"])

    return both.mapInArrow(run, "fp long, root long, links long")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int | None = None) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id, and n_links: how many other documents have a fingerprint within the radius."""
    spark = docs.sparkSession
    prints = stored(fingerprints(docs, id_col, text_col), [])
    distinct = stored(prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")), old := [])
    found = stored(linked(distinct.select("fp", "n"), distinct.count(), old, radius, tile), old)
    labels = components(found.where("fp <> root").select(F.col("fp").alias("a"), F.col("root").alias("b")))
    labels = stored(labels.withColumnRenamed("node", "fp"), old)
    degrees = found.groupBy("fp").agg(F.sum("links").alias("links"))
    # a fingerprint without links and copies is a class of its own, which needs no look-up
    known = distinct.join(labels, "fp", "left").join(degrees, "fp", "left").where("n > 1 OR links > 0")
    known = stored(known.select("fp", "low", F.coalesce("label", "fp").alias("label"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), old)
    lowest = stored(known.groupBy("label").agg(F.min("low").alias("component_id")), old)
    known = known.join(F.broadcast(lowest) if lowest.count() <= BROADCAST_ROWS else lowest, "label").select("fp", "component_id", "n_links")
    known = stored(known, kept := [])
    discard(spark, old)
    # classes are few against documents; where they are too many to be sent to all, the documents of a hot fingerprint are split by Spark's skew join
    out = prints.join(F.broadcast(known) if known.count() <= BROADCAST_ROWS else known, "fp", "left")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", digits.alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))

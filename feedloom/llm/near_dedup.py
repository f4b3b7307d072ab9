"""Near-duplicate classes by BagMinHash signatures, bands and exact verification.

A text is the multiset of its five-word shingles (words are runs of letters, digits and non-ASCII characters, A-Z lowered;
a shorter text is one shingle). Two texts are linked if the weighted Jaccard similarity of their multisets, the sum of
minima over the sum of maxima, is at least SIMILARITY; classes are the connected components of the links.

BagMinHash: the weights are discretised into levels, and the levels of a shingle are grouped into spans (0,1], (1,2],
(2,4], (4,8] ... Each span has a Poisson process whose rate is its number of levels; in a span that the weight only
partly fills, each point falls to one level by a further hash, and counts if the weight reaches it. A point goes to one of
M components, and a component keeps its first time. Two components agree with a probability equal to the weighted Jaccard
similarity. A shingle stops drawing as soon as its time is above the text's latest component, so work follows M log M.

Candidates share one of BANDS bands of ROWS components: at similarity 0.8 a pair is missed with probability 1e-5.
Identical word sequences are one class from the start. In a bucket everybody is compared with the bucket's first member (who shares most buckets),
not with all others; members that remain in different classes go into the next round with GROWTH times as many leaders, until no
bucket holds two classes that were not compared. Pairs whose sizes or signature bits exclude the similarity are dropped before
texts are read. So large groups of copies cost as many comparisons as they have members,
and nothing is capped. Buckets hold numbers of rows only in the first round, which is the large one. After it the texts that are left are bounded exactly: of a text's weight only what lies on
shingles of other such texts can overlap with any of them, and of two texts no more than the sum over GROUPS groups of shingles of
the smaller weight. Pairs whose bounds exclude the similarity are not made, and as at least one of a pair has STRONG of its weight on
such shingles, only such texts lead.

Rows are told apart by their place in the table, not by doc_id, so ids may be of any type, null, or repeated with other texts.

Edge cases: texts without words are in no class but their own. The class id is the lowest doc_id of the class, null if none of
its rows has one. keep_one keeps of each class the row with the lowest doc_id (null last), of these the first in the table.
Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, few_rows, fresh, map_pieces, numbered, stored

SIMILARITY, SHINGLE = 0.8, 5
BANDS, ROWS = 48, 7
M = BANDS * ROWS
GROWTH = 8
#: Of two texts at SIMILARITY, at least one has this share of its weight on shingles of the other.
STRONG = 2 * SIMILARITY / (1 + SIMILARITY)
#: Shingles fall into so many groups by their hash; the sum of the groups' smaller weights bounds the overlap of two texts.
GROUPS = 64
#: One bit of each component, in 64-bit words. At similarity 0.8 a tenth of the bits differ; DIFFER is five standard
#: deviations above (3e-7 of such pairs are missed), and excludes most pairs below 0.6 before anything is shipped.
LONGS, DIFFER = (M + 63) // 64, 61
#: Bytes whose words are hashed together; words may go on in the next piece.
CHUNK = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 64

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((BASE, INVERSE)):
            p = np.full(n, U(b))
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its hash, of UTF-8 texts laid end to end. Memory follows the words, and CHUNK."""
    all_begins, all_hashes, all_lengths, goes_on, length = [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, np.int64)], False, 0
    for at in range(0, len(raw), CHUNK):
        part = LOWER[raw[at : at + CHUNK]]
        n = len(part)
        word = IS_WORD[part]
        edge = np.zeros(n + 1, bool)
        inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, at + n, "right")]
        edge[inside - at] = True
        begins = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
        ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
        up, down = powers(CHUNK + 1)
        total = np.zeros(n + 1, U)
        np.add.accumulate((part.astype(U) + U(1)) * up[:n], out=total[1:])
        h = (total[ends] - total[begins]) * down[begins]
        if goes_on and len(begins) and begins[0] == 0 and not edge[0]:  # the last word of the piece before goes on
            all_hashes[-1][-1:] += h[:1] * U(pow(BASE, length, 1 << 64))
            all_lengths[-1][-1:] += ends[0]
            length += int(ends[0])
            goes_on = length if ends[0] == n else 0
            begins, ends, h = begins[1:], ends[1:], h[1:]
        else:
            goes_on = 0
        if len(begins):
            all_begins.append(begins + at)
            all_hashes.append(h)
            all_lengths.append(ends - begins)
            length = goes_on = int(n - begins[-1]) if ends[-1] == n else 0
    b, h, n = np.concatenate(all_begins), mix(np.concatenate(all_hashes)), np.concatenate(all_lengths)
    for i in np.flatnonzero(n > LONG).tolist():  # sums modulo a power of two have known collisions of long words
        h[i] = int.from_bytes(hashlib.blake2b(LOWER[raw[b[i] : b[i] + n[i]]].tobytes(), digest_size=8).digest(), "big")
    return b, h


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, multiplicity) of every distinct shingle, by text and hash; and words by text. All vectorised."""
    column = pc.cast(column, pa.large_string()).combine_chunks() if isinstance(column, pa.ChunkedArray) else pc.cast(column, pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    begins, w = words_of(raw, offsets)
    doc = np.searchsorted(offsets, begins, "right") - 1
    count = np.bincount(doc, minlength=n)[:n]
    at = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(len(w)) - at[doc]
    keep = (place <= count[doc] - SHINGLE) | (place == 0)
    idx = np.flatnonzero(keep)
    s = np.zeros(len(idx), U)
    for k in range(SHINGLE):
        inside = place[idx] + k < count[doc[idx]]
        s = mix(s * U(BASE) + np.where(inside, w[np.minimum(idx + k, max(0, len(w) - 1))], U(0))) if len(w) else s
    d = doc[idx]
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])])) if len(d) else np.zeros(0, int)
    return d[new], s[new], np.diff(np.concatenate([new, [len(d)]])).astype(np.int64), count


def signatures(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """n rows of m first times; infinite for texts without shingles."""
    sig = np.full((n, m), np.inf)
    spans = [(doc, shingle, np.ones(len(doc)), np.ones(len(doc)))]
    low = 1
    while len(i := np.flatnonzero(weight > low)):
        spans.append((doc[i], mix(shingle[i] + U(low)), np.full(len(i), float(low)), np.minimum(weight[i] - low, low).astype(float)))
        low *= 2
    d, seed, rate, limit = (np.concatenate(x) for x in zip(*spans, strict=True))
    t = np.zeros(len(d))
    flat, step = sig.reshape(-1), 0
    while len(d):
        step += 1
        x = mix(seed + U(step * BASE % (1 << 64)))
        t = t - np.log(((x >> U(11)).astype(float) + 0.5) * 2.0**-53) / rate
        y = mix(x + U(0x632BE59BD9B4E019))
        part = ((y >> U(32)) * U(m)) >> U(32)
        level = (y & U(0xFFFFFFFF)).astype(float) * 2.0**-32 * rate
        ok = level < limit
        np.minimum.at(flat, d[ok] * m + part[ok].astype(np.int64), t[ok])
        alive = t < sig.max(1)[d]
        d, seed, rate, limit, t = d[alive], seed[alive], rate[alive], limit[alive], t[alive]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, the band's number mixed in."""
    v = sig.view(U).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U)), (len(sig), BANDS)).copy()
    for k in range(ROWS):
        key = mix(key * U(BASE) + v[:, :, k])
    return key.view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """row, doc_id, w1 and w2 (a 128-bit hash of the multiset of shingles, null without words), keys (band keys), bits, size."""
    kind = dict(docs.dtypes)["doc_id"]

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            col = batch.column("text")
            d, s, w, count = shingles(col)
            n = len(col)
            sig = signatures(d, s, w, n)
            keys = band_keys(sig)
            # two sums over the multiset, with the word count, tell texts apart as well as a hash of the shingles does
            both = [count.astype(U), count.astype(U)]
            for k in range(2):
                np.add.at(both[k], d, mix(s + U(k + 1)) * w.astype(U))
            whole = [pa.array(mix(x).view(np.int64), mask=count == 0) for x in both]
            bits = np.zeros((n, LONGS * 8), np.uint8)
            bits[:, : M // 8] = np.packbits((mix(sig.view(U)) & U(1)).astype(bool), axis=1)
            low = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * LONGS), pa.array(bits.view(np.int64).reshape(-1)))
            size = pa.array(np.bincount(d, w, n).astype(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
            return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *whole, lists, low, size], ["row", "doc_id", "w1", "w2", "keys", "bits", "size"])

        return one

    return map_pieces(docs, make, f"row long, doc_id {kind}, w1 long, w2 long, keys array<bigint>, bits array<bigint>, size long", 1 << 20)


def verified(pairs: DataFrame, docs: DataFrame, made: list[str], similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of rows whose exact weighted Jaccard similarity is high enough, with it. It reads a table of their texts, whose path is added to `made`."""
    ids = stored(pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct(), made)
    t = stored(docs.join(few_rows(ids, "row"), "row", "left_semi").select("row", "text"), made)
    left = t.select(F.col("row").alias("a"), "text")
    right = t.select(F.col("row").alias("b"), F.col("text").alias("text2"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text", "text2")

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            d1, s1, w1, _ = shingles(batch.column("text"))
            d2, s2, w2, _ = shingles(batch.column("text2"))
            d, s, w = np.concatenate([d1, d2]), np.concatenate([s1, s2]), np.concatenate([w1, w2])
            order = np.lexsort((s, d))
            d, s, w = d[order], s[order], w[order]
            same = np.flatnonzero((d[1:] == d[:-1]) & (s[1:] == s[:-1])) if len(d) else np.zeros(0, int)
            least = np.bincount(d[same], np.minimum(w[same], w[same + 1]), n)
            total = np.bincount(d, w, n)
            ok = (total > 0) & (least >= similarity * (total - least) - 1e-9)
            alike = pa.array(least / np.maximum(1, total - least))
            return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), alike], ["a", "b", "similarity"]).filter(pa.array(ok))

        return one

    return map_pieces(both, make, "a long, b long, similarity double", 1 << 20)


def components(edges: DataFrame) -> DataFrame:
    """node, label (the lowest node) of the graph's nodes: neighbours' minima and pointer jumping, until nothing changes. Nodes are longs."""
    spark = edges.sparkSession
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), graph := [])
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), old := [])
    total = None
    while True:
        told = both.join(labels.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node"), "label")
        jumped = labels.select("node", F.col("label").alias("up")).join(labels.select(F.col("node").alias("up"), F.col("label").alias("top")), "up").select("node", F.col("top").alias("label"))
        labels = stored(labels.select("node", "label").union(told).union(jumped).groupBy("node").agg(F.min("label").alias("label")), now := [])
        discard(spark, old)
        old = now
        # labels only ever fall, so nothing has changed if their sum has not
        new = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if new == total:
            discard(spark, graph)
            return labels
        total = new


def joined(labels: DataFrame | None, good: DataFrame) -> DataFrame:
    """Labels after further links: only the classes that these touch are looked at again."""
    if labels is None:
        return components(good)
    if good.isEmpty():
        return labels
    one, two = labels.withColumnRenamed("label", "la"), labels.withColumnRenamed("label", "lb")
    ends = good.join(one.withColumnRenamed("node", "a"), "a", "left").join(two.withColumnRenamed("node", "b"), "b", "left")
    ends = stored(ends.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb")), old := [])
    new = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    every = labels.union(ends.select("a", "la")).union(ends.select("b", "lb")).distinct()
    out = stored(every.join(new.select(F.col("node").alias("label"), F.col("label").alias("n")), "label", "left").select("node", F.coalesce("n", "label").alias("label")))
    discard(good.sparkSession, old)
    return out


def weights_alone(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """row, alone: by group of shingles, the weight of those that no other of these texts has (only texts that have such)."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            d, s, w, _ = shingles(batch.column("text"))
            return pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(d)), pa.array(s.view(np.int64)), pa.array(w)], ["row", "s", "w"])

        return one

    rows = map_pieces(docs.join(few_rows(ids, "row"), "row", "left_semi").select("row", "text"), make, "row long, s long, w long", 1 << 20)
    once = rows.groupBy("s").agg(F.min("row").alias("row"), F.max("row").alias("last"), F.max("w").alias("w")).where("row = last")
    by_group = once.groupBy("row", F.pmod("s", F.lit(GROUPS)).cast("int").alias("g")).agg(F.sum("w").alias("w"))
    return by_group.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("g", "w"))).alias("alone"))


def weights(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """row, all: the weight of each text's shingles by group."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            d, s, w, _ = shingles(batch.column("text"))
            n = batch.num_rows
            g = (s.view(np.int64) % GROUPS).astype(np.int64)
            flat = np.bincount(d * GROUPS + g, w, n * GROUPS).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * GROUPS), pa.array(flat))
            return pa.RecordBatch.from_arrays([batch.column("row"), lists], ["row", "all"])

        return one

    return map_pieces(docs.join(few_rows(ids, "row"), "row", "left_semi").select("row", "text"), make, "row long, all array<bigint>", 1 << 20)


def bounded(left: DataFrame, docs: DataFrame, made: list[str]) -> DataFrame:
    """The rows of texts that can be linked to another of these, with the weight they can share in `shared`, by group in `groups`."""
    ids = stored(left.select("row").distinct(), old := [])
    alone = stored(weights_alone(ids, docs), old)
    sums = alone.select("row", F.aggregate(F.map_values("alone"), F.lit(0).cast("long"), lambda x, y: x + y).alias("sum"))
    left = left.join(sums, "row", "left").withColumn("shared", F.col("size") - F.coalesce("sum", F.lit(0))).drop("sum")
    left = stored(left.where(F.col("shared") >= SIMILARITY * F.col("size") - 1e-6), old)
    ids = stored(left.select("row").distinct(), old)
    every = weights(ids, docs).join(alone, "row", "left")
    groups = F.transform("all", lambda x, i: x - F.coalesce(F.col("alone")[i], F.lit(0)))
    out = stored(left.join(every.select("row", groups.alias("groups")), "row").select("key", *MEMBER), made)
    discard(docs.sparkSession, old)
    return out


MEMBER = ("row", "order", "bits", "size", "shared", "groups", "c")


def alike(one, two) -> F.Column:
    """Sizes and signature bits do not exclude the similarity. one and two name columns of the two sides."""
    differ = sum((F.bit_count(one("bits")[i].bitwiseXOR(two("bits")[i])) for i in range(LONGS)), F.lit(0))
    return (one("size") >= SIMILARITY * two("size")) & (two("size") >= SIMILARITY * one("size")) & (differ <= DIFFER)


def still_open(rest: DataFrame, made: list[str]) -> DataFrame:
    """Buckets that hold two classes, and a text that may lead."""
    return stored(rest.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("strong").alias("strong")).where("lo <> hi AND strong").select("key"), made)


class Links:
    """The verified links of all rounds, in tables that are deleted once they were counted."""

    def __init__(self) -> None:
        self.made: list[str] = []
        self.tables: list[DataFrame] = []

    def all(self) -> DataFrame | None:
        return reduce(DataFrame.union, self.tables) if self.tables else None


def compare(pairs: DataFrame, docs: DataFrame, labels: DataFrame | None, kept: Links) -> DataFrame | None:
    """Labels with the links among new pairs (a, b), which are kept."""
    if pairs.isEmpty():
        return labels
    good = stored(verified(pairs, docs, old := []), kept.made)
    kept.tables.append(good)
    out = joined(labels, good) if labels is not None or not good.isEmpty() else None
    discard(docs.sparkSession, old)
    return out


def first_round(reps: DataFrame, docs: DataFrame, old: list[str], kept: Links) -> tuple[DataFrame, DataFrame | None]:
    """(members of shared buckets but their leaders: key, row, order; labels). One leader a bucket; rows carry numbers only."""
    spark = docs.sparkSession
    rows = reps.select("row", F.explode("keys").alias("key"))
    shared = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), first := [])
    multi = stored(rows.join(shared, "key"), first)
    # who shares most buckets leads: the text that others were copied from, if it is there, is near to all of them
    degree = stored(multi.groupBy("row").agg((-F.sum("n")).alias("order")), first)
    multi = stored(multi.drop("n").join(degree, "row"), old)
    discard(spark, first)
    lead = stored(multi.groupBy("key").agg(F.min(F.struct("order", "row")).alias("l")).select("key", F.col("l.row").alias("lead")), first)
    rest = stored(multi.join(lead, "key").where("row <> lead"), old)
    info = reps.select("row", "bits", "size")
    one, two = info.select(F.col("row").alias("a"), "bits", "size"), info.select(F.col("row").alias("b"), F.col("bits").alias("bits2"), F.col("size").alias("size2"))
    pairs = rest.select(F.greatest("row", "lead").alias("a"), F.least("row", "lead").alias("b")).distinct().join(one, "a").join(two, "b")
    pairs = stored(pairs.where(alike(F.col, lambda c: F.col(c + "2"))).select("a", "b"), first)
    labels = compare(pairs, docs, None, kept)
    discard(spark, first)
    return rest.select("key", "row", "order"), labels


def links(reps: DataFrame, docs: DataFrame, kept: Links) -> DataFrame | None:
    """node, label of the representatives (row, keys, bits, size) that are linked to others; None if there are none."""
    spark, old = docs.sparkSession, []
    rest, labels = first_round(reps, docs, old, kept)
    strong = F.col("shared") >= STRONG * F.col("size") - 1e-6

    def classed(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("c", F.col("row"))
        return rows.drop("c").join(labels.select(F.col("node").alias("row"), "label"), "row", "left").withColumn("c", F.coalesce("label", "row")).drop("label")

    rest = stored(classed(rest), old)
    open_keys = still_open(rest.withColumn("strong", F.lit(True)), old)
    if open_keys.isEmpty():
        discard(spark, old)
        return labels
    left = rest.join(open_keys, "key").join(reps.select("row", "bits", "size"), "row")
    left = bounded(left, docs, new := [])
    discard(spark, old)
    old, leaders = new, GROWTH
    while True:
        # the first `leaders` strong members of each bucket lead; each is compared with all members of other classes
        rank = F.row_number().over(Window.partitionBy("key").orderBy("order", "row"))
        led = left.where(strong).withColumn("rank", rank).where(F.col("rank") <= leaders).select(F.col("key").alias("lead_key"), *(F.col(c).alias(f"lead_{c}") for c in ("row", "bits", "size", "shared", "groups", "c")))
        led = stored(led, old)
        least = SIMILARITY * (F.col("size") + F.col("lead_size")) - 1e-6
        both = sum((F.least(F.col("groups")[i], F.col("lead_groups")[i]) for i in range(GROUPS)), F.lit(0))
        bound = ((1 + SIMILARITY) * F.least("shared", "lead_shared") >= least) & ((1 + SIMILARITY) * both >= least)
        # members of one class need no comparison
        pairs = left.join(led, (F.col("key") == F.col("lead_key")) & (F.col("c") != F.col("lead_c")) & bound & alike(F.col, lambda c: F.col("lead_" + c)))
        pairs = stored(pairs.select(F.greatest("row", "lead_row").alias("a"), F.least("row", "lead_row").alias("b")).distinct(), old)
        labels = compare(pairs, docs, labels, kept)
        # a leader has met everybody in its bucket; what is left matters where it holds two classes
        rest = left.join(led.select(F.col("lead_key").alias("key"), F.col("lead_row").alias("row")), ["key", "row"], "left_anti")
        rest = stored(classed(rest).select("key", *MEMBER), old)
        open_keys = still_open(rest.withColumn("strong", strong), old)
        if open_keys.isEmpty():
            discard(spark, old)
            return labels
        left = stored(rest.join(open_keys, "key").select("key", *MEMBER), new := [])
        discard(spark, old)
        old = new
        leaders *= GROWTH


def found(docs: DataFrame, made: list[str]) -> DataFrame:
    """row, doc_id, node, n_links: the class of every row, named by the row that stands for it, and how many other texts its own was verified to be like. docs: row, doc_id, text. A table, whose path is added to `made`."""
    sketches = stored(sketched(docs), old := [])
    known = sketches.where(F.col("w1").isNotNull())
    reps = stored(known.groupBy("w1", "w2").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("keys", "bits", "size"))), old)
    labels = links(reps.drop("w1", "w2"), docs.select("row", "text"), kept := Links())
    ends = reps.select("w1", "w2", F.col("row").alias("rep"))
    ends = ends.withColumn("label", F.col("rep")) if labels is None else ends.join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    if (good := kept.all()) is not None:
        degree = good.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
        ends = ends.join(degree, "rep", "left")
    else:
        ends = ends.withColumn("n_links", F.lit(0).cast("long"))
    ends = ends.select("w1", "w2", F.coalesce("label", "rep").alias("node"), "n_links")
    out = sketches.select("row", "doc_id", "w1", "w2").join(ends, ["w1", "w2"], "left")
    out = stored(out.select("row", "doc_id", F.coalesce("node", "row").alias("node"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), made)
    discard(docs.sparkSession, old + kept.made)
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id, class_size (rows) and n_links, one row for each input row.

    n_links counts the other texts that the row's own was verified to be like on the way: with the leaders of its buckets, so that a text in a class of
    several has one at least, but not with every member.
    """
    row = fresh(docs, "row")
    every = numbered(docs, row, made := [], [id_col, text_col])
    f = found(every.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), [])
    discard(docs.sparkSession, made)
    lowest = f.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return f.join(lowest, "node").select("doc_id", "class_id", "class_size", "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all their columns: of each class the row with the lowest doc_id (null last), of these the first."""
    row = fresh(docs, "row")
    every = numbered(docs, row, [])
    f = found(every.select(F.col(row).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")), made := [])
    best = f.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
    lost = stored(f.join(best.select("node", F.col("best.row").alias("stays")), "node").where("row <> stays").select("row"))
    discard(docs.sparkSession, made)
    return every.join(few_rows(lost, "row").withColumnRenamed("row", row), row, "left_anti").select(*docs.columns)

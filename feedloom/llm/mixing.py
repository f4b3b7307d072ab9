"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of at most BLOCK words. The blocks of a source are put in a random order (by hashes of their
document and place); a source's target is met by whole passes over that order and the first blocks of one more, the last of
them cut, so that targets are met to the word. That gives every source an exact quota of blocks.

The quotas are dealt among the output shards (SHARDS at least, more for a large mix), all of one size, by a binary tree: at each node the left half's share of every
source is one multivariate-hypergeometric draw (a chain of hypergeometric ones), so together the shards are a uniform shuffle
of all blocks drawn, and parts always add up. Each shard walks its own way down the tree; draws are keyed by the node, so
all agree without talking. A shard takes disjoint runs of each source's order, and is shuffled locally by a further hash.

Sources are dealt into cells by the hash for ordering, more cells for a larger one, so that a source with a third of all rows
fills no task. What has one row a source (weights, quotas) goes through one task and the driver; a source is a label, and there
are taken to be at most some millions of them.

Draws are exact at any size: up to 1e9 blocks by numpy, beyond by inversion over all values within 12 standard deviations of
the mode, whose relative weights follow from the ratio of neighbours (what lies outside has a probability below 1e-30).

Edge cases: null text has size 0; null source is a source of its own, last in order; sources without words have target 0;
doc_ids may be of any type, null or repeated. All draws are functions of seed and rows, so reruns agree; repeated rows
are separate documents, each at most 2 times its size. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
BLOCK = 256
#: Blocks of a cell and of a shard, about.
CELL_BLOCKS, SHARD_BLOCKS = 512, 1 << 15
#: Shards at least, however small the mix is.
SHARDS = 64
#: Runs of a source's order are looked up by stretches of so many blocks.
STRETCH = 256


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, target. Water filling in closed form: by rising cap per weight, what is left is shared by weight; the level is the largest over all starts, and a source whose cap lies below it is full."""
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.coalesce(*(F.when(place == i, F.lit(float(w))) for i, w in enumerate(weights)))
    t = sizes.withColumn("w", weight).withColumn("top", cap * F.col("source_size")).withColumn("ratio", F.col("top") / F.col("w"))
    by = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("all", F.sum("source_size").over(every) * share).withColumn("level", (F.col("all") - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(after))
    t = t.withColumn("level", F.max("level").over(every))
    return t.select("source", "source_size", F.when(F.col("ratio") <= F.col("level"), F.col("top")).otherwise(F.col("w") * F.col("level")).alias("target"))


def draw(good: int, bad: int, n: int, key: str) -> int:
    """How many of n blocks, drawn without return, are among the good ones; a function of its arguments."""
    if not good or not bad or not n:
        return n if good and not bad else 0
    rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big"))
    if max(good, bad) < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    return inverted(good, bad, n, rng.random())


def inverted(good: int, bad: int, n: int, u: float) -> int:
    """The hypergeometric value at quantile u, from ratios of neighbouring probabilities around the mode."""
    total = good + bad
    low, high = max(0, n - bad), min(good, n)
    mode = (n + 1) * (good + 1) // (total + 2)
    far = 12 * math.sqrt(max(1.0, n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))) + 50
    low, high = max(low, int(mode - far)), min(high, int(mode + far))
    k = np.arange(low, high, dtype=np.float64)  # log of p(k + 1) / p(k)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log((bad - n) + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(p, u * p[-1], "right").clip(0, high - low))


def shard_quotas(quotas: list[int], shards: int, shard: int, key: str) -> list[tuple[int, int, int]]:
    """(source, begin, end) of the runs of each source's order that one shard takes: its way down the tree. Sizes of shards differ by one block at most."""
    total = sum(quotas)
    edge = lambda k: k * total // shards  # noqa: E731  blocks in the shards before k
    part = [(s, 0, q) for s, q in enumerate(quotas) if q]
    a, b = 0, shards
    while b - a > 1:
        m = (a + b) // 2
        room, left = edge(m) - edge(a), []
        rest = edge(b) - edge(a)
        for s, begin, q in part:
            rest -= q
            k = draw(q, rest, room, f"{key}:{a}:{b}:{s}")
            room -= k
            left.append(k)
        if shard < m:
            b, part = m, [(s, begin, k) for (s, begin, _), k in zip(part, left, strict=True) if k]
        else:
            a, part = m, [(s, begin + k, q - k) for (s, begin, q), k in zip(part, left, strict=True) if q > k]
    return [(s, begin, begin + q) for s, begin, q in part]


def ordered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(row, doc_id, source, size; one row a source: sid, source, source_size, target, copies, blocks, extra; the blocks: sid, idx, row, begin, end, more).

    idx is the block's place in its source's order. Of `more` words of it the last pass takes; `extra` blocks have any.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), F.xxhash64(F.lit(seed), F.col(id_col).cast("string"), text, F.col(source_col).cast("string")).alias("mix"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    blocks_of = F.floor((F.col("size") + BLOCK - 1) / BLOCK).cast("long")
    sizes = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(blocks_of).alias("blocks")))
    sources = targets(sizes).join(sizes.select(F.col("source").alias("s"), "blocks"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = F.round("target").cast("long")
    copies = F.when(F.col("source_size") > 0, F.least(F.lit(int(CAP)).cast("long"), F.floor(whole / F.greatest(F.col("source_size"), F.lit(1))))).otherwise(F.lit(0).cast("long"))
    sources = sources.withColumn("copies", copies).withColumn("rest", F.least(whole - F.col("copies") * F.col("source_size"), F.col("source_size")))
    sources = stored(sources.withColumn("sid", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1))
    of = sources.select(F.col("source").alias("s"), "sid", "rest", F.greatest(F.lit(1), F.ceil(F.col("blocks") / CELL_BLOCKS)).alias("cells"))
    b = rows.where("size > 0").join(of, F.col("source").eqNullSafe(F.col("s"))).select("sid", "rest", "cells", "row", "mix", "size", F.explode(F.expr(f"sequence(0L, size - 1, {BLOCK}L)")).alias("begin"))
    b = b.withColumn("end", F.least("size", F.col("begin") + BLOCK)).withColumn("key", F.xxhash64(F.lit(seed + 1), "mix", "begin")).withColumn("cell", F.pmod("key", "cells"))
    cells = b.groupBy("sid", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("begin")).alias("words"))
    before = Window.partitionBy("sid").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    nil = F.lit(0).cast("long")
    cells = cells.select("sid", "cell", F.coalesce(F.sum("n").over(before), nil).alias("n0"), F.coalesce(F.sum("words").over(before), nil).alias("w0"))
    inside = Window.partitionBy("sid", "cell").orderBy("key", "mix", "begin", "row")
    b = b.withColumn("k", F.row_number().over(inside)).withColumn("done", F.coalesce(F.sum(F.col("end") - F.col("begin")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), nil))
    b = b.join(cells, ["sid", "cell"])
    more = F.greatest(nil, F.least(F.col("end") - F.col("begin"), F.col("rest") - F.col("w0") - F.col("done")))
    b = stored(b.select("sid", (F.col("n0") + F.col("k") - 1).alias("idx"), "row", "mix", "begin", "end", more.alias("more")))
    extra = b.where("more > 0").groupBy("sid").agg(F.count(F.lit(1)).alias("extra"))
    return rows, stored(sources.join(extra, "sid", "left").withColumn("extra", F.coalesce("extra", nil))), b


def dealt(sources: DataFrame, b: DataFrame, shards: int | None = None, seed: int = 11) -> DataFrame:
    """Every block of the mix: shard, place (the local shuffle's order), row, copy, begin, end."""
    spark = b.sparkSession
    quotas = [int(r["q"]) for r in sources.orderBy("sid").select((F.col("copies") * F.col("blocks") + F.col("extra")).alias("q")).collect()]
    shards = shards or max(SHARDS, sum(quotas) // SHARD_BLOCKS)

    def walk(batches):
        for p in batches:
            for k in p["id"]:
                runs = shard_quotas(quotas, shards, int(k), str(seed))
                yield pd.DataFrame([(k, *r) for r in runs], columns=["shard", "sid", "a", "b"])

    runs = spark.range(0, shards, 1, max(1, min(shards, 1000))).mapInPandas(walk, "shard long, sid int, a long, b long")
    runs = runs.withColumn("stretch", F.explode(F.expr(f"sequence(a div {STRETCH}, (b - 1) div {STRETCH})")))
    few = F.broadcast(sources.select("sid", "copies", "blocks")) if len(quotas) <= 100_000 else sources.select("sid", "copies", "blocks")
    taken = F.expr("filter(transform(sequence(0L, copies), i -> struct(i as copy, i * blocks + idx as j, if(i < copies, end - begin, more) as n)), x -> x.n > 0)")
    drawn = b.join(few, "sid").select("sid", "row", "mix", "begin", F.explode(taken).alias("x")).select("sid", "row", "mix", "begin", "x.copy", "x.j", (F.col("begin") + F.col("x.n")).alias("end"))
    drawn = drawn.withColumn("stretch", F.expr(f"j div {STRETCH}"))
    out = drawn.join(runs, ["sid", "stretch"]).where("j >= a AND j < b")
    return out.select("shard", F.xxhash64(F.lit(seed + 2), "mix", "begin", "copy").alias("place"), "row", "copy", "begin", "end")


def mixed(docs: DataFrame, shards: int | None = None, **names) -> DataFrame:
    """The mix itself: shard, place, doc_id, begin, end (words), copy; each shard's rows stand together, in their order."""
    rows, sources, b = ordered(docs, **names)
    out = dealt(sources, b, shards).join(rows.select("row", "doc_id"), "row").drop("row")
    return out.repartition("shard").sortWithinPartitions("shard", "place", "begin", "copy")


def taken(docs: DataFrame, shards: int | None = None, **names) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words of the mix, repeats counted), n_shards and runs of every document.

    n_shards is the number of shards that hold blocks of it; runs is a digest of where these stand: the exclusive-or of the hashes of their shard,
    place, copy, begin and end, in hexadecimal (0 if none was taken).
    """
    rows, sources, b = ordered(docs, **names)
    run = F.xxhash64("shard", "place", "copy", "begin", "end")
    each = dealt(sources, b, shards).groupBy("row", "shard").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"), F.bit_xor(run).alias("runs"))
    got = each.groupBy("row").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n_shards"), F.bit_xor("runs").alias("runs"))
    s = sources.select(F.col("source").alias("s"), "source_size", "target")
    out = rows.join(s, F.col("source").eqNullSafe(F.col("s"))).join(got, "row", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_shards")), F.lower(F.lpad(F.hex(F.coalesce("runs", F.lit(0).cast("long"))), 16, "0")).alias("runs"))

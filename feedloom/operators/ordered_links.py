"""Links that must be taken in order, without a task that holds a whole component.

Each link joins two groups if a rule that looks at both groups as they are by then allows it. A link that is the earliest of all that
are left at both its groups can be decided now, whatever becomes of the others, since only a link at a group can change it. Rounds
decide such links, and more: groups are dealt to blocks by their earliest link, and a block goes through its links in order. What
it may not decide yet it leaves: a link whose other group is in another block, and all links behind such a one at either of its groups. Then groups are
contracted and dealt anew. The earliest link of all has both groups in one block, so every round decides some; blocks are cut so that
each has about `size` links with both groups in it, and no block is given more than twice that: those behind wait like links between blocks.

A chain in which every decision rests on the one before takes as many rounds as it has blocks, since such decisions cannot be made at once;
what does not hang together is decided in parallel. Few links are one block and one round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cutting import cut, dropped, written

#: Links of a block, about.
LINKS = 200_000
#: Blocks of a round at most; blocks grow no further, more rounds are made.
BLOCKS = 10_000
FACTS = "g long, lead long, at long, bar long, node long"
OUT = "g long, to long, lead long, at long, o long, g_a long, g_b long, node_a long, node_b long"


def in_order(links: DataFrame, *by: str) -> DataFrame:
    """links with o, a number that rises with the columns `by`. Rows are sorted by ranges, each numbered behind the one before."""
    return cut(links.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("o", F.monotonically_increasing_id()))


class Groups:
    """Groups of a block: which one they became part of, their leaders, and the place in the order from which they must wait."""

    def __init__(self, facts: pd.DataFrame):
        x = facts[facts["g"].notna()]
        self.up = {int(g): int(g) for g in x["g"]}
        self.leader = {int(g): (int(at), int(lead)) for g, at, lead in zip(x["g"], x["at"], x["lead"], strict=True)}
        self.bar = {int(g): int(b) for g, b in zip(x["g"], x["bar"], strict=True) if not pd.isna(b)}

    def root(self, g: int) -> int:
        while self.up[g] != g:
            self.up[g] = self.up[self.up[g]]
            g = self.up[g]
        return g

    def waits(self, g: int, o: int) -> bool:
        return self.bar.get(g, o) < o

    def wait(self, g: int, o: int) -> None:
        self.bar[g] = min(self.bar.get(g, o), o)

    def join(self, x: int, y: int) -> None:
        low, high = min(x, y), max(x, y)
        self.up[high] = low
        self.leader[low] = min(self.leader[low], self.leader[high])
        if high in self.bar:
            self.wait(low, self.bar[high])


def block_of(lo: Column, bounds: list[int]) -> Column:
    if not bounds:
        return F.lit(0)
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def find(s: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, s.to_numpy(), "left").astype(np.int32))

    return find(lo)


def dealt(links: DataFrame, n: int, size: int, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """(links with block if both groups are in it and it has room, else null; g, block, bar: each group's block and its first link that must wait)."""
    ends = links.select(F.col("g_a").alias("g"), "o").union(links.select("g_b", "o"))
    first = written(ends.groupBy("g").agg(F.min("o").alias("lo")), made)
    if n <= size:
        return links.withColumn("block", F.lit(0)), first.select("g", F.lit(0).alias("block"), F.lit(None).cast("long").alias("bar"))
    both = links.join(first.select(F.col("g").alias("g_a"), F.col("lo").alias("lo_a")), "g_a").join(first.select(F.col("g").alias("g_b"), F.col("lo").alias("lo_b")), "g_b")
    both = written(both, made)
    k = min(BLOCKS, -(-n // size))
    bounds = both.select(F.percentile_approx(F.greatest("lo_a", "lo_b"), [i / k for i in range(1, k)], 100 * k)).first()[0]
    groups = first.select("g", block_of(F.col("lo"), bounds).alias("block"))
    x = both.select("o", "g_a", "g_b", "node_a", "node_b", block_of(F.col("lo_a"), bounds).alias("block"), block_of(F.col("lo_b"), bounds).alias("other"))
    x = x.withColumn("block", F.when(F.col("block") == F.col("other"), F.col("block"))).drop("other")
    place = F.row_number().over(Window.partitionBy("block").orderBy("o"))
    inside = x.where("block IS NOT NULL").withColumn("place", place).withColumn("block", F.when(F.col("place") <= 2 * size, F.col("block"))).drop("place")
    x = written(x.where("block IS NULL").unionByName(inside), made)
    waiting = x.where("block IS NULL")
    bars = waiting.select(F.col("g_a").alias("g"), "o").union(waiting.select("g_b", "o")).groupBy("g").agg(F.min("o").alias("bar"))
    return x, groups.join(bars, "g", "left")


def contracted(links: DataFrame, groups: DataFrame, texts: DataFrame, rule: Callable[[pd.DataFrame], Callable[[int, int, int, int], bool]], size: int = LINKS) -> DataFrame:
    """(c, cid): what became of every group that has a link.

    links: o, g_a, g_b (different groups), node_a, node_b. groups: g, lead (a node), at (its rank; of two leaders the lower (at, lead) stays).
    texts: node and whatever the rule reads. rule(rows of texts) gives f(leader of a's group, leader of b's, node_a, node_b) -> whether they join.
    """
    spark, made = links.sparkSession, []
    links = written(links.select("o", "g_a", "g_b", "node_a", "node_b"), made)
    labels = written(links.select(F.col("g_a").alias("c")).union(links.select("g_b")).distinct().withColumn("g", F.col("c")), made)
    groups, texts = groups.select("g", "lead", "at"), cut(texts)

    def decide(_, own: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        held, joins = Groups(facts), rule(facts[facts["node"].notna()])
        own, left = own.sort_values("o"), []
        for o, a, b, i, j in own[["o", "g_a", "g_b", "node_a", "node_b"]].itertuples(index=False):
            x, y = held.root(a), held.root(b)
            if x == y:
                continue
            if held.waits(x, o) or held.waits(y, o):
                held.wait(x, o)
                held.wait(y, o)
                left.append((o, a, b, i, j))
            elif joins(held.leader[x][1], held.leader[y][1], i, j):
                held.join(x, y)
        done = pd.DataFrame([(g, r, held.leader[r][1], held.leader[r][0]) for g in held.up for r in [held.root(g)]], columns=["g", "to", "lead", "at"])
        rest = pd.DataFrame([(o, x, y, i, j) for o, a, b, i, j in left for x, y in [(held.root(a), held.root(b))] if x != y], columns=["o", "g_a", "g_b", "node_a", "node_b"])
        return pd.concat([done, rest]).reindex(columns=["g", "to", "lead", "at", "o", "g_a", "g_b", "node_a", "node_b"]).astype("Int64")

    while n := links.count():
        old = made
        placed, where = dealt(links, n, size, old)
        where = written(where.join(groups, "g"), old)
        own = placed.where("block IS NOT NULL")
        met = own.select("block", F.col("node_a").alias("node")).union(own.select("block", "node_b")).union(where.select("block", F.col("lead").alias("node"))).distinct()
        nothing = [F.lit(None).cast("long").alias(c) for c in ("g", "lead", "at", "bar")]
        facts = where.select("block", "g", "lead", "at", "bar", F.lit(None).cast("long").alias("node"), *(F.lit(None).cast(t).alias(c) for c, t in texts.dtypes if c != "node"))
        facts = facts.union(met.join(texts, "node").select("block", *nothing, "node", *(c for c in texts.columns if c != "node")))
        out = written(own.groupBy("block").cogroup(facts.groupBy("block")).applyInPandas(decide, OUT), old)
        became = out.where("g IS NOT NULL").select("g", "to", "lead", "at")
        waiting = placed.where("block IS NULL").select("o", "g_a", "g_b", "node_a", "node_b")
        for k in ("g_a", "g_b"):
            waiting = waiting.join(became.select(F.col("g").alias(k), F.col("to").alias(f"{k}_to")), k).drop(k).withColumnRenamed(f"{k}_to", k)
        rest = out.where("o IS NOT NULL").select("o", "g_a", "g_b", "node_a", "node_b")
        links = written(rest.unionByName(waiting.where("g_a <> g_b")), made := [])
        groups = written(became.select(F.col("to").alias("g"), "lead", "at").distinct(), made)
        labels = written(labels.join(became.select("g", "to"), "g", "left").select("c", F.coalesce("to", "g").alias("g")), made)
        dropped(spark, old)
    return labels.select("c", F.col("g").alias("cid"))

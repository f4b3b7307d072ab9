"""The mix itself: targets by plain water filling, exact draws, equal shards, and no word twice in a copy."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import mixing
from feedloom.llm.common import table

SF = "/root/testdata/sf0.001"


def filled(sizes: dict) -> dict:
    """Sources by code point, null last, weigh 5, 2, 1, repeating, and share 150 % by weight; what is over twice a size is shared again."""
    names = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, rest = {}, set(names), 1.5 * sum(sizes.values())
    while left:
        level = rest / sum(weight[s] for s in left)
        full = {s for s in left if weight[s] * level >= 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in left}
        out |= {s: 2.0 * sizes[s] for s in full}
        rest -= sum(2.0 * sizes[s] for s in full)
        left -= full
    return out


@pytest.mark.parametrize("kind", ["long", "string"])
def test_targets_and_takings(spark, kind):
    rows = [(k, "w " * (k * 7 % 90), f"s{k % 7}" if k % 11 else None) for k in range(300)] + [(None, "a b", "s1"), (5, "c", "é"), (5, "d e f", "𝔸"), (6, None, "empty"), (7, " \n ", "empty")]
    rows += [(400 + k, "x y z\x0bq " * 3000, "s0") for k in range(2)] + rows[:20]
    rows = [(None if i is None else i if kind == "long" else f"d{i}", t, s) for i, t, s in rows]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string, source string").withColumn("target", F.lit("x")).withColumn("size", F.lit(0))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = filled(dict(sizes))
    got = mixing.taken(df, shards=5).collect()
    assert sorted((repr(r["doc_id"]), r["size"]) for r in got) == sorted((repr(i), size(t)) for i, t, _ in rows)
    took = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]], abs=1e-6) and 0 <= r["taken"] <= 2 * r["size"]
        took[r["source"]] += r["taken"]
    assert all(abs(took[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    again = mixing.taken(df.repartition(7), shards=5).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_mixed_deals_what_is_taken(spark):
    docs = table(spark, SF, "documents")
    got = mixing.mixed(docs, shards=7).toPandas()
    taken = mixing.taken(docs, shards=3).toPandas().set_index("doc_id")
    words = (got["end"] - got["begin"]).groupby(got["doc_id"]).sum()
    assert taken["taken"][taken["taken"] > 0].sort_index().tolist() == words.sort_index().tolist()
    per = got.groupby("shard").size()
    assert len(per) == 7 and per.max() - per.min() <= 1
    assert not got.duplicated(["doc_id", "copy", "begin"]).any()
    in_order = got.sort_values(["doc_id", "copy", "begin"])
    before = in_order.groupby(["doc_id", "copy"])["end"].shift()
    assert (before.isna() | (in_order["begin"] >= before)).all()
    assert (got["end"] <= got["doc_id"].map(taken["size"])).all()
    for _, s in got.groupby("shard"):
        assert s["place"].is_monotonic_increasing


def test_shards_share_all_quotas():
    quotas = [500, 0, 3, 1, 211, 64]
    for shards in (1, 2, 5, 16):
        runs = [mixing.shard_quotas(quotas, shards, k, "x") for k in range(shards)]
        sizes = [sum(b - a for _, a, b in r) for r in runs]
        assert max(sizes) - min(sizes) <= 1
        held = collections.defaultdict(list)
        for r in runs:
            for s, a, b in r:
                held[s].append((a, b))
        for s, q in enumerate(quotas):
            ends = sorted(held[s])
            assert [a for a, _ in ends] == [0, *(b for _, b in ends)][: len(ends)] and (ends[-1][1] if ends else 0) == q
    # shares of the first of two shards follow the hypergeometric law
    firsts = [sum(b - a for s, a, b in mixing.shard_quotas([6, 10], 2, 0, f"k{i}") if s == 0) for i in range(4000)]
    for k in range(7):
        p = math.comb(6, k) * math.comb(10, 8 - k) / math.comb(16, 8)
        assert abs(firsts.count(k) / 4000 - p) < 0.03


def test_large_draws_are_exact():
    u = (np.arange(20_000) + 0.5) / 20_000
    for good, bad, n in ((30, 50, 20), (3, 100, 90), (500, 7, 400)):
        got = np.bincount([mixing.inverted(good, bad, n, x) for x in u], minlength=min(good, n) + 1) / len(u)
        want = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(min(good, n) + 1)]
        assert abs(got - want).max() < 1e-4
    assert abs(mixing.inverted(10**12, 3 * 10**12, 10**12, 0.5) - 250 * 10**9) <= 1
    assert mixing.draw(10**11, 10**11, 2 * 10**11, "a") == 10**11


def test_every_block_stands_where_the_plain_tree_puts_it(spark):
    """All 64 shards of a table walked in plain Python: each block's shard, and each document's shards and digest."""
    docs = table(spark, SF, "documents")
    rows, sources, b = mixing.ordered(docs)
    sources, blocks = sources.orderBy("sid").collect(), b.collect()
    quotas = [r["copies"] * r["blocks"] + r["extra"] for r in sources]
    shard_of = {}
    for k in range(mixing.SHARDS):
        for sid, begin, end in mixing.shard_quotas(quotas, mixing.SHARDS, k, "11"):
            for j in range(begin, end):
                assert shard_of.setdefault((sid, j), k) == k
    want = collections.Counter()
    for x in blocks:
        s = sources[x["sid"]]
        for copy in range(s["copies"] + 1):
            n = x["end"] - x["begin"] if copy < s["copies"] else x["more"]
            if n > 0:
                want[x["row"], copy, x["begin"], x["begin"] + n, shard_of[x["sid"], copy * s["blocks"] + x["idx"]]] += 1
    dealt = mixing.dealt(spark.createDataFrame(sources), spark.createDataFrame(blocks))
    assert collections.Counter((r["row"], r["copy"], r["begin"], r["end"], r["shard"]) for r in dealt.collect()) == want
    assert len({w[4] for w in want}) > 60
    mixed = mixing.mixed(docs)
    run = F.xxhash64("shard", "place", "copy", "begin", "end")
    by_doc = mixed.groupBy("doc_id").agg(F.countDistinct("shard").alias("n_shards"), F.lower(F.lpad(F.hex(F.bit_xor(run)), 16, "0")).alias("runs"))
    got = mixing.taken(docs).where("taken > 0").select("doc_id", "n_shards", "runs")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, by_doc.collect())) and got.agg(F.max("n_shards")).first()[0] > 1

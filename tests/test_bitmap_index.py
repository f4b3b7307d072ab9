"""The index against the plain evaluation, on twenty queries; and what is compared with texts."""

import random

import pytest
from pyspark.sql import functions as F

from feedloom.functions.feed_query import FeedQuery
from feedloom.operators import bitmap_index as B

SCHEMA = "ord long, source string, lang string, pub long, seen long, cats array<string>, plats array<string>, stores array<string>, works array<string>, deal boolean, originals int, is_read boolean, hay string"
NOW = 30 * 86400


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(6)
    pick = lambda names, n: rng.sample(names, rng.randint(0, n))
    words = ["film", "セール", "alpha", "ab", "x", "festival", "recipe", "感想", "a b"]
    rows = [(o, f"s{o % 3}", rng.choice(["ja", "en", None]), rng.choice([None, rng.randint(0, NOW)]), rng.randint(0, NOW), pick(["sale", "event", "law"], 2), rng.choice([None, pick(["p", "q"], 2)]), pick(["alpha", "beta"], 2), pick(["w", "v"], 1), rng.random() < 0.5, rng.randint(0, 1), rng.random() < 0.3, rng.choice([None, "", " ".join(pick(words, 5))])) for o in range(300)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def index(items, tmp_path_factory):
    return B.build(items, str(tmp_path_factory.mktemp("index") / "i"))


URLS = ["", "?lang=all", "?q=film&lang=all", "?q=film+-alpha", "?q=ab&lang=all", "?q=x+セール&lang=all", "?cat=sale&lang=all", "?cat=sale,event&plat=p&lang=all", "?store=beta&lang=all&period=7d", "?deal=1&lang=en"]
URLS += ["?period=24h&lang=all", "?work=w&lang=all", "?new=1&lang=all", "?q=fes+tival&lang=all", "?q=nothing+here&lang=all", "?q=-x&lang=all", "?plat=q&q=感想&lang=all", "?cat=law", "?q=a+b&lang=all", "?q=せーる&lang=all&store=alpha,beta"]
PREFS = [{}, {"hidden_topics": frozenset({"law"})}, {"mute": ("ＲＥＣＩＰＥ", "ab")}, {"hide_read": True, "multi_only": True}, {"hidden_sources": frozenset({"s1"}), "only_follow": True, "follow": ("v", "w")}]


@pytest.mark.parametrize("k", range(20))
def test_twenty_queries(spark, items, index, k):
    q = FeedQuery.from_url(URLS[k], **PREFS[k % 5])
    visit = NOW // 2
    assert sorted(map(tuple, index.counted(q, NOW, visit).collect())) == sorted(map(tuple, q.counted(items, NOW, visit).where("value IS NOT NULL").collect()))
    assert sorted(r["ord"] for r in index.shown(q, NOW, visit).collect()) == sorted(r["ord"] for r in q.apply(items, NOW, visit).collect())


def test_only_candidates_are_compared(items, index):
    assert index.compared("nosuchword").count() == 0
    held = items.where(F.contains("hay", F.lit("festival"))).count()
    got = index.compared("festival")
    assert got.count() == held == got.where("found").count() > 0
    assert index.compared("ab").count() == items.count()


def test_empty(spark, items, tmp_path):
    index = B.build(items.limit(0), str(tmp_path / "i"))
    assert index.counted(FeedQuery.from_url("?q=film"), NOW).collect() == [] and index.shown(FeedQuery(), NOW).collect() == []


def test_rows_dealt_by_bucket_are_not_shuffled_again(spark):
    from feedloom.operators import bitmap_index as B

    x = spark.range(100_000).withColumn("bucket", B.bucket("id")).repartition(9, "bucket").selectExpr("id", "bucket", "cast(id % 7 AS string) AS value")
    bits = B.bits_of(x, "value")
    assert bits._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert bits.selectExpr("sum(bitmap_count(bits))").first()[0] == 100_000 and bits.rdd.getNumPartitions() == 9

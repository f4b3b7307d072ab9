"""What a run publishes: counts by feed and in all, names by their most frequent spelling, and the pages of names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cutting import cut
from ..functions.ruleset import RuleSet
from ..functions.search import compatible

LEAST_ITEMS = 2
#: Fixed value: what an address does not hold.
NOT_IN_SLUG = r"""[/?#%&:*"<>|\s.,!！?？'’`^~{}\[\]()（）【】「」『』〈〉]+"""


def run_report(registry: DataFrame, archive: DataFrame, accepted: DataFrame) -> DataFrame:
    """feed, archived, accepted, in the order of the registry (feed, place)."""
    count = lambda df, name: df.groupBy("feed").agg(F.count(F.lit(1)).alias(name))
    out = registry.join(count(archive, "archived"), "feed", "left").join(count(accepted, "accepted"), "feed", "left")
    return out.select("feed", "place", F.coalesce("archived", F.lit(0)).alias("archived"), F.coalesce("accepted", F.lit(0)).alias("accepted")).orderBy("place")


def run_totals(accepted: DataFrame) -> DataFrame:
    """accepted, shown (groups of one language and norm), merged, reposts (syndicated) and reposts_left (groups of reposts alone)."""
    groups = accepted.groupBy("lang", "norm").agg(F.count(F.lit(1)).alias("n"), F.count_if("syndicated").alias("s"))
    nil = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return groups.agg(nil(F.sum("n")).alias("accepted"), F.count(F.lit(1)).alias("shown"), nil(F.sum(F.col("n") - 1)).alias("merged"), nil(F.sum("s")).alias("reposts"), F.count_if(F.col("n") == F.col("s")).alias("reposts_left"))


def in_feeds(items: DataFrame) -> DataFrame:
    """items once for each feed that has them, named in `feed`: all, one a category, one a platform, deals, one a store (but for those that the rules call other)."""
    none = F.array().cast("array<string>")
    below = lambda head, c: F.transform(F.coalesce(c, none), lambda v: F.concat(F.lit(head), v))
    stores = F.when(F.col("deal").isNotNull(), F.concat(F.array(F.lit("all")), F.filter("deal.stores", lambda v: v != "other")))
    return items.withColumn("feed", F.explode(F.concat(F.array(F.lit("all")), below("category/", F.col("cats")), below("platform/", F.col("plats")), below("deal/", stores))))


def display_names(items: DataFrame, rules: RuleSet) -> DataFrame:
    """work, shown: of all spellings with one key the most frequent; ties: the shorter, then the one met first."""
    each = items.select("ord", F.posexplode("works").alias("pos", "work")).groupBy("work").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "pos")).alias("at"))
    each = each.withColumn("key", rules.work_key(F.col("work")))
    best = each.groupBy("key").agg(F.min_by("work", F.struct(-F.col("n"), F.length("work"), "at")).alias("shown"))
    return each.join(best, "key").select("work", "shown")


def with_display_names(items: DataFrame, rules: RuleSet) -> DataFrame:
    """items (ord unique) with every name of `works` replaced by the one shown for it; order stays, no name twice. Items are read three times, so their lineage is cut."""
    items = cut(items)
    each = items.select("ord", F.posexplode("works").alias("pos", "work")).join(display_names(items, rules), "work")
    shown = each.groupBy("ord").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"])).alias("named"))
    return items.join(shown, "ord", "left").withColumn("works", F.coalesce("named", F.array().cast("array<string>"))).drop("named")


def base_slug(name: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(compatible(name), NOT_IN_SLUG, "-"), "-+", "-")
    s = F.regexp_replace(s, r"^-|-\z", "")
    return F.when(s == "", "work").otherwise(s)


def in_ranges(rows: DataFrame, *by: Column | str) -> DataFrame:
    """rows with idx, their place (from 0) in the order of `by`: sorted by ranges, each counted on from those before it, so that no task sorts all. One row a range goes through one task."""
    x = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("id", F.monotonically_increasing_id()))
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = x.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("many"))
    before = F.coalesce(F.sum("many").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("part", part).join(F.broadcast(sizes.select("part", before.alias("before"))), "part").withColumn("idx", F.col("before") + place).drop("id", "part", "before")


def _number(pdf: pd.DataFrame) -> pd.DataFrame:
    used: set[str] = set()
    free: dict[str, int] = {}  # the lowest number of a base that may still be free
    pdf, out = pdf.sort_values("place"), []
    for base in pdf["base"]:
        slug, n = base, free.get(base, 2)
        while slug in used:
            slug, n = f"{base}-{n}", n + 1
        free[base] = n
        used.add(slug)
        out.append(slug)
    return pdf.assign(slug=out)[["name", "n", "place", "slug"]]


def work_pages(items: DataFrame) -> DataFrame:
    """name, n, place, slug of every name with LEAST_ITEMS items or more: by items, then by Japanese collation.

    An address that is taken gets the next free number. Names of one base are numbered by their place among them, without a task for each base. Only
    addresses that are equal but for numbers at their end can be in each other's way; where such a family has several bases, it is
    numbered in a group of its own.
    """
    names = items.select(F.explode("works").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_ITEMS)
    ranked = in_ranges(names, F.desc("n"), F.collate("name", "ja"), F.col("name")).select("name", "n", (F.col("idx") + 1).alias("place"), base_slug(F.col("name")).alias("base"))
    ranked = cut(ranked.withColumn("family", F.regexp_replace("base", r"(?:-[0-9]+)+\z", "")))
    several = ranked.groupBy("family").agg((F.min("base") < F.max("base")).alias("several"))
    ranked = ranked.join(several, "family")
    alone = in_ranges(ranked.where("NOT several").select("name", "n", "place", "base"), "base", "place")
    firsts = alone.groupBy("base").agg(F.min("idx").alias("first"))
    k = F.col("idx") - F.col("first") + 1
    alone = alone.join(firsts, "base").select("name", "n", "place", F.when(k == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), k.cast("string"))).alias("slug"))
    return alone.unionByName(ranked.where("several").groupBy("family").applyInPandas(_number, "name string, n long, place long, slug string"))

"""An index of items for interactive queries: bitmaps of facet values and of character trigrams, in buckets of row numbers.

build() numbers the items and writes three tables: bitmaps (facet, value, bucket, bits), narrow columns, and search texts by bucket. A trigram
is one more facet, so that a posting list is a bitmap too. Facet counts come from bitmaps alone: a facet's values meet the
conjunction of all terms but its own; what is hidden, muted or excluded is one union, whose part is taken off the count. No text is read for that but by words.

A word of three characters or more is sought where all its trigrams stand: the conjunction of their bitmaps names the candidates, and only
these are compared with their texts, bucket by bucket; buckets without candidates are not read. Shorter words are compared with all texts.
Bitmaps have 4,096 bytes for 32,768 rows, so work grows with the rows by an eighth of a byte a term.

Null flags and times fail a term, null or empty texts hold no word; an item's repeated values count once; an empty table gives no counts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.feed_query import FeedQuery
from ..functions.search import normal

#: Characters of a gram.
GRAM = 3
FACETS = {"cat": ("cat",), "plat": ("plat",), "lang": ("lang",), "deal": ("deal", "store"), "store": ("store",)}
NARROW = ("id", "ord", "source", "lang", "pub", "seen", "cats", "plats", "stores", "works", "deal", "originals", "is_read")


def bucket(c: str | Column) -> Column:
    return F.bitmap_bucket_number(c).alias("bucket")


def bits_of(ids: DataFrame, *keys: str) -> DataFrame:
    """keys, bucket, bits: the bitmap of the column id. Rows that have their bucket and are dealt by it are not shuffled again."""
    return ids.groupBy(*keys, "bucket" if "bucket" in ids.columns else bucket("id")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def all_of(terms: list[DataFrame]) -> DataFrame:
    """bucket, bits: rows in every one of the bitmaps (bucket, bits)."""
    both = reduce(DataFrame.union, (t.select("bucket", "bits") for t in terms)).groupBy("bucket")
    return both.agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(terms)).drop("n")


def any_of(terms: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, (t.select("bucket", "bits") for t in terms)).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def has_bit(bits: str, i: str) -> Column:
    """Whether the row with number i is in the bitmap."""
    return F.expr(f"shiftright(cast(conv(hex(substring({bits}, cast(bitmap_bit_position({i}) div 8 + 1 AS int), 1)), 16, 10) AS int), cast(bitmap_bit_position({i}) % 8 AS int)) % 2 = 1")


def build(items: DataFrame, path: str) -> Index:
    """The index of interactive items (feed_query.interactive, with is_read), written under a path in shared storage."""
    spark = items.sparkSession
    missing = [c for c in NARROW if c not in items.columns and c != "id"]
    if missing:
        raise ValueError(f"items lack {missing}")
    items.withColumn("id", F.monotonically_increasing_id() + 1).select(*NARROW, "hay").write.parquet(f"{path}/items")
    x = spark.read.parquet(f"{path}/items")
    # a bucket's rows go through one task, and a task has few buckets, so that what it sorts does not grow with the table
    many = x.select(bucket("id")).distinct().count()
    x = x.withColumn("bucket", bucket("id")).repartition(2 * many + 1, "bucket")
    x.select("id", "hay", "bucket").write.partitionBy("bucket").parquet(f"{path}/texts")
    none, deal = F.array().cast("array<string>"), F.coalesce("deal", F.lit(False))
    values = {"cat": F.coalesce("cats", none), "plat": F.coalesce("plats", none), "lang": F.array("lang"), "deal": F.when(deal, F.array(F.lit("deal"))).otherwise(none), "store": F.when(deal, F.coalesce("stores", none)).otherwise(none), "all": F.array(F.lit(""))}
    named = lambda facet: lambda e: F.struct(F.lit(facet).alias("facet"), e.alias("value"))
    each = [F.transform(v, named(f)) for f, v in values.items()]
    rows = x.select("id", "bucket", F.explode(F.concat(*each)).alias("x")).select("id", "bucket", "x.facet", "x.value").where("value IS NOT NULL")
    bits_of(rows, "facet", "value").write.parquet(f"{path}/bitmaps")
    chars = F.split("hay", "")
    grams = F.when(F.length("hay") >= GRAM, F.array_distinct(F.arrays_zip(*(F.slice(chars, F.lit(k + 1), F.length("hay") - GRAM + 1).alias(f"c{k}") for k in range(GRAM)))))
    rows = x.select("id", "bucket", F.explode(grams).alias("g")).select("id", "bucket", F.concat(*(F.col(f"g.c{k}") for k in range(GRAM))).alias("value"))
    bits_of(rows, "value").write.parquet(f"{path}/grams")
    return Index(spark, path)


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str

    def read(self, name: str) -> DataFrame:
        reader = self.spark.read.schema("id long, hay string, bucket long") if name == "texts" else self.spark.read  # a table by buckets may have no file
        return reader.parquet(f"{self.path}/{name}")

    def value(self, facet: str, values) -> DataFrame:
        """bucket, bits: rows with any of the values."""
        return any_of([self.read("bitmaps").where((F.col("facet") == facet) & F.col("value").isin(sorted(values)))])

    def candidates(self, word: str) -> DataFrame:
        """bucket, bits: rows that hold all trigrams of a word; all rows if it has none."""
        grams = sorted({word[i : i + GRAM] for i in range(len(word) - GRAM + 1)})
        if not grams:
            return self.value("all", [""])
        x = self.read("grams").where(F.col("value").isin(grams)).groupBy("bucket")
        return x.agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)).drop("n")

    def compared(self, word: str) -> DataFrame:
        """id, found: the candidates of a word, and whether their text holds it. The texts' bucket is their partition."""
        return self.read("texts").join(self.candidates(word), "bucket").where(has_bit("bits", "id")).select("id", F.contains("hay", F.lit(word)).alias("found"))

    def holds(self, word: str) -> DataFrame:
        return bits_of(self.compared(normal(word)).where("found").select("id"))

    def terms(self, q: FeedQuery, now: int, visit: int = 0) -> tuple[dict[str, DataFrame], list[DataFrame]]:
        """(bitmaps of what must hold, by term; bitmaps of what must not)."""
        wanted, words = {}, normal(q.q).split()
        stored = {"cat": ("cat", q.cat), "plat": ("plat", q.plat), "store": ("store", q.store), "lang": ("lang", [q.lang]), "deal": ("deal", ["deal"])}
        for name, condition in q.terms(now, visit).items():
            if name in stored:
                wanted[name] = self.value(*stored[name])
            elif not name.startswith("text"):
                wanted[name] = bits_of(self.read("items").where(F.coalesce(condition, F.lit(False))).select("id"))
        without = [w[1:] for w in words if w.startswith("-") and len(w) > 1]
        for i, w in enumerate(w for w in words if not (w.startswith("-") and len(w) > 1)):
            wanted[f"text{i}"] = self.holds(w)
        against = [self.holds(w) for w in (*without, *q.mute)] + ([self.value("cat", q.hidden_topics)] if q.hidden_topics else [])
        return wanted, against

    def counted(self, q: FeedQuery, now: int, visit: int = 0) -> DataFrame:
        """facet, value, n as FeedQuery.counted() gives them."""
        wanted, against = self.terms(q, now, visit)
        every = self.value("all", [""])
        gone = any_of(against) if against else None
        out = []
        for facet, own in FACETS.items():
            passed = [t for k, t in wanted.items() if k not in own]
            passing = all_of(passed) if passed else every
            values = self.read("bitmaps").where(F.col("facet") == facet).join(passing.withColumnRenamed("bits", "passing"), "bucket")
            bits = [F.col("bits"), F.col("passing")]
            n = self.overlap(values.select("facet", "value", "bucket", F.array(*bits).alias("all")), 1)
            if gone is not None:
                both = values.join(gone.withColumnRenamed("bits", "gone"), "bucket")
                n = n.union(self.overlap(both.select("facet", "value", "bucket", F.array(*bits, F.col("gone")).alias("all")), -1))
            out.append(n)
        return reduce(DataFrame.union, out).groupBy("facet", "value").agg(F.sum("n").alias("n")).where("n > 0")

    @staticmethod
    def overlap(rows: DataFrame, sign: int) -> DataFrame:
        """facet, value, n: the bits that all bitmaps of a row have in common."""
        both = rows.select("facet", "value", "bucket", F.explode("all").alias("bits")).groupBy("facet", "value", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
        return both.select("facet", "value", (sign * F.bitmap_count("bits")).alias("n"))

    def shown(self, q: FeedQuery, now: int, visit: int = 0) -> DataFrame:
        """ord of the items that a query shows."""
        wanted, against = self.terms(q, now, visit)
        passing = all_of(list(wanted.values())) if wanted else self.value("all", [""])
        x = self.read("items").select("id", "ord", bucket("id")).join(passing, "bucket").where(has_bit("bits", "id")).select("id", "ord", "bucket")
        if against:
            x = x.join(any_of(against), "bucket", "left").where(F.col("bits").isNull() | ~has_bit("bits", "id"))
        return x.select("ord")

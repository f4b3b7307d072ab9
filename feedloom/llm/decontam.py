"""Benchmark decontamination by a prefix-filtered set join, with DataFrame functions only.

A window is ITEM_WORDS consecutive words of an item (a shorter item is one window). Seen as the set of its five-word
shingles (of itself, if it has fewer words), a window stands in a text only if every shingle does: the containment
threshold is 1, so a prefix of one shingle is necessary, and the best is the rarest. Shingles are ordered by rarity: their
count over all documents, then a hash. Only prefix shingles are joined with the documents' shingles. A pair gives the only place
at which the window can stand; positional bounds (not before the text's start) and length bounds (not beyond its end) come
next, then all words of the window are compared, so hashes decide nothing.

A text is split once a pass, its words are hashed once, and the hashes of its shingles are made from those of shorter ones; words
are cut out only where a prefix shingle was met. The join is one stage of generated code with the expansion into places, which holds
only functions that compile (no lambda), so that a place is a row only if it is hit. There are two passes: one counts, one joins. The benchmark side is broadcast in
blocks of at most BLOCK_BYTES, by a hash of the shingle, one pass over the documents for each; documents are never broadcast.
Every row of documents also meets one marker, so rows without a hit need no join back. Places that are hit, and windows that
occur, are kept apart, so that a window of many items multiplies no places.

Edge cases: rows are told apart by a number of their own, so null and repeated doc_ids are separate documents; null or empty
texts have no words and no hits; null item ids are named "null"; items without a word have no window; copies of an item are
each reported. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, few_rows, fresh, numbered, stored

ITEM_WORDS, SHINGLE = 10, 5
BLOCK_BYTES = 64 << 20
#: The token that every row of documents has.
MARKER = 0
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text: Column) -> Column:
    """A-Z lowered, and nothing else; where all is ASCII, that is what lower() does."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(low(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def hashed(df: DataFrame, widths: list[int]) -> DataFrame:
    """df (with words w) with n, and with the hashes of all shingles of each width in s1, s2, ... by place."""
    pair = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    part = lambda c, begin, width: F.slice(c, begin, F.greatest(F.col("n") - (width - 1), F.lit(0)))
    made_of = {2: ("s1", "s1"), 3: ("s2", "s1"), 4: ("s2", "s2"), 5: ("s4", "s1")}
    need = set(widths)
    for k in (5, 4, 3, 2):
        if k in need:
            need |= {int(c[1]) for c in made_of[k]}
    # one column a step: each is used more than once, so that no step is put into the next
    df = df.withColumn("s1", F.transform("w", lambda x: F.xxhash64(x))).withColumn("n", F.size("s1"))
    for k in sorted(need - {1}):
        a, b = made_of[k]
        df = df.withColumn(f"s{k}", pair(part(a, 1, k), part(b, 1 + int(a[1]), k)))
    return df


def windows(items: DataFrame) -> DataFrame:
    """item_id and words (lowered) of each of an item's windows."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - ITEM_WORDS))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, ITEM_WORDS))).alias("win")).distinct()


def shingles(wins: DataFrame) -> DataFrame:
    """wid, win, width, at, token: all shingles of every window."""
    width = F.least(F.size("win"), F.lit(SHINGLE))
    x = hashed(wins.select("wid", "win", width.alias("width"), F.col("win").alias("w")), list(range(1, SHINGLE + 1)))
    tokens = F.coalesce(*(F.when(F.col("width") == k, F.col(f"s{k}")) for k in range(1, SHINGLE + 1)))
    return x.select("wid", "win", "width", F.posexplode(tokens).alias("at", "token"))


def occurrences(docs: DataFrame, widths: list[int], marker: bool = False) -> DataFrame:
    """docs (row, w, ...) with every shingle: its place among all (i), and its token. The hashes of each width follow each other."""
    lists = [F.col(f"s{k}") for k in widths]
    first = F.array(F.lit(MARKER).cast("long")) if marker else F.array().cast("array<bigint>")
    df = hashed(docs, widths)
    return df.select(*docs.columns, "n", F.posexplode(F.concat(first, *lists)).alias("i", "token"))


def place(widths: list[int], marker: bool) -> Column:
    """The word at which shingle i begins."""
    before, out = F.lit(int(marker)), None
    for k in widths:
        here = F.when(F.col("width") == k, F.col("i") - before)
        out, before = here if out is None else F.coalesce(out, here), before + F.greatest(F.col("n") - (k - 1), F.lit(0))
    return out


def in_blocks(df: DataFrame) -> list[DataFrame]:
    """df in parts of at most BLOCK_BYTES (by their mean), by a hash of the token; to be broadcast."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("b")).first()["b"] or 0
    parts = 1 + 2 * size // BLOCK_BYTES
    return [df] if parts == 1 else [df.where(F.pmod(F.xxhash64(F.lit(3), "token"), F.lit(parts)) == i) for i in range(parts)]


def hits(docs: DataFrame, items: DataFrame, made: list[str], marker: bool = False) -> tuple[DataFrame, DataFrame]:
    """(row, the other columns of docs, n (words), start, end, wid: every place of every window, with a marker also one of wid -1 a row; wid, item_id). docs: row, text, ..."""
    spark = docs.sparkSession
    named = stored(windows(items), made)
    named = stored(named.join(named.select("win").distinct().withColumn("wid", F.monotonically_increasing_id()), "win"), made)
    every = stored(shingles(named.select("wid", "win").distinct()), old := [])
    widths = sorted(r[0] for r in every.select("width").distinct().collect())
    split = docs.select(*(c for c in docs.columns if c != "text"), words(F.col("text")).alias("w"))
    # rarity of shingles, over all documents; a task sends one row a shingle of the benchmark
    tokens = every.select("token").distinct()
    parts = [occurrences(split.select("w"), widths).select("token").join(F.broadcast(b), "token").groupBy("token").agg(F.count(F.lit(1)).alias("met")) for b in in_blocks(tokens)] if widths else []
    ranked = every.withColumn("met", F.lit(0)) if not parts else every.join(stored(reduce(DataFrame.union, parts), old), "token", "left")
    order = Window.partitionBy("wid").orderBy(F.coalesce("met", F.lit(0)), "token", "at")
    prefix = ranked.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("token", "width", "at", "wid", "win")
    if marker:
        prefix = prefix.union(spark.range(1).select(F.lit(MARKER).cast("long"), F.lit(0), F.lit(0), F.lit(-1).cast("long"), F.array().cast("array<string>")))
    prefix = stored(prefix, old)
    begin = place(widths, marker) - F.col("at") if widths else F.lit(0)
    keep = [c for c in split.columns if c != "w"]
    found = []
    for block in in_blocks(prefix):
        x = occurrences(split, widths, marker).join(F.broadcast(block), "token")
        x = x.withColumn("start", F.when(F.col("wid") < 0, 0).otherwise(begin)).withColumn("end", F.col("start") + F.size("win"))
        x = x.where((F.col("start") >= 0) & (F.col("end") <= F.col("n"))).where((F.col("wid") < 0) & (F.col("i") == 0) | (F.col("wid") >= 0) & (F.slice("w", F.col("start") + 1, F.size("win")) == F.col("win")))
        found.append(x.select(*keep, "n", "start", "end", "wid"))
    out = stored(reduce(DataFrame.union, found), made)
    discard(spark, old)
    return out, named.select("wid", "item_id")


def scan(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    found, named = hits(rows, items, [], marker=True)
    real = found.where("wid >= 0")
    spans = real.select("row", "start", "end").distinct()
    before = F.max("end").over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    covered = spans.select("row", new.alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    met = real.select("row", "wid").distinct().join(named, "wid").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    got = covered.join(met, "row").select("row", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    out = found.where("wid < 0").join(got, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", F.col("n").cast("long").alias("n_words"), zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce(F.col("n_hit"), F.lit(0)) > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents, all their columns, in which no window stands."""
    row = fresh(docs, "row")
    every = numbered(docs, row, [])
    found, _ = hits(every.select(F.col(row).alias("row"), "text"), items, made := [])
    bad = stored(found.select("row").distinct())
    discard(docs.sparkSession, made)
    return every.join(few_rows(bad, "row").withColumnRenamed("row", row), row, "left_anti").select(*docs.columns)

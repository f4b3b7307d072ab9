"""The first of the longer texts that a text begins, within a time, without pairs of texts.

Whole texts are cut to the lengths that texts with the same first characters have, so that both sides meet on equal keys. Within a key and a slot of
time as wide as the limit, three running minima give the answer: over the slot before from the earliest moment on, over the own slot, and over the
next up to the latest moment. Rows grow with the whole texts and the number of different lengths that begin alike, never with pairs.
A key that very many texts share is spread over its slots. Parts and keys of whole texts are kept once; texts are read once a side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cutting import cut

def first_longer(parts: DataFrame, wholes: DataFrame, width: int, least: int) -> DataFrame:
    """(b, a): of each part (b, lang, text, pub) the lowest a of wholes (a, lang, text, pub) that are longer, begin with it, and lie at most `width` apart; an unknown time is near to all. Parts of fewer than `least` characters have none."""
    head, n, key = F.substring("text", 1, least).alias("head"), F.length("text").alias("n"), lambda e: F.unhex(F.sha2(e, 256)).alias("key")
    parts = cut(parts.select("b", "lang", "text", "pub", n).where(F.col("n") >= least).select("b", "lang", head, "n", key(F.col("text")), "pub"))
    lengths = parts.groupBy("lang", "head").agg(F.collect_set("n").alias("lengths"))
    w = wholes.select("a", "lang", "text", "pub", n, head).where(F.col("n") > least).join(lengths, ["lang", "head"])
    w = w.select("a", "lang", "text", "pub", F.explode(F.expr("filter(lengths, k -> k < n)")).alias("k"))
    w = w.select("a", "lang", key(F.expr("substring(text, 1, k)")), "pub")
    w = cut(w.groupBy("lang", "key", "pub").agg(F.min("a").alias("a")))
    # whatever has no time is looked up by key alone
    every = w.groupBy("lang", "key").agg(F.min("a").alias("any"), F.min(F.when(F.col("pub").isNull(), F.col("a"))).alias("undated"))
    by_key = parts.join(every, ["lang", "key"]).select("b", F.when(F.col("pub").isNull(), F.col("any")).otherwise(F.col("undated")).alias("a"))
    at = F.explode(F.array(*(F.struct(F.lit(k).alias("look"), (F.col("pub") + d).alias("at")) for k, d in (("up", width), ("all", 0), ("down", -width)))))
    asked = parts.where("pub IS NOT NULL").select("b", "lang", "key", at.alias("x")).select("b", "lang", "key", "x.look", "x.at")
    rows = w.where("pub IS NOT NULL").select(F.lit(None).cast(dict(parts.dtypes)["b"]).alias("b"), "lang", "key", F.lit(None).cast("string").alias("look"), F.col("pub").alias("at"), "a")
    rows = rows.unionByName(asked.withColumn("a", F.lit(None).cast(dict(w.dtypes)["a"]))).withColumn("slot", F.floor(F.col("at") / width))
    slot = Window.partitionBy("lang", "key", "slot")
    running = lambda order: F.min("a").over(slot.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    met = F.when(F.col("look") == "up", running(F.col("at"))).when(F.col("look") == "down", running(F.col("at").desc())).otherwise(F.min("a").over(slot))
    found = rows.withColumn("met", met).where("b IS NOT NULL").select("b", F.col("met").alias("a"))
    return found.union(by_key).groupBy("b").agg(F.min("a").alias("a")).where("a IS NOT NULL")

"""Counts for every facet of an interactive query at once: a row counts for a facet if it passes all conditions but the facet's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def facet_counts(items: DataFrame, conditions: dict[str, Column], facets: dict[str, tuple[Column, tuple[str, ...]]]) -> DataFrame:
    """facet, value, n. facets: name -> (array of a row's values, conditions that the facet leaves out).

    One pass: each row says which conditions it misses, becomes one row a value of the facets it counts for, and is counted by a
    single aggregation, combined before its shuffle. Null conditions count as missed, null arrays as empty.
    """
    names = list(conditions)
    x = items.withColumn("missed", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(None)).otherwise(F.lit(k)) for k, c in conditions.items()))) if names else F.array().cast("array<string>"))

    def of(facet: str, values: Column, own: tuple[str, ...]) -> Column:
        rows = F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.cast("string").alias("value")))
        passes = F.size(F.array_except("missed", F.array(*map(F.lit, own)))) == 0 if own else F.size("missed") == 0
        return F.coalesce(F.when(passes, rows), F.array().cast("array<struct<facet:string,value:string>>"))

    each = x.select(F.explode(F.concat(*(of(k, *v) for k, v in facets.items()))).alias("x"))
    return each.groupBy("x.facet", "x.value").agg(F.count(F.lit(1)).alias("n"))

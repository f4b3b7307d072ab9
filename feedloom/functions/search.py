"""Search texts: compatibility form, lower case, hiragana as katakana; what a query is compared with, and suggestions for it."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

HIRAGANA = "".join(map(chr, range(0x3041, 0x3097)))
KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))


@F.pandas_udf(StringType())
def compatible(s: pd.Series) -> pd.Series:
    """Unicode's compatibility composition, which SQL lacks."""
    return s.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def normal(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower().translate(str.maketrans(HIRAGANA, KATAKANA))


def searchable(c: Column) -> Column:
    return F.translate(F.lower(compatible(c)), HIRAGANA, KATAKANA)


def suggest_key(c: Column) -> Column:
    """Without blanks and middle dots, so that names are found however they are written."""
    return F.regexp_replace(searchable(c), r"[\s　・]+", "")


def last_word(query: str) -> str | None:
    """What suggestions are for: the last word of a query; none for an excluded one."""
    words = query.split()
    if not words or words[-1].startswith("-"):
        return None
    return normal(words[-1]).replace("・", "") or None


def suggestions(counted: list[tuple[str, DataFrame]], query: str, limit: int = 8) -> DataFrame:
    """name, kind, n, tier: candidates (name, n) of several kinds that hold the query's last word; those that begin with it first, then by number and name."""
    every = reduce(DataFrame.unionByName, (df.select("name", F.lit(k).alias("kind"), F.lit(i).alias("at"), "n") for i, (k, df) in enumerate(counted)))
    key = last_word(query)
    if key is None:
        return every.select("name", "kind", "n", F.lit(0).alias("tier")).limit(0)
    x = every.withColumn("key", suggest_key(F.col("name"))).where(F.contains("key", F.lit(key)))
    x = x.withColumn("tier", F.when(F.startswith("key", F.lit(key)), 0).otherwise(1))
    return x.orderBy("tier", F.desc("n"), "at", "name").select("name", "kind", "n", "tier").limit(limit)

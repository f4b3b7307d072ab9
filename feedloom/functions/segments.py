"""Words that stay on one line, names for a phrase model, and white space between wide characters. Nulls stay null; lengths are in code points."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDE = "\\u3000-\\u9FFF\\uFF00-\\uFFEF"
BLANKS = " \t\r\n"


def protected_words(text: Column, names=(), units=()) -> Column:
    """array<string>: names, runs of Latin letters and digits with a unit, of katakana, and of ideographs, in order; longer names first."""
    first = lambda words: "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    latin = r"[\p{IsLatin}\p{Nd}][\p{IsLatin}\p{Nd}.,/+-]*" + (f"(?:{first(units)})?" if units else "")
    kinds = [*([first(names)] if names else []), latin, r"[\p{IsKatakana}\u30FC\u30FB]{2,}", r"\p{IsHan}{2,}"]
    return F.regexp_extract_all(text, F.lit("|".join(kinds)), F.lit(0))


def joined_wide(nodes: Column) -> Column:
    """Texts of neighbouring nodes without the white space between two wide characters, also across nodes, however long.

    Runs of blanks and ends of nodes between wide characters are put between marks first; then the blanks between marks go.
    """
    sep, begin, end = "\x01", "\x02", "\x03"
    text = F.regexp_replace(F.array_join(nodes, sep, ""), f"([{WIDE}])([{sep}{BLANKS}]+)(?=[{WIDE}])", f"$1{begin}$2{end}")
    runs = F.transform(F.split(text, begin), lambda p: F.concat(F.when(F.contains(p, F.lit(end)), F.regexp_replace(F.substring_index(p, end, 1), f"[{BLANKS}]", "")).otherwise(""), F.when(F.contains(p, F.lit(end)), F.substring_index(p, end, -1)).otherwise(p)))
    return F.split(F.array_join(runs, ""), sep)


def names_of(items: DataFrame) -> DataFrame:
    """name: the different names of items, of 2 to 24 characters."""
    return items.select(F.explode("works").alias("name")).where(F.length("name").between(2, 24)).distinct()

"""White space and words of headlines as line breaking needs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segments as S
from . import verdict_sql as V
from . import verdicts


def wide_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines with blanks between and around wide characters, in three nodes."""
    x = verdicts.made(spark, sf_dir)
    nodes = F.array(F.concat(F.lit("前 \n"), "title", F.lit(" ")), F.lit("\t 後 ろ a"), F.lit(" 末"))
    return x.select("ord", F.array_join(S.joined_wide(nodes), "|").alias("text"))


def protected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.names_of(verdicts.accepted(spark, sf_dir))


def protected_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays whole in a headline: a name, words and numbers with a unit, runs of katakana and of ideographs."""
    x = verdicts.made(spark, sf_dir)
    return x.select("ord", F.array_join(S.protected_words(F.col("title"), ("続編未定", "グッズ通販"), ("％", "%", "円")), "|").alias("words"))


JOBS = [wide_spaces, protected_names, protected_parts]
W = "[\\x{3000}-\\x{9FFF}\\x{FF00}-\\x{FFEF}]"
ONE = lambda e: f"regexp_replace({e}, '({W}\\x01?)[ \\t\\r\\n]+(\\x01?{W})', '\\1\\2', 'g')"
ORACLES = {
    "protected_parts": f"WITH {verdicts.MADE} SELECT ord, array_to_string(regexp_extract_all(title, '続編未定|グッズ通販|[\\p{{Latin}}\\p{{Nd}}][\\p{{Latin}}\\p{{Nd}}.,/+-]*[％%円]?|[\\p{{Katakana}}ー・][\\p{{Katakana}}ー・]+|\\p{{Han}}\\p{{Han}}+'), '|') AS words FROM made",
    # the white space between two nodes is put before the end of the first, so that one pattern serves; twice, as matches share characters
    "wide_spaces": f"WITH {verdicts.MADE}, x AS (SELECT ord, concat('前 ', chr(10), title, ' ', chr(1), chr(9), ' 後 ろ a', chr(1), ' 末') AS t FROM made), y AS (SELECT ord, {ONE(ONE('t'))} AS t FROM x), z AS (SELECT ord, regexp_replace(t, '({W})[ \\t\\r\\n]*\\x01[ \\t\\r\\n]*({W})', '\\1' || chr(1) || '\\2', 'g') AS t FROM y) SELECT ord, replace(t, chr(1), '|') AS text FROM z",
    "protected_names": f"{V.BASE} SELECT DISTINCT w AS name FROM (SELECT unnest(works) AS w FROM full_ok) u WHERE length(w) BETWEEN 2 AND 24",
}

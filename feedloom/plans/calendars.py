"""Announcements and calendars over texts made from the orders, with DuckDB SQL that works from the numbers in the texts, not the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schedule as S

PUB = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)"
#: Texts by remainder of the key; m is 1 to 13 and d 0 to 32, so that some dates are none.
FORMS = (
    "Out {m} nothing", "x {m}/{d} launch", "2030年{m}月{d}日 starts", "{m}月{d}日まで開催", "{m}月発売", "today ends", "{m}月{d}日（水）まで開催", "{m}月 {d}日発売見送り",
    "{m}月 {d}日発売", "{m}月{d}日に発売された新作", "{m}月{d}日 抽選のあと開催", "{m}月期配信開始", "{m}月{d}日！ 発売", "{m}/{d} とても長い前置きがずっと続くので開催", "{m}月{d}日 開催のち発売", "１９９８年　{m}月{d}日　ＲＥＬＥＡＳＥＤ",
)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", "o_custkey", F.expr(PUB).alias("pub"), (F.col("o_orderkey") % 13 + 1).cast("string").alias("m"), (F.col("o_orderkey") % 33).cast("string").alias("d"))


def _filled(form: str):
    return F.replace(F.replace(F.lit(form), F.lit("{m}"), F.col("m")), F.lit("{d}"), F.col("d"))


def schedule_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    text = F.coalesce(*(F.when(F.col("o_orderkey") % len(FORMS) == i, _filled(f)) for i, f in enumerate(FORMS)))
    x = o.withColumn("text", text).select("o_orderkey", F.explode(S.schedules("text", "pub")).alias("s"))
    return x.select("o_orderkey", "s.date", "s.verb")


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    o = _orders(spark, sf_dir)
    now = o.agg(F.max("pub")).first()[0] or 0
    k, dated = F.col("o_orderkey") % 5, _filled("{m}月{d}日発売")
    work = F.when(k != 2, F.concat(F.lit("A"), (F.col("o_custkey") % 7).cast("string")))
    title = F.when(k == 0, dated).when(k == 1, F.lit("no date here")).when(k == 2, F.concat(dated, F.lit("!"))).when(k == 3, _filled("{m}月開始")).otherwise(F.lit("12月10日まで"))
    summary = F.when(k == 1, _filled("and 2/3 mentioned, {m}月{d}日開催")).when(k == 4, F.lit(None))
    items = o.select(F.col("o_orderkey").alias("ord"), "pub", title.alias("title"), summary.alias("summary"), work.alias("work"), F.coalesce(F.lower(work), title).alias("subject"), (F.col("o_orderkey") * 7 % 5 + 1).alias("sources"), F.when(F.col("o_orderkey") % 9 == 0, "en").otherwise("ja").alias("lang"))
    return S.calendar(items, now), now


def calendar_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir)[0]


def calendar_upcoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the calendar what is still to come on the newest order's day, without what starts."""
    entries, now = _entries(spark, sf_dir)
    today = spark.range(1).select(F.date_format(F.date_from_unix_date(F.lit((now + 9 * 3600) // 86400).cast("int")), "yyyy-MM-dd")).first()[0]
    return S.upcoming(entries, today, ("release", "event")).select("subject", "date", "verb", "sources")


def calendar_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month with its loose entries and its days."""
    m = S.by_month(_entries(spark, sf_dir)[0])
    text = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return m.select("month", text(F.col("loose")).alias("loose"), F.array_join(F.transform("days", lambda d: F.concat(d["day"], F.lit(":"), text(d["entries"]))), ";").alias("days"))


JOBS = [schedule_extract, calendar_entries, calendar_upcoming, calendar_nested]

NUMBERS = "o AS (SELECT o_orderkey, o_custkey, o_orderkey % 13 + 1 AS m, o_orderkey % 33 AS d, CAST(o_orderdate + INTERVAL 9 HOUR AS DATE) AS seen, epoch(o_orderdate) AS pub FROM orders)"
YEAR = "year(seen) + CASE WHEN make_date(CAST(year(seen) AS BIGINT), m, CAST(1 AS BIGINT)) + CAST({day} - 1 AS INT) < seen - 150 THEN 1 ELSE 0 END"
DAY, MONTH = YEAR.format(day="d"), YEAR.format(day="1")
CALENDAR = f"""WITH {NUMBERS}, v AS (SELECT *, o_orderkey % 5 AS k, concat('a', o_custkey % 7) AS name, o_orderkey * 7 % 5 + 1 AS sources FROM o WHERE m <= 12 AND o_orderkey % 9 <> 0),
e AS (SELECT o_orderkey AS ord, sources, CASE k WHEN 2 THEN concat(m, '月', d, '日発売!') ELSE name END AS subject, printf('%04d-%02d-%02d', {DAY}, m, d) AS date, CASE k WHEN 1 THEN 'event' ELSE 'release' END AS verb, make_date(CAST({DAY} AS BIGINT), m, CAST(1 AS BIGINT)) + CAST(d - 1 AS INT) AS a, make_date(CAST({DAY} AS BIGINT), m, CAST(1 AS BIGINT)) + CAST(d AS INT) AS b FROM v WHERE k IN (0, 1, 2) AND d BETWEEN 1 AND 31
  UNION ALL SELECT o_orderkey, sources, name, printf('%04d-%02d', {MONTH}, m), 'start', make_date(CAST({MONTH} AS BIGINT), m, CAST(1 AS BIGINT)), CAST(make_date(CAST({MONTH} AS BIGINT), m, CAST(1 AS BIGINT)) + INTERVAL 1 MONTH AS DATE) FROM v WHERE k = 3),
near AS (SELECT e.* FROM e, (SELECT max(pub) AS now FROM o) n WHERE epoch(b) >= now - 14 * 86400 AND epoch(a) <= now + 400 * 86400),
told AS (SELECT *, sources > coalesce((SELECT sum(x.sources) FROM near x WHERE x.subject = near.subject AND x.date = near.date AND x.verb = near.verb AND x.ord < near.ord), 0) AS leads FROM near),
cal AS (SELECT subject, date, verb, max(ord) FILTER (leads) AS ord, CAST(sum(sources) AS BIGINT) AS sources FROM told GROUP BY subject, date, verb)"""
ORACLES = {
    "schedule_extract": f"""WITH {NUMBERS}, x AS (SELECT *, o_orderkey % 16 AS k FROM o), ok AS (SELECT * FROM x WHERE k = 5 OR (m <= 12 AND (k IN (4, 11) OR d BETWEEN 1 AND 31)))
SELECT o_orderkey, CASE k WHEN 2 THEN printf('2030-%02d-%02d', m, d) WHEN 15 THEN printf('1998-%02d-%02d', m, d) WHEN 5 THEN strftime(seen, '%Y-%m-%d') WHEN 4 THEN printf('%04d-%02d', yr_m, m) WHEN 11 THEN printf('%04d-%02d', yr_m, m) ELSE printf('%04d-%02d-%02d', yr_d, m, d) END AS date,
  CASE WHEN k IN (2, 11) THEN 'start' WHEN k = 5 THEN 'end' WHEN k = 14 THEN 'event' ELSE 'release' END AS verb
FROM (SELECT *, CASE WHEN k IN (4, 11) THEN {MONTH} END AS yr_m, CASE WHEN k IN (1, 8, 14) THEN {DAY} END AS yr_d FROM ok) y WHERE k IN (1, 2, 4, 5, 8, 11, 14, 15)""",
    "calendar_entries": f"{CALENDAR} SELECT subject, date, verb, ord, sources FROM cal",
    "calendar_upcoming": f"{CALENDAR}, t AS (SELECT max(seen) AS today FROM o) SELECT subject, date, verb, sources FROM cal, t WHERE verb <> 'start' AND date >= CASE WHEN length(date) = 7 THEN strftime(today, '%Y-%m') ELSE strftime(today, '%Y-%m-%d') END",
    "calendar_nested": f"{CALENDAR}, days AS (SELECT date, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY sources DESC, subject, verb, ord) AS ords FROM cal GROUP BY date) SELECT date[1:7] AS month, coalesce(max(ords) FILTER (length(date) = 7), '') AS loose, coalesce(string_agg(concat(date, ':', ords), ';' ORDER BY date) FILTER (length(date) > 7), '') AS days FROM days GROUP BY date[1:7]",
}

"""What a reader sees: search, suggestions, facets, paging, visits, bookmarks. Each job has DuckDB SQL of its own, in other constructs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import search
from ..functions.cutting import fresh_path
from ..functions.feed_query import FeedQuery, interactive
from ..operators import bitmap_index
from . import verdict_sql as V
from . import verdicts

SECS = "timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", F.expr(SECS)).withColumn("day", F.floor(F.col("t") / 86400))


def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search compares headlines with."""
    x = verdicts.made(spark, sf_dir)
    return x.select("ord", search.searchable(F.concat_ws(" ", "title", "summary", "source")).alias("hay"))


def search_kana(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted headlines with two words, one written in the other kana and in full width, and without a third."""
    x = interactive(verdicts.accepted_once(spark, sf_dir))
    q = FeedQuery.from_url("?q=せーる+ＡＬＰＨＡ+-festival&lang=all")
    now = x.agg(F.max("pub")).first()[0] or 0
    return q.apply(x.withColumn("is_read", F.lit(False)), now).select("ord")


def query_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of a query with a store, a tag and a period, a topic hidden and a word muted."""
    x = interactive(verdicts.accepted_once(spark, sf_dir)).withColumn("is_read", F.lit(False))
    q = FeedQuery.from_url("?store=beta&cat=sale,event&lang=all&period=7d", hidden_topics=frozenset({"trouble"}), mute=("ＲＥＣＩＰＥ",))
    return q.counted(x, x.agg(F.max("pub")).first()[0] or 0)


def _indexed(spark: SparkSession, sf_dir: str):
    x = interactive(verdicts.accepted(spark, sf_dir)).withColumn("is_read", F.lit(False))
    return bitmap_index.build(x, fresh_path(spark, "index"))


def query_facets_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facets of query_facets from bitmaps."""
    index = _indexed(spark, sf_dir)
    q = FeedQuery.from_url("?store=beta&cat=sale,event&lang=all&period=7d", hidden_topics=frozenset({"trouble"}), mute=("ＲＥＣＩＰＥ",))
    return index.counted(q, index.read("items").agg(F.max("pub")).first()[0] or 0)


def search_kana_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headlines of search_kana by trigrams."""
    index = _indexed(spark, sf_dir)
    q = FeedQuery.from_url("?q=せーる+ＡＬＰＨＡ+-festival&lang=all")
    return index.shown(q, index.read("items").agg(F.max("pub")).first()[0] or 0)


def suggested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions for a query's last word, from names and tags of one language and platforms of all."""
    x = verdicts.accepted_once(spark, sf_dir)
    ja = x.where("lang = 'ja'")
    count = lambda df, c: df.select(F.explode(c).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return search.suggestions([("work", count(ja, "works")), ("cat", count(ja, "cats")), ("plat", count(x, "plats"))], "film Ｒ・E")


def recent_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated headlines of one language in the day before the newest."""
    x = verdicts.made(spark, sf_dir)
    now = x.agg(F.max("pub").alias("now"))
    return x.where("lang = 'ja'").join(F.broadcast(now), F.col("pub") >= F.col("now") - 86400).agg(F.count(F.lit(1)).alias("n"))


def pages_of_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page on which each day stands: pages are at least 300 rows, each to the end of its last day, newest first. One row a day goes through one task."""

    def fill(batches):
        rows = pd.concat(list(batches)).sort_values("day", ascending=False)
        page, held, out = 0, 0, []
        for n in rows["n"]:
            out.append(page)
            held += n
            if held >= 300:
                page, held = page + 1, 0
        yield rows.assign(page=out)

    days = _events(spark, sf_dir).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return days.repartition(1).mapInPandas(fill, "day long, n long, page long")


PAGES_SQL = """WITH RECURSIVE d AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS n FROM events GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY day DESC) AS r FROM d),
p AS (SELECT day, n, r, CAST(0 AS BIGINT) AS page, n AS held FROM k WHERE r = 1 UNION ALL SELECT k.day, k.n, k.r, CASE WHEN p.held >= 300 THEN p.page + 1 ELSE p.page END, CASE WHEN p.held >= 300 THEN k.n ELSE p.held + k.n END FROM p JOIN k ON k.r = p.r + 1) SELECT day, n, page FROM p"""


def day_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of days in local time: today, yesterday, else month/day with the weekday; undated last."""
    x = verdicts.made(spark, sf_dir).select("ord", F.date_add(F.to_date(F.lit("1970-01-01")), F.floor((F.col("pub") + 9 * 3600) / 86400).cast("int")).alias("d"))
    today = x.agg(F.max("d").alias("today"))
    x = x.join(F.broadcast(today))
    names = F.concat(F.month("d").cast("string"), F.lit("/"), F.dayofmonth("d").cast("string"), F.lit(" ("), F.date_format("d", "EEE"), F.lit(")"))
    label = F.when(F.col("d").isNull(), "undated").when(F.col("d") == F.col("today"), "today").when(F.col("d") == F.date_sub("today", 1), "yesterday").otherwise(names)
    return x.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


LABELS_SQL = f"""WITH {verdicts.MADE}, x AS (SELECT CAST(to_timestamp(pub + 32400) AT TIME ZONE 'UTC' AS DATE) AS d FROM made), y AS (SELECT d, (SELECT max(d) FROM x) - d AS ago FROM x)
SELECT CASE WHEN d IS NULL THEN 'undated' WHEN ago = 0 THEN 'today' WHEN ago = 1 THEN 'yesterday' ELSE strftime(d, '%-m/%-d (%a)') END AS label, count(*) AS n FROM y GROUP BY 1"""


def address_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of pages below a root, names percent-encoded as in a path."""
    quoted = F.url_encode(F.concat("title", F.lit("~!*'() é/")))
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    return verdicts.made(spark, sf_dir).select("ord", F.concat(F.lit("https://example.org/base/"), F.regexp_replace(F.concat(F.lit("/work/"), quoted, F.lit("/")), "^/+", "")).alias("address"))


ADDRESS_SQL = f"""WITH {verdicts.MADE} SELECT ord, concat('https://example.org/base/work/', replace(replace(replace(replace(replace(url_encode(concat(title, '~!*''() é/')), '%21', '!'), '%2A', '*'), '%27', ''''), '%28', '('), '%29', ')'), '/') AS address FROM made"""


def item_list_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structured list of the first 20 items of each language, as JSON; an item's name and address by place."""
    x = verdicts.made(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc_nulls_last("pub"), "ord"))).where("k <= 20")
    element = F.struct(F.lit("ListItem").alias("@type"), F.col("k").alias("position"), F.col("title").alias("name"), F.col("link").alias("url"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("k", element.alias("e")))), lambda e: e["e"])
    return x.groupBy("lang").agg(F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ItemList").alias("@type"), items.alias("itemListElement"))).alias("json"))


LIST_SQL = f"""WITH {verdicts.MADE}, x AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY pub DESC NULLS LAST, ord) AS k FROM made)
SELECT lang, concat('{{"@context":"https://schema.org","@type":"ItemList","itemListElement":[', string_agg(concat('{{"@type":"ListItem","position":', k, ',"name":', to_json(title), ',"url":', to_json(link), '}}'), ',' ORDER BY k), ']}}') AS json FROM x WHERE k <= 20 GROUP BY lang"""


def next_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each place of a ring the four that follow, from the last on to the first again."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("k", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)
    sizes = n.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("size"))
    asked = n.join(sizes, "n_regionkey").select("n_regionkey", F.col("n_name").alias("shown"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("step"), "k", "size")
    asked = asked.withColumn("k", (F.col("k") + F.col("step")) % F.col("size"))
    return asked.join(n.select("n_regionkey", "k", F.col("n_name").alias("next")), ["n_regionkey", "k"]).select("shown", F.col("step").cast("long").alias("step"), "next")


NEXT_SQL = """WITH l AS (SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey), p AS (SELECT names, unnest(range(len(names))) AS k FROM l) SELECT names[k + 1] AS shown, step, names[(k + step) % len(names) + 1] AS next FROM p, (SELECT unnest([1, 2, 3, 4]) AS step) s"""


def bookmark_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bookmark after all saves: those by hand (purchases) always count, those made while reading (views) only if deeper than what is saved."""
    e = _events(spark, sf_dir)
    by_hand = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max(F.struct("t", "event_id", "value")).alias("m"))
    x = e.where("event_type = 'view'").join(by_hand, "user_id", "left").where(F.col("m").isNull() | (F.struct("t", "event_id") > F.struct("m.t", "m.event_id")))
    deepest = x.groupBy("user_id").agg(F.max("value").alias("auto"))
    return by_hand.join(deepest, "user_id", "full").select("user_id", F.greatest("m.value", "auto").alias("mark"))


BOOKMARK_SQL = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS k FROM events), x AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN k ELSE 0 END) OVER (PARTITION BY user_id) AS last FROM e)
SELECT user_id, max(value) AS mark FROM x WHERE k = last OR (k > last AND event_type = 'view') GROUP BY user_id"""


def read_to_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items read by a bookmark: those of earlier times, and those of its own time up to its place in the list."""
    e = _events(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("day", F.desc("event_id"))))
    mark = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by(F.struct("day", "pos"), F.col("t")).alias("b"))
    x = e.join(mark, "user_id").where((F.col("day") < F.col("b.day")) | ((F.col("day") == F.col("b.day")) & (F.col("pos") <= F.col("b.pos"))))
    return x.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_read"), F.max("pos").cast("long").alias("last"))


MARKER_SQL = """WITH e AS (SELECT *, floor(epoch(ts)) AS t, floor(epoch(ts) / 86400) AS day FROM events), b AS (SELECT user_id, arg_max(day, t) AS d, arg_max(event_id, t) AS at_id FROM e WHERE event_type = 'purchase' GROUP BY user_id),
x AS (SELECT e.user_id FROM e JOIN b ON e.user_id = b.user_id AND (e.day < b.d OR e.day = b.d AND e.event_id >= b.at_id)) SELECT user_id, count(*) AS n_read, count(*) AS last FROM x GROUP BY user_id"""


def session_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each visit (two hours apart) with what came between the last visit's begin and its own; nothing is new at a first visit. One row an hour goes through one task, a second's items and visits are one row each in an hour's."""
    e = _events(spark, sf_dir)
    by = Window.partitionBy("user_id").orderBy("t", "event_id")
    visits = e.withColumn("fresh", F.coalesce(F.col("t") - F.lag("t").over(by) >= 7200, F.lit(True))).withColumn("s", F.count_if("fresh").over(by))
    visits = visits.groupBy("user_id", "s").agg(F.min("t").alias("begin"))
    # how many items there are up to a second: hours are counted on from those before, seconds within their hour, so that no visit meets the items it counts
    points = e.where("event_type = 'signup'").groupBy("t").agg(F.count(F.lit(1)).alias("many")).unionByName(visits.select(F.col("begin").alias("t"), F.lit(0).cast("long").alias("many")).where("t IS NOT NULL").distinct())
    points = points.groupBy("t").agg(F.sum("many").alias("many")).withColumn("hour", F.floor(F.col("t") / 3600))
    hours = points.groupBy("hour").agg(F.sum("many").alias("many"))
    before = hours.select("hour", (F.sum("many").over(Window.orderBy("hour")) - F.col("many")).alias("before"))
    upto = points.withColumn("inside", F.sum("many").over(Window.partitionBy("hour").orderBy("t"))).join(before, "hour").select(F.col("t").alias("begin"), (F.col("before") + F.col("inside")).alias("upto"))
    seen = visits.join(upto, "begin", "left").withColumn("n_new", F.col("upto") - F.lag("upto").over(Window.partitionBy("user_id").orderBy("s")))
    return seen.select("user_id", F.col("s").alias("visit"), F.coalesce("n_new", F.lit(0)).alias("n_new"))


SESSION_SQL = """WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), f AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < 7200 THEN 0 ELSE 1 END AS fresh FROM e),
v AS (SELECT user_id, t AS begun, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS visit FROM f WHERE fresh = 1), i AS (SELECT t, row_number() OVER (ORDER BY t) AS upto FROM e WHERE event_type = 'signup'),
c AS (SELECT user_id, visit, coalesce((SELECT max(upto) FROM i WHERE i.t <= v.begun), 0) AS n FROM v) SELECT user_id, visit, CASE WHEN visit = 1 THEN 0 ELSE n - lag(n) OVER (PARTITION BY user_id ORDER BY visit) END AS n_new FROM c"""


def user_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of a user: the last visit, the latest 3,000 days with one, the latest 4,000 links read; as counts and the latest link."""
    e = _events(spark, sf_dir)
    days = e.select("user_id", "day").distinct().withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("day")))).where("k <= 3000").groupBy("user_id").agg(F.count(F.lit(1)).alias("days"), F.min("day").alias("first_day"))
    read = e.where("event_type = 'click'").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("t"), F.desc("event_id")))).where("k <= 4000").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_read"), F.max_by("event_id", F.struct("t", "event_id")).alias("last_read"))
    return e.groupBy("user_id").agg(F.max("t").alias("last_visit")).join(days, "user_id").join(read, "user_id", "left").select("user_id", "last_visit", "days", "first_day", F.coalesce("n_read", F.lit(0)).alias("n_read"), "last_read")


STATE_SQL = """WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), d AS (SELECT user_id, list_reverse_sort(list_distinct(list(t // 86400)))[:3000] AS days FROM e GROUP BY user_id), r AS (SELECT user_id, list(event_id ORDER BY t DESC, event_id DESC)[:4000] AS links FROM e WHERE event_type = 'click' GROUP BY user_id)
SELECT e.user_id, max(t) AS last_visit, any_value(len(days)) AS days, any_value(days[len(days)]) AS first_day, coalesce(any_value(len(links)), 0) AS n_read, any_value(links[1]) AS last_read FROM e JOIN d ON e.user_id = d.user_id LEFT JOIN r ON e.user_id = r.user_id GROUP BY e.user_id"""

JOBS = [query_facets_indexed, search_kana_indexed, search_texts, search_kana, query_facets, suggested, recent_count, pages_of_days, day_labels, address_join, item_list_json, next_four, bookmark_saved, read_to_marker, session_news, user_state]

#: The headlines hold no other characters that the compatibility form changes.
NORM = "lower(array_to_string(list_transform(string_split(%s, ''), lambda c: CASE WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) WHEN c = chr(12288) THEN ' ' WHEN unicode(c) BETWEEN 12353 AND 12438 THEN chr(unicode(c) + 96) ELSE c END), ''))"
HAY = NORM % ("concat_ws(' ', t0, summary, array_to_string(works, ' '), source)")
FACETS = f"""{V.BASE}, h AS (SELECT *, {HAY} AS hay, coalesce(ids, []) AS tags, coalesce(stores, []) AS shops, {V.PLATS} AS plats FROM full_ok), q AS (SELECT *, coalesce(pub >= (SELECT max(pub) FROM h) - 604800, FALSE) AS p1, list_has_any(tags, ['sale', 'event']) AS p2, is_deal AS p3, list_contains(shops, 'beta') AS p4 FROM h WHERE NOT list_contains(tags, 'trouble') AND NOT contains(hay, 'recipe'))
SELECT 'cat' AS facet, v AS value, count(*) AS n FROM (SELECT unnest(tags) AS v FROM q WHERE p1 AND p3 AND p4) u GROUP BY v UNION ALL SELECT 'plat', v, count(*) FROM (SELECT unnest(string_split(plats, '|')) AS v FROM q WHERE p1 AND p2 AND p3 AND p4 AND plats <> '') u GROUP BY v
UNION ALL SELECT 'lang', lang, count(*) FROM q WHERE p1 AND p2 AND p3 AND p4 GROUP BY lang UNION ALL SELECT 'deal', 'deal', count(*) FROM q WHERE p1 AND p2 AND is_deal HAVING count(*) > 0 UNION ALL SELECT 'store', v, count(*) FROM (SELECT unnest(shops) AS v FROM q WHERE p1 AND p2 AND p3) u GROUP BY v"""
ORACLES = {
    "search_texts": f"WITH {verdicts.MADE} SELECT ord, {NORM % "concat_ws(' ', title, summary, source)"} AS hay FROM made",
    "search_kana": f"{V.BASE}, h AS (SELECT ord, {HAY} AS hay FROM full_ok) SELECT ord FROM h WHERE contains(hay, 'セール') AND contains(hay, 'alpha') AND NOT contains(hay, 'festival')",
    "query_facets": FACETS,
    "suggested": f"""{V.BASE}, cand AS (SELECT 0 AS ki, 'work' AS kind, unnest(works) AS name FROM full_ok WHERE lang = 'ja' UNION ALL SELECT 1, 'cat', unnest(ids) FROM full_ok WHERE lang = 'ja' UNION ALL SELECT 2, 'plat', unnest(string_split(p, '|')) FROM (SELECT {V.PLATS} AS p FROM full_ok) u WHERE p <> ''),
num AS (SELECT ki, kind, name, count(*) AS n, {NORM % ("regexp_replace(name, '[\\s　・]+', '', 'g')")} AS k FROM cand GROUP BY ki, kind, name) SELECT name, kind, n, CASE WHEN starts_with(k, 're') THEN 0 ELSE 1 END AS tier FROM num WHERE contains(k, 're') ORDER BY tier, n DESC, ki, name LIMIT 8""",
    "recent_count": f"WITH {verdicts.MADE} SELECT count(*) AS n FROM made WHERE lang = 'ja' AND pub >= (SELECT max(pub) FROM made) - 86400",
    "pages_of_days": PAGES_SQL,
    "day_labels": LABELS_SQL,
    "address_join": ADDRESS_SQL,
    "item_list_json": LIST_SQL,
    "next_four": NEXT_SQL,
    "bookmark_saved": BOOKMARK_SQL,
    "read_to_marker": MARKER_SQL,
    "session_news": SESSION_SQL,
    "user_state": STATE_SQL,
}
ORACLES |= {f"{k}_indexed": ORACLES[k] for k in ("query_facets", "search_kana")}

"""Queries that are more than one SQL statement: clusters, announcements, streams, feed documents, an interactive query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cutting import cut, dropped, fresh_path
from ..functions.feed_query import FeedQuery
from ..operators import clusters
from ..operators.prefixes import first_longer
from ..operators.facets import facet_counts as facets_of
from ..sources import feeds, sinks
from ..streaming import archive, keyed, polls
from . import views
from .dialect import Spark


def _sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(f"WITH documents AS (SELECT * FROM parquet.`{sf_dir}/documents.parquet`), {sql.strip()[5:]}")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = Spark()
    x = _sql(spark, sf_dir, f"WITH {views.rich(d)} SELECT *, {views.norm(d, 'title')} AS norm, {views.R.verdict(d, views.RULES, 'whole')} AS spoiler FROM rich")
    return x.select(
        "ord", "lang", "kind", "title", "summary", "source", "cats", "plats", "score", "norm", "spoiler", (F.col("pub") * 60).alias("pub"), (F.col("pub") * 60 + 600).alias("first_seen"),
        F.transform("works", F.lower).alias("works"), (F.col("feed_no") % 5 == 0).alias("syndicated"), F.expr(views.unbalanced(d, "title")).alias("truncated"),
        F.concat(F.lit("https://example.org/"), F.col("ord").cast("string")).alias("link"), F.lit(None).cast("string").alias("image"),
    )


def prefix_link_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cut-off title with the first longer one that it begins, at most three days apart.

    Titles and their compared forms are written first: a filter would else work them out anew for each time that it names them.
    """
    d, path = Spark(), fresh_path(spark, "titles")
    _sql(spark, sf_dir, f"WITH {views.items(d)} SELECT ord, lang, pub, title, {views.norm(d, 'title')} AS norm FROM items").write.parquet(path)
    read = lambda what: spark.sql(f"WITH items AS (SELECT * FROM parquet.`{path}`), {views.cut_titles(d)} SELECT {what}")
    parts, wholes = read("ord AS b, lang, part AS text, pub FROM cut"), read("ord AS a, lang, norm AS text, pub FROM items")
    found = first_longer(parts, wholes, 72 * 60, 12).select(F.col("b").alias("ord"), F.col("a").alias("full_ord"))
    dropped(spark, [path])  # first_longer keeps what it needs
    return found


def cluster_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(_items(spark, sf_dir))


def cluster_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters by links that do not depend on order: equal titles, cut-off ones (some are cut here, as the tables hold few), and reposts."""
    x = _items(spark, sf_dir)
    cut_off = (F.col("ord") % 6 == 0) & (F.length("norm") > 20)
    return clusters.linked(x.withColumn("truncated", cut_off).withColumn("norm", F.when(cut_off, F.substring("norm", 1, 16)).otherwise(F.col("norm"))))


LINKED_SQL = """WITH RECURSIVE i AS (SELECT doc_id AS ord, split_part(text, chr(10), 1) AS title, lang, doc_id * 420 AS pub, CAST(replace(source, 'src', '') AS INT) % 5 = 0 AS synd FROM documents),
m AS (SELECT *, regexp_replace(lower(regexp_replace(title, '^[【\\[][^】\\]]*[】\\]]', '')), '[\\s「」『』【】\\[\\]（）()、。！？!?・:：—―~〜"''“”‘’…-]+', '', 'g') AS whole FROM i),
n AS (SELECT *, ord % 6 = 0 AND length(whole) > 20 AS cut, CASE WHEN ord % 6 = 0 AND length(whole) > 20 THEN whole[1:16] ELSE whole END AS norm FROM m),
g AS (SELECT *, CASE WHEN length(norm) < 2 THEN list_filter([norm], lambda x: x <> '') ELSE list_distinct(list_transform(range(1, length(norm)), lambda k: norm[k:k + 1])) END AS grams FROM n),
p AS (SELECT a.ord AS a, min(b.ord) AS b FROM n a JOIN n b ON a.cut AND length(a.norm) >= 12 AND a.lang = b.lang AND length(b.norm) > length(a.norm) AND starts_with(b.norm, a.norm) AND abs(a.pub - b.pub) <= 259200 GROUP BY a.ord),
s AS (SELECT a.ord AS a, b.ord AS b, len(list_intersect(a.grams, b.grams)) AS shared, len(a.grams) + len(b.grams) AS total FROM g a JOIN g b ON a.synd AND a.ord <> b.ord AND a.lang = b.lang AND abs(a.pub - b.pub) <= 259200),
e AS (SELECT a, b FROM p UNION SELECT a, b FROM s WHERE shared > 0 AND shared >= 0.7 * (total - shared) UNION SELECT ord, min(ord) OVER (PARTITION BY lang, norm) FROM n WHERE length(norm) >= 10),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT ord, ord FROM n), r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT a AS ord, min(b) AS cid FROM r GROUP BY a"""


def cluster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survivors of the clusters of equal titles and kinds of links; arrays as JSON."""
    items = _items(spark, sf_dir)
    out = clusters.merge(items, clusters.cluster(items))
    return out.select("cid", "ord", "pub", "first_seen", F.col("score").cast("long").alias("score"), "spoiler", "syndicated", "n", F.array_join("cats", ",").alias("cats"), F.array_join("works", ",").alias("works"), F.to_json("sources").alias("sources"))


def cluster_merge_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge over groups of equal language and title, which SQL can state too."""
    items = _items(spark, sf_dir)
    titles = cut(items.select("ord", "lang", "norm"))
    first = titles.groupBy("lang", "norm").agg(F.min("ord").alias("cid"))
    out = clusters.merge(items, titles.join(first, ["lang", "norm"]).select("ord", "cid"))
    return out.select("cid", "ord", "pub", "first_seen", F.col("score").cast("long").alias("score"), "spoiler", "syndicated", "n", F.array_join(F.array_sort("cats"), ",").alias("cats"))


#: The clusters told otherwise: components by paths, candidate links by all pairs, and the last pass as a fold over them, one link a step.
#: Items of these tables have all a time that rises with ord, so a group's leader is its lowest item.
ALIKE = "len(list_intersect({0}, {1})) / greatest(1, len({0}) + len({1}) - len(list_intersect({0}, {1})))"
PAIRED = "list_distinct(CASE WHEN length({0}) < 2 THEN list_filter([{0}], lambda q: q <> '') ELSE list_transform(list_zip(string_split({0}, '')[:-2], string_split({0}, '')[2:]), lambda q: concat(q[1], q[2])) END)"
STRIPPED = "list_reduce(list_filter({0}.works, lambda q: list_contains({1}.works, q)), lambda q, w: replace(q, w, ''), {2}.norm)"


def _rule(a: str, b: str) -> str:
    left, right = (PAIRED.format(STRIPPED.format(a, b, k)) for k in (a, b))
    return f"CASE WHEN list_has_any({a}.works, {b}.works) THEN {ALIKE.format(left, right)} >= 0.4 ELSE {ALIKE.format(f'{a}.grams', f'{b}.grams')} >= 0.55 END"


def clustered_sql() -> str:
    """CTEs up to cl (ord, cid)."""
    head, tail = LINKED_SQL.split("n AS (", 1)[0], LINKED_SQL[LINKED_SQL.index("g AS (") : LINKED_SQL.index("SELECT a AS ord, min(b)")]
    opened = " OR ".join(f"len(string_split(title, '{a}')) > len(string_split(title, '{b}'))" for a, b in views.BRACKETS)
    n = f"n AS (SELECT *, whole AS norm, {opened} AS cut, list_distinct(list_transform(regexp_extract_all(title, '[A-Z][a-z]{{2,}}'), lambda w: lower(w))) AS works FROM m),"
    near = lambda lead, own, other: f"({lead}.idx = {own}.idx OR {ALIKE.format(f'{lead}.grams', f'{other}.grams')} >= 0.45 OR {_rule(lead, other)})"
    return f"""{head}{n} {tail.rstrip().rstrip(',')}, t AS (SELECT a AS ord, min(b) AS c FROM r GROUP BY a),
x AS (SELECT g.ord, g.lang, g.pub, g.norm, g.works, g.grams, row_number() OVER (ORDER BY g.ord) AS idx, t.c FROM g JOIN t ON g.ord = t.ord), y AS MATERIALIZED (SELECT x.*, f.idx AS root FROM x JOIN x f ON f.ord = x.c),
k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY i.idx, j.idx) AS o, i.idx AS a, j.idx AS b FROM y i JOIN y j ON i.lang IS NOT DISTINCT FROM j.lang AND i.idx < j.idx AND j.pub - i.pub <= 43200 AND i.root <> j.root WHERE {_rule('i', 'j')}),
f(o, grp) AS (SELECT CAST(0 AS BIGINT), list(root ORDER BY idx) FROM y UNION ALL SELECT k.o, CASE WHEN grp[k.a] <> grp[k.b] AND {near('la', 'i', 'j')} AND {near('lb', 'j', 'i')} THEN list_transform(grp, lambda q: CASE WHEN q = greatest(grp[k.a], grp[k.b]) THEN least(grp[k.a], grp[k.b]) ELSE q END) ELSE grp END
  FROM f JOIN k ON k.o = f.o + 1 JOIN y i ON i.idx = k.a JOIN y j ON j.idx = k.b JOIN y la ON la.idx = grp[k.a] JOIN y lb ON lb.idx = grp[k.b]),
last AS (SELECT arg_max(grp, o) AS grp FROM f), cl AS (SELECT y.ord, z.ord AS cid FROM y, last, y z WHERE z.idx = grp[y.idx])"""


def merged_sql(d) -> str:
    """The survivors of the clusters, told by windows and ordered lists."""
    return f"""{clustered_sql()}, {views.rich(d)}, u AS (SELECT *, {views.R.verdict(d, views.RULES, 'whole')} AS spoils, feed_no % 5 = 0 AS repost, CASE kind WHEN 'specialist' THEN 0 WHEN 'general' THEN 1 WHEN 'press' THEN 2 ELSE 3 END + CASE WHEN feed_no % 5 = 0 THEN 100 ELSE 0 END + CASE WHEN {views.unbalanced(d, 'title')} THEN 1000 ELSE 0 END AS rnk FROM rich),
v AS (SELECT u.*, cl.cid, row_number() OVER (PARTITION BY cl.cid ORDER BY rnk, length(summary) DESC, u.ord) AS place FROM u JOIN cl ON u.ord = cl.ord),
tc AS (SELECT cid, string_agg(tag, ',' ORDER BY met) AS cats FROM (SELECT cid, tag, min([ord, pos]) AS met FROM (SELECT cid, ord, unnest(cats) AS tag, generate_subscripts(cats, 1) AS pos FROM v) q GROUP BY cid, tag) q GROUP BY cid),
tw AS (SELECT cid, string_agg(tag, ',' ORDER BY met) AS works FROM (SELECT cid, lower(tag) AS tag, min([CASE WHEN place = 1 THEN -1 ELSE ord END, pos]) AS met FROM (SELECT cid, ord, place, unnest(works) AS tag, generate_subscripts(works, 1) AS pos FROM v) q GROUP BY cid, lower(tag)) q GROUP BY cid),
ts AS (SELECT cid, concat('[', string_agg(concat('{{"name":"', coalesce(source, ''), '","link":"https://example.org/', ord, '"}}'), ',' ORDER BY other, rnk, ord), ']') AS sources FROM (SELECT *, CASE WHEN place = 1 THEN 0 ELSE 1 END AS other, row_number() OVER (PARTITION BY cid, coalesce(source, '') ORDER BY CASE WHEN place = 1 THEN 0 ELSE 1 END, rnk, ord) AS first FROM v) q WHERE first = 1 GROUP BY cid)
SELECT v.cid, max(ord) FILTER (place = 1) AS ord, min(pub) * 60 AS pub, min(pub) * 60 + 600 AS first_seen, CAST(max(score) AS BIGINT) AS score, bool_or(spoils) AS spoiler, bool_and(repost) AS syndicated, count(*) AS n, coalesce(max(tc.cats), '') AS cats, coalesce(max(tw.works), '') AS works, max(ts.sources) AS sources
FROM v LEFT JOIN tc ON v.cid = tc.cid LEFT JOIN tw ON v.cid = tw.cid JOIN ts ON v.cid = ts.cid GROUP BY v.cid"""


def stream_archive_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = archive.events(spark, sf_dir).select(F.col("user_id").alias("k"), F.col("event_id").alias("ord"), F.col("event_type").alias("title"), F.when(F.col("event_id") % 7 != 0, F.col("secs")).alias("pub"), (F.col("event_id") % 3).alias("batch"))
    return archive.run_upsert(s, fresh_path(spark, "archive")).select("k", "ord", "title", "pub", "first_batch")


def stream_archive_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same upsert as state by key, with a timer for each key that has a time."""
    s = archive.events(spark, sf_dir).select(F.col("user_id").alias("k"), F.col("event_id").alias("ord"), F.col("event_type").alias("title"), F.when(F.col("event_id") % 7 != 0, F.col("secs")).alias("pub"), (F.col("event_id") % 3).alias("batch"))
    return keyed.run_keyed(s, fresh_path(spark, "keyed")).select("k", "ord", "title", "pub", "first_batch")


def stream_session_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits that were over a day before the newest event."""
    return keyed.run_sessions(archive.events(spark, sf_dir), fresh_path(spark, "sessions"))


SESSIONS_SQL = """WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), l AS (SELECT user_id, list(t ORDER BY t) AS ts FROM e GROUP BY user_id),
b AS (SELECT user_id, ts, list_filter(range(1, len(ts) + 1), lambda i: i = 1 OR ts[i] - ts[i - 1] >= 7200) AS firsts FROM l),
s AS (SELECT user_id, ts, unnest(firsts) AS i, unnest(list_concat(firsts[2:], [len(ts) + 1])) AS j FROM b)
SELECT user_id, ts[i] AS begin_t, ts[j - 1] AS last_t, CAST(j - i AS BIGINT) AS n FROM s WHERE ts[j - 1] + 7200 <= (SELECT max(t) FROM e) - 86400"""


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.run_daily_counts(archive.events(spark, sf_dir), fresh_path(spark, "daily"))


def archive_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upsert over a whole table: combined by key before the one shuffle, then cut at the age limit."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("secs", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    rows = e.select(F.col("user_id").alias("k"), F.col("event_id").alias("ord"), F.col("event_type").alias("title"), F.when(F.col("event_id") % 7 != 0, F.col("secs")).alias("pub"), (F.col("event_id") % 3).alias("first_batch"), (F.col("event_id") % 3).alias("batch"))
    return archive.retained(archive.merged(rows)).select("k", "ord", "title", "pub", "first_batch")


def archive_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each hour's users as the archive, two thirds with a time of its own; all others as a new batch."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("secs", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    k = (F.col("user_id") * 1000 + F.floor(F.col("secs") / 86400) % 1000).alias("k")
    old = F.col("event_id") % 4 == 0
    rows = e.select(k, F.when(old, -1).otherwise(1).alias("batch"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 5 != 0, F.col("secs")).alias("pub"), F.when(old & (F.col("event_id") % 3 != 0), F.col("secs") + 60).alias("first_seen"))
    return archive.first_seen(rows, 2_000_000_000)


FIRST_SEEN_SQL = """WITH r AS (SELECT user_id * 1000 + CAST(floor(epoch(ts) / 86400) AS BIGINT) % 1000 AS k, event_id % 4 = 0 AS old, event_id AS ord, CASE WHEN event_id % 5 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS pub, CASE WHEN event_id % 4 = 0 AND event_id % 3 <> 0 THEN CAST(floor(epoch(ts)) AS BIGINT) + 60 END AS seen FROM events),
o AS (SELECT DISTINCT ON (k) k, pub, seen FROM r WHERE old ORDER BY k, ord), n AS (SELECT k, count(*) AS n FROM r GROUP BY k)
SELECT n.k, CASE WHEN o.k IS NULL THEN 2000000000 WHEN n.n = 1 THEN o.seen ELSE coalesce(o.seen, o.pub, 2000000000) END AS first_seen FROM n LEFT JOIN o ON n.k = o.k"""


def stream_sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.run_sliding_counts(archive.events(spark, sf_dir), fresh_path(spark, "sliding"))


SLIDING_SQL = """WITH e AS (SELECT epoch(ts) AS t, event_type FROM events), w AS (SELECT CAST((floor(t / 86400) - back) * 86400 AS BIGINT) AS begin, event_type FROM e, (SELECT unnest([0, 1, 2]) AS back) b)
SELECT begin, event_type, count(*) AS n FROM w WHERE begin + 259200 <= (SELECT max(t) FROM e) - 86400 GROUP BY begin, event_type"""


def stream_interval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view and a click by one user within the hour that follows."""
    views, clicks = (archive.events(spark, sf_dir).where(F.col("event_type") == k) for k in ("view", "click"))
    return archive.run_interval_pairs(views, clicks, fresh_path(spark, "pairs"))


PAIRS_SQL = "SELECT v.user_id, v.event_id AS a, c.event_id AS b FROM events v JOIN events c ON v.user_id = c.user_id AND c.event_type = 'click' AND floor(epoch(c.ts)) BETWEEN floor(epoch(v.ts)) AND floor(epoch(v.ts)) + 3600 WHERE v.event_type = 'view'"


def exact_title_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose compared title was met before, with the first of them: lowest numbers are combined before the shuffle."""
    x = _items(spark, sf_dir).where(F.length("norm") >= clusters.MIN_EXACT).select("ord", "lang", "norm")
    first = x.groupBy("lang", "norm").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return x.join(first, ["lang", "norm"]).where("ord > first_ord").select("ord", "first_ord")


def interval_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of one language at most 500 apart with bigram similarity 0.7 or more."""
    d = Spark()
    x = _sql(spark, sf_dir, f"WITH {views.items(d)} SELECT ord AS node, lang, pub, {views.norm(d, 'title')} AS norm FROM items")
    return clusters.similar_pairs(x, 500, 0.7).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "inter", "uni")


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets over documents: each counts rows that pass all conditions but its own, in one pass."""
    x = _items(spark, sf_dir).withColumn("feed_no", F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"))
    newest = x.agg(F.max("pub").alias("newest"))
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
    conditions = {"lang": F.col("lang").isin("en", "fr"), "period": F.col("pub") >= F.col("newest") - 3000 * 60, "cat": has("cats", "law"), "plat": has("plats", "alpha"), "multi": F.col("feed_no") % 3 != 1}
    facets = {"lang": (F.array("lang"), ("lang",)), "cat": (F.col("cats"), ("cat",)), "plat": (F.col("plats"), ("plat",)), "multi": (F.array((F.col("feed_no") % 3).cast("string")), ("multi",))}
    return facets_of(x.join(F.broadcast(newest)), conditions, facets)


DAILY_SQL = "WITH x AS (SELECT CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, event_type, epoch(ts) AS t FROM events) SELECT day, event_type, count(*) AS n FROM x WHERE (day + 1) * 86400 <= (SELECT max(t) FROM x) - 86400 GROUP BY day, event_type"


def feed_documents_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One RSS document a source is written and read again: the newest 50 items of each source, in order."""
    x = feeds.stored_feeds(spark, sinks.write_documents(sinks.rss_documents(_items(spark, sf_dir), "source"), fresh_path(spark, "rss")), "*.txt")
    return x.select(F.regexp_extract("feed", "feed=([^/]+)", 1).alias("source"), F.col("place").cast("long").alias("place"), F.regexp_extract("link", "([0-9]+)$", 1).cast("long").alias("ord"), "pub")


REREAD_SQL = "WITH x AS (SELECT source, doc_id AS ord, doc_id * 420 AS pub, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) - 1 AS place FROM documents WHERE source IS NOT NULL AND trim(split_part(text, chr(10), 1)) <> '') SELECT source, place, ord, pub FROM x WHERE place < 50"


def stream_feed_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds (a source's items by blocks of 20,000) that grow between three polls: their documents are published, polled and passed on, each entry with its first poll and its place there."""
    folder, site = fresh_path(spark, "polls"), fresh_path(spark, "site")
    x = _sql(spark, sf_dir, f"WITH {views.items(Spark())} SELECT ord, title, summary, pub * 60 AS pub, concat('https://example.org/', ord) AS link, concat(source, '-', ord DIV 20000) AS feed FROM items")
    for p in range(3):
        shown = sinks.write_documents(sinks.rss_documents(x.where(F.col("ord") % 3 <= p), "feed"), site)
        rows = feeds.stored_feeds(spark, shown, "*.txt")
        out = polls.hourly(spark, rows.withColumn("feed", F.regexp_extract("feed", "feed=([^/]+)", 1)), folder, 3600 * (p + 1))
    return out.select("feed", F.regexp_extract("link", "([0-9]+)$", 1).cast("long").alias("ord"), F.col("poll").cast("long").alias("poll"), F.col("place").cast("long").alias("place"))


POLLS_SQL = """WITH i AS (SELECT doc_id AS ord, concat(source, '-', doc_id // 20000) AS feed FROM documents WHERE source IS NOT NULL AND trim(split_part(text, chr(10), 1)) <> ''),
p AS (SELECT feed, ord, poll, row_number() OVER (PARTITION BY feed, poll ORDER BY ord DESC) - 1 AS place FROM i, (SELECT unnest(range(3)) AS poll) q WHERE ord % 3 <= poll)
SELECT feed, ord, min(poll) AS poll, arg_min(place, poll) AS place FROM p WHERE place < 50 GROUP BY feed, ord"""


def feed_query_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interactive query: two tags, one of two languages, a period, words wanted and not, a hidden topic and a muted word."""
    x = _items(spark, sf_dir).withColumn("hay", F.lower(F.concat_ws(" ", "title", "summary", "source"))).withColumn("lang", F.upper("lang"))
    x = x.withColumn("originals", F.lit(0)).withColumn("lang", F.lower("lang"))
    q = FeedQuery.from_url("?q=a+-license&cat=motion,link&lang=en&period=7d", hidden_topics=frozenset({"law"}), mute=("Trash",))
    now = x.agg(F.max("pub")).first()[0] or 0
    return x.groupBy(q.disposition(now).alias("disposition"), "lang").agg(F.count("*").alias("n"))


def feed_query_sql(d) -> str:
    has = lambda v: f"coalesce(list_contains(cats, '{v}'), FALSE)"
    return f"""WITH {views.rich(d)}, x AS (SELECT *, lower(concat(whole, ' ', source)) AS hay FROM rich), n AS (SELECT max(pub) * 60 - 604800 AS since FROM x),
y AS (SELECT lang, CASE WHEN NOT (lang = 'en' AND pub * 60 >= since AND ({has('motion')} OR {has('link')}) AND instr(hay, 'a') > 0 AND instr(hay, 'license') = 0) THEN 'rejected' WHEN {has('law')} THEN 'hidden' WHEN instr(hay, 'trash') > 0 THEN 'muted' ELSE 'shown' END AS disposition FROM x, n)
SELECT disposition, lang, count(*) AS n FROM y GROUP BY disposition, lang"""


def merge_exact_sql(d) -> str:
    return f"""WITH {views.rich(d)}, x AS (SELECT *, {views.norm(d, 'title')} AS norm, {views.R.verdict(d, views.RULES, 'whole')} AS spoiler, feed_no % 5 = 0 AS synd FROM rich),
y AS (SELECT *, CASE kind WHEN 'specialist' THEN 0 WHEN 'general' THEN 1 WHEN 'press' THEN 2 ELSE 3 END + CASE WHEN synd THEN 100 ELSE 0 END + CASE WHEN {views.unbalanced(d, 'title')} THEN 1000 ELSE 0 END AS rnk, min(ord) OVER (PARTITION BY lang, norm) AS cid FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY rnk, length(summary) DESC, ord) AS k FROM y),
c AS (SELECT cid, string_agg(tag, ',' ORDER BY tag) AS cats FROM (SELECT DISTINCT cid, tag FROM z, unnest(cats) AS t(tag)) u GROUP BY cid)
SELECT z.cid, max(CASE WHEN k = 1 THEN ord END) AS ord, min(pub) * 60 AS pub, min(pub) * 60 + 600 AS first_seen, CAST(max(score) AS BIGINT) AS score, bool_or(spoiler) AS spoiler, bool_and(synd) AS syndicated, count(*) AS n, coalesce(max(c.cats), '') AS cats
FROM z LEFT JOIN c ON z.cid = c.cid GROUP BY z.cid"""


JOBS = [cluster_linked, prefix_link_first, cluster_replay, cluster_merge, cluster_merge_exact, archive_upsert, archive_first_seen, exact_title_groups, interval_similarity_pairs, facet_counts, stream_sliding_counts, stream_interval_pairs, stream_archive_upsert, stream_archive_state, stream_session_visits, stream_daily_counts, stream_feed_polls, feed_documents_reread, feed_query_page]


def oracles(d) -> dict[str, str]:
    """DuckDB SQL of those that SQL can express."""
    return {"cluster_linked": LINKED_SQL, "cluster_replay": f"{clustered_sql()} SELECT ord, cid FROM cl", "cluster_merge": merged_sql(d), "prefix_link_first": views.prefix_link_first(d), "archive_upsert": views.archive_upsert(d), "archive_first_seen": FIRST_SEEN_SQL, "exact_title_groups": views.exact_title_groups(d), "interval_similarity_pairs": views.interval_similarity_pairs(d), "facet_counts": views.facet_counts(d), "stream_sliding_counts": SLIDING_SQL, "stream_interval_pairs": PAIRS_SQL, "cluster_merge_exact": merge_exact_sql(d), "stream_archive_upsert": views.archive_upsert(d), "stream_archive_state": views.archive_upsert(d), "stream_session_visits": SESSIONS_SQL, "stream_daily_counts": DAILY_SQL, "stream_feed_polls": POLLS_SQL, "feed_documents_reread": REREAD_SQL, "feed_query_page": feed_query_sql(d)}

"""The item view: how the test tables stand in for a feed archive, and the plans over it, one function a query.

Each plan is written once over a dialect. `now` is always a value of the data, never the clock.
"""

from __future__ import annotations

from ..functions import rules as R
from ..functions.ruleset import BRACKETS, LEADING_BRACKET, MARKS

RULES = R.RULES
KIND = "CASE feed_no % 4 WHEN 0 THEN 'specialist' WHEN 1 THEN 'general' WHEN 2 THEN 'aggregator' ELSE 'press' END"


def items(d) -> str:
    """The title is the whole first line, the summary all that follows; only summary_clean_truncate, which is for display, cuts."""
    return f"""base AS (SELECT doc_id AS ord, {d.first_line('text')} AS title, replace(substr(text, length({d.first_line('text')}) + 2), chr(10), ' ') AS summary,
  lang, source, CAST(substr(source, 4) AS INT) AS feed_no, doc_id * 7 AS pub FROM documents),
items AS (SELECT *, concat(title, ' ', summary) AS whole, {KIND} AS kind{d.lowered()} FROM base)"""


def rich(d) -> str:
    """Items with score, tags and entities (the capitalised words of the title)."""
    return f"""{items(d)}, rich AS (SELECT *, {R.score(d, RULES, 'title', 'summary')} AS score, {R.tagged(d, RULES, 'title', 'whole')} AS cats, {R.platforms(d, RULES, 'whole')} AS plats,
  {d.all('title', '([A-Z][a-z]{2,})', 1)} AS works FROM items)"""


def score_threshold_topk(d):
    t = " ".join(f"WHEN '{k}' THEN {v}" for k, v in RULES.thresholds.items())
    return f"WITH {rich(d)} SELECT ord, kind, CAST(score AS BIGINT) AS score FROM rich WHERE kind = 'specialist' OR score >= CASE kind {t} END ORDER BY pub DESC NULLS LAST, ord LIMIT 6000"


def keyword_flags(d):
    return f"WITH {items(d)} SELECT ord, " + ", ".join(f"{R.keyword(d, 'whole', w)} AS f{i}" for i, w in enumerate(RULES.weights)) + f", {R.any_of(d, 'title', ())} AS none FROM items"


def hard_exclude(d):
    upper = " OR ".join(f"instr(upper(title), '{w}') > 0" for w in RULES.hard_title)
    return f"WITH {items(d)} SELECT ord, ({upper}) OR {R.any_of(d, 'whole', RULES.hard_any)} AS excluded FROM items"


def off_topic_filter(d):
    signal = " OR ".join(d.rx("title", s) for s in RULES.off_signals)
    return f"WITH {rich(d)} SELECT ord FROM rich WHERE NOT (({signal}) AND NOT {R.any_of(d, 'title', RULES.exempt)} AND score <= 0)"


def multilabel_tags_exploded(d):
    return f"WITH {rich(d)} SELECT tag, lang, count(*) AS n FROM rich {d.each('cats', 'tag')} GROUP BY tag, lang"


def tag_exclusion_terms(d):
    return f"WITH {rich(d)} SELECT plat, count(*) AS n, min(ord) AS first_ord FROM rich {d.each('plats', 'plat')} GROUP BY plat"


def decision_list_flag(d):
    return f"WITH {items(d)} SELECT ord, {R.verdict(d, RULES, 'whole')} AS spoiler FROM items"


def discount_max(d):
    found = d.all("t", "([0-9]+)% ", 1)
    return f"WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, concat('Sale ', CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR(9)), '% off, ', CAST(CAST(round(l_tax * 100) AS INT) AS VARCHAR(9)), '% back') AS t FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, {d.maxint(found)} AS off FROM x"


def norm(d, e: str) -> str:
    """A compared title: without a bracket at the start, marks and blanks, in lower case."""
    return d.sub(f"lower({d.sub(e, LEADING_BRACKET, '')})", MARKS, "")


def compare_norm(d):
    return f"WITH {items(d)} SELECT ord, {norm(d, 'title')} AS norm, CAST(length({norm(d, 'title')}) AS BIGINT) AS n FROM items"


def publisher_split(d):
    full = "concat(title, ' (', lang, ') - Daily ', source)"
    return f"WITH {items(d)}, x AS (SELECT ord, {full} AS t FROM items), y AS (SELECT ord, {d.get('t', r'^(.*) - ([^-]{1,40})$', 1)} AS head, {d.get('t', r'^(.*) - ([^-]{1,40})$', 2)} AS publisher FROM x) SELECT ord, publisher, {d.sub('head', r' ?\([^()]{1,30}\)$', '')} AS title, {d.get('head', r'\(([^()]{1,30})\)$', 1)} AS original FROM y"


def unbalanced(d, e: str) -> str:
    """The test for a title that was cut off: more brackets opened than closed."""
    return " OR ".join(f"{d.count(e, a)} > {d.count(e, b)}" for a, b in BRACKETS)


def truncated_brackets(d):
    t = "concat(title, CASE WHEN ord % 3 = 0 THEN ' 『' WHEN ord % 3 = 1 THEN ' 【x】' ELSE ' (' END)"
    bad = unbalanced(d, "t")
    return f"WITH {items(d)}, x AS (SELECT ord, {t} AS t FROM items) SELECT ord, ({bad}) AS truncated, CASE WHEN {bad} THEN concat(t, '...') ELSE t END AS shown FROM x"


def summary_clean_truncate(d):
    c = d.sub(d.sub(d.sub("text", r"https?://[^ \n]+", ""), r"\[[^\]]{1,40}\]", ""), r"[ \t\n]+", " ")
    return f"WITH x AS (SELECT doc_id, trim({c}) AS s FROM documents) SELECT doc_id, CASE WHEN length(s) > 140 THEN concat(substr(s, 1, 140), '...') ELSE s END AS summary FROM x"


def html_to_text(d):
    """Tags as blanks, then the named entities in this order, then decimal references, then white space; &amp;lt; so becomes a bracket. The pages hold few references, so some are put behind them."""
    e = d.sub("concat(html, '&#', CAST(page_id % 900 + 97 AS VARCHAR(9)), ';&#039;&amp;lt;&amp;#65;&#00000128512;&#1114111;&#1114112;&#55296;&#0;  x')", "<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "\\x27"), ("&#039;", "\\x27")):
        e = f"replace({e}, '{a}', {d.quote() if b == chr(92) + 'x27' else chr(39) + b + chr(39)})"
    return f"WITH x AS (SELECT page_id, {e} AS t FROM pages), y AS (SELECT page_id, {d.references('t')} AS t FROM x) SELECT page_id, {d.sub(d.sub('t', '[ \t\r\n]+', ' '), '^ | $', '')} AS body FROM y"


def first_image_link(d):
    """The first picture of a page, usable if it is https and no tracker. The pages hold none, so some are put before them."""
    with_image = "concat('<p><a href=\"https://x.org/a.png\">', CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '<IMG alt=\"\" src=\"https://x.org/p.png\">' WHEN 2 THEN '<img src=\"http://x.org/q.png\"><img src=\"https://x.org/r.png\">' WHEN 3 THEN '<img class=\"a\" src=\"https://x.org/1x1.gif\">' ELSE '<imgs src=\"https://x.org/s.png\"><img width=1 src=\"https://x.org/t.png\">' END, html)"
    src = d.get("h", r"""(?i)<img[^>]+src=["']([^"']+)["']""", 1)
    return f"WITH x AS (SELECT page_id, {with_image} AS h FROM pages), y AS (SELECT page_id, {src} AS link FROM x) SELECT page_id, link, substr(link, 1, 8) = 'https://' AND NOT {d.rx('lower(link)', '(pixel|spacer|1x1)')} AS usable FROM y"


def link_key(d):
    k = d.sub(d.sub("url", r"#.*$", ""), r"[?&]source=rss$", "")
    return f"SELECT {k} AS link_key, count(*) AS n, min(page_id) AS first_page FROM pages GROUP BY {k}"


def url_host(d):
    host = d.get("lower(url)", r"^[a-z]+://([^/:?#]+)", 1)
    return f"WITH x AS (SELECT page_id, {host} AS host FROM pages) SELECT page_id, host, {d.rx('host', r'(^|[.])example[.](com|org)$')} AS syndicated FROM x"


def slugify(d):
    s = d.sub(d.sub("lower(p_name)", "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return f"WITH x AS (SELECT p_partkey, CASE WHEN {s} = '' THEN 'item' ELSE {s} END AS slug FROM part), y AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS k FROM x) SELECT p_partkey, CASE WHEN k = 1 THEN slug ELSE concat(slug, '-', CAST(k AS VARCHAR(20))) END AS slug FROM y"


def run_stats_left(d):
    return f"WITH {rich(d)}, feeds AS (SELECT DISTINCT source, feed_no FROM items UNION ALL SELECT 'src99', 99), got AS (SELECT source, count(*) AS n, sum(CASE WHEN score > 2 THEN 1 ELSE 0 END) AS a FROM rich GROUP BY source) SELECT f.source, CAST(coalesce(n, 0) AS BIGINT) AS fetched, CAST(coalesce(a, 0) AS BIGINT) AS accepted FROM feeds f LEFT JOIN got ON f.source = got.source"


def per_feed_limit(d):
    return f"WITH {items(d)}, x AS (SELECT ord, source, row_number() OVER (PARTITION BY source ORDER BY ord) AS k FROM items) SELECT ord, source, CAST(k AS BIGINT) AS k FROM x WHERE k <= 100"


def known_entity_semijoin(d):
    return f"WITH {rich(d)}, known AS (SELECT DISTINCT lower(w) AS w FROM rich {d.each('works', 'w')} WHERE kind = 'specialist'), x AS (SELECT ord, lower(w) AS w FROM rich {d.each('works', 'w')} WHERE kind <> 'specialist') SELECT DISTINCT ord FROM x WHERE w IN (SELECT w FROM known)"


def read_antijoin(d):
    return "SELECT e.event_id, e.user_id FROM events e WHERE e.event_type = 'view' AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'click' AND r.user_id = e.user_id AND r.ts <= e.ts)"


def upsert(d):
    return f"raw AS (SELECT user_id AS k, event_id AS ord, event_id % 3 AS batch, event_type AS title, CASE WHEN event_id % 7 = 0 THEN NULL ELSE {d.secs('ts')} END AS pub FROM events), ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY batch DESC, ord DESC) AS newest, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN pub IS NULL THEN 1 ELSE 0 END, batch, ord) AS oldest, min(batch) OVER (PARTITION BY k) AS first_batch FROM raw)"


# archive_upsert, exact_title_groups, interval_similarity_pairs and facet_counts are the DuckDB SQL of jobs that Spark plans otherwise (jobs.py).


def archive_upsert(d):
    """The new row wins all columns but pub (the first known one stays) and first_batch; rows past retention go, undated stay."""
    return f"WITH {upsert(d)}, a AS (SELECT n.k, n.ord, n.title, o.pub, n.first_batch FROM ranked n JOIN ranked o ON n.k = o.k AND o.oldest = 1 WHERE n.newest = 1), cutoff AS (SELECT max(pub) - 30 * 86400 AS c FROM a) SELECT k, ord, title, pub, first_batch FROM a CROSS JOIN cutoff WHERE pub IS NULL OR pub >= c"


def fresh_rows(d):
    return f"WITH {upsert(d)} SELECT batch, count(DISTINCT k) AS fresh FROM ranked WHERE batch = first_batch GROUP BY batch"


def display_name_vote(d):
    key = d.sub("lower(w)", "[aeiou]", "")
    return f"WITH {rich(d)}, x AS (SELECT {key} AS k, w, count(*) AS n, min(ord) AS first_ord FROM rich {d.each('works', 'w')} GROUP BY {key}, w), y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, length(w), first_ord, w) AS place FROM x) SELECT k, w AS shown, n FROM y WHERE place = 1"


def exact_title_groups(d):
    return f"WITH {items(d)}, x AS (SELECT ord, lang, {norm(d, 'title')} AS norm FROM items), y AS (SELECT ord, min(ord) OVER (PARTITION BY lang, norm) AS first_ord FROM x WHERE length(norm) >= 10) SELECT ord, first_ord FROM y WHERE ord > first_ord"


#: Titles that are cut off; the tables hold few, so a copy of every other one is tried that breaks off at brackets.
def cut_titles(d) -> str:
    copies = f"SELECT ord, lang, pub, concat(substr(title, 1, least(40, length(title) - 1)), ' 「『【') AS title FROM items WHERE length(title) > 1 AND NOT ({unbalanced(d, 'title')})"
    return f"tried AS (SELECT ord, lang, pub, title FROM items UNION ALL {copies}), cut AS (SELECT ord, lang, pub, {norm(d, 'title')} AS part FROM tried WHERE {unbalanced(d, 'title')})"


def prefix_link_first(d):
    """The DuckDB SQL of jobs.prefix_link_first: a cut-off title with the first longer one that it begins, by an equi join on language, first letters and time slot."""
    hours = 72 * 60
    return f"""WITH {items(d)}, x AS (SELECT ord, lang, pub, {norm(d, 'title')} AS norm, CAST(floor(pub / {hours}) AS BIGINT) AS slot FROM items), {cut_titles(d)},
near AS (SELECT ord, lang, pub, part, slot FROM (SELECT *, CAST(floor(pub / {hours}) AS BIGINT) AS b FROM cut) c {d.each(d.arr('b - 1', 'b', 'b + 1'), 'slot')} WHERE length(part) >= 12),
y AS (SELECT near.ord, min(x.ord) AS full_ord FROM near JOIN x ON near.lang = x.lang AND near.slot = x.slot AND substr(x.norm, 1, 12) = substr(near.part, 1, 12) WHERE length(x.norm) > length(near.part) AND substr(x.norm, 1, length(near.part)) = near.part AND abs(near.pub - x.pub) <= {hours} GROUP BY near.ord) SELECT ord, full_ord FROM y"""


def interval_similarity_pairs(d, window: int = 500, num: int = 7):
    """Equi join on language and time bucket, the left side put in its bucket and the next; then the exact interval and bigram Jaccard >= num/10."""
    return f"""WITH {items(d)}, x AS (SELECT ord, lang, pub, {d.grams(norm(d, 'title'))} AS g, CAST(floor(pub / {window}) AS BIGINT) AS b FROM items),
l AS (SELECT * FROM x UNION ALL SELECT ord, lang, pub, g, b + 1 FROM x),
p AS (SELECT l.ord AS a, r.ord AS b, {d.both('l.g', 'r.g')} AS inter, {d.size('l.g')} AS na, {d.size('r.g')} AS nb FROM l JOIN x r ON l.lang = r.lang AND l.b = r.b WHERE r.pub >= l.pub AND r.pub - l.pub <= {window} AND l.ord <> r.ord)
SELECT DISTINCT a, b, inter, na + nb - inter AS uni FROM p WHERE 10 * inter >= {num} * (na + nb - inter) AND inter > 0"""


PASSES = {
    "lang": "lang IN ('en', 'fr')",
    "period": "pub >= (SELECT max(pub) FROM items) - 3000",
    "cat": "array_has_law",
    "plat": "array_has_alpha",
    "multi": "feed_no % 3 <> 1",
}


def facet_counts(d):
    """Each facet counts rows that pass all predicates but its own: one scan, booleans first, then one row a facet value."""
    has = lambda a, v: f"coalesce({'array_contains' if d.name == 'spark' else 'list_contains'}({a}, '{v}'), FALSE)"
    p = {k: v.replace("array_has_law", has("cats", "law")).replace("array_has_alpha", has("plats", "alpha")) for k, v in PASSES.items()}
    mask = ", ".join(f"CASE WHEN {v} THEN 0 ELSE 1 END AS miss_{k}" for k, v in p.items())
    misses = " + ".join(f"miss_{k}" for k in p)
    own = lambda k: f"({misses} - miss_{k} = 0)"
    return f"""WITH {rich(d)}, m AS (SELECT ord, lang, cats, plats, feed_no, {mask} FROM rich)
SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM m WHERE {own('lang')} GROUP BY lang
UNION ALL SELECT 'cat', c, count(*) FROM m {d.each('cats', 'c')} WHERE {own('cat')} GROUP BY c
UNION ALL SELECT 'plat', c, count(*) FROM m {d.each('plats', 'c')} WHERE {own('plat')} GROUP BY c
UNION ALL SELECT 'multi', CAST(feed_no % 3 AS VARCHAR(9)), count(*) FROM m WHERE {own('multi')} GROUP BY feed_no % 3"""


def text_query(d, query: str = "the -license tion"):
    parts = [f"instr(hay, '{t[1:]}') = 0" if t.startswith("-") and len(t) > 1 else f"instr(hay, '{t}') > 0" for t in query.lower().split()]
    return f"WITH {items(d)}, x AS (SELECT ord, lower(concat(whole, ' ', source)) AS hay FROM items) SELECT ord FROM x WHERE {' AND '.join(parts)}"


def disposition_counts(d):
    """A row both hidden and muted counts as hidden."""
    return f"WITH {rich(d)}, l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id), x AS (SELECT CASE WHEN coalesce(toxic, 0) = 1 THEN 'hidden' WHEN instr(lower(whole), 'trash') > 0 OR instr(lower(whole), '###') > 0 THEN 'muted' WHEN score >= 2 THEN 'shown' ELSE 'rejected' END AS disposition, lang FROM rich LEFT JOIN l ON rich.ord = l.doc_id) SELECT disposition, lang, count(*) AS n FROM x GROUP BY disposition, lang"


def new_since_visit(d):
    return f"WITH v AS (SELECT user_id, {d.secs('ts')} AS t, event_type FROM events), last AS (SELECT user_id, max(t) AS visit FROM v WHERE event_type = 'signup' GROUP BY user_id) SELECT v.user_id, count(*) AS n_new FROM v JOIN last ON v.user_id = last.user_id WHERE v.t > last.visit AND last.visit > 0 GROUP BY v.user_id"


def hot_order_topk(d):
    return f"WITH {items(d)}, x AS (SELECT {norm(d, 'title')} AS k, lang, count(DISTINCT source) AS originals, max(pub) AS pub, min(ord) AS ord FROM items GROUP BY {norm(d, 'title')}, lang) SELECT ord, originals, pub FROM x ORDER BY originals DESC, pub DESC, ord LIMIT 30"


def trending_sum(d):
    return f"WITH {rich(d)}, n AS (SELECT max(pub) AS now FROM items), x AS (SELECT w, feed_no % 4 + 1 AS k, ord FROM rich CROSS JOIN n {d.each('works', 'w')} WHERE pub >= now - 5000 AND lang = 'en') SELECT w, CAST(sum(k) AS BIGINT) AS total, min(ord) AS first_ord FROM x GROUP BY w ORDER BY total DESC, first_ord, w LIMIT 12"


def trending_count(d):
    return trending_sum(d).replace("sum(k)", "count(*)")


def count_with_zero_dims(d):
    dims = ", ".join(f"'{k}'" for k in [*RULES.platforms, "omega"])
    return f"WITH {rich(d)}, dim AS (SELECT p FROM (SELECT 1 AS one) t {d.each(d.arr(*dims.split(', ')), 'p')}), n AS (SELECT plat, count(*) AS n FROM rich {d.each('plats', 'plat')} WHERE lang = 'en' AND pub >= (SELECT max(pub) FROM items) - 1440 GROUP BY plat) SELECT dim.p AS plat, coalesce(n, 0) AS n FROM dim LEFT JOIN n ON dim.p = n.plat"


def entity_pages_min2(d):
    return f"WITH {rich(d)} SELECT w, count(DISTINCT ord) AS n, min(pub) AS first_pub, max(pub) AS last_pub FROM rich {d.each('works', 'w')} GROUP BY w HAVING count(DISTINCT ord) >= 2"


def entity_top3_tags(d):
    two = f"SELECT w, c, ord FROM (SELECT ord, cats, w FROM rich {d.each('works', 'w')}) t {d.each('cats', 'c')}"
    return f"WITH {rich(d)}, x AS (SELECT w, c, count(DISTINCT ord) AS n FROM ({two}) u GROUP BY w, c), y AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY n DESC, c) AS k FROM x) SELECT w, c, n, CAST(k AS BIGINT) AS k FROM y WHERE k <= 3"


def day_runs(d):
    """Days newest first, rising inside a day; a header where the day changes. Days are counted first, so no sort spans all rows."""
    return f"WITH x AS (SELECT event_id, CAST(floor({d.secs('ts')} / 86400) AS BIGINT) AS day, {d.secs('ts')} AS t FROM events), n AS (SELECT day, count(*) AS n FROM x GROUP BY day), c AS (SELECT day, sum(n) OVER (ORDER BY day DESC) - n AS before FROM n), y AS (SELECT event_id, day, row_number() OVER (PARTITION BY day ORDER BY t, event_id) AS k FROM x) SELECT y.event_id, y.day, CAST(c.before + y.k AS BIGINT) AS place, y.k = 1 AS header FROM y JOIN c ON y.day = c.day"


def page_whole_day(d):
    """The first 30 rows, newest first, and the rest of the last one's day. Days are counted first, so no sort spans all rows."""
    return f"WITH x AS (SELECT event_id, CAST(floor({d.secs('ts')} / 86400) AS BIGINT) AS day FROM events), n AS (SELECT day, count(*) AS n FROM x GROUP BY day), c AS (SELECT day, sum(n) OVER (ORDER BY day DESC) - n AS before FROM n) SELECT x.event_id, x.day FROM x JOIN c ON x.day = c.day WHERE c.before < 30"


def suggest_rank(d, key: str = "a"):
    return f"WITH c AS (SELECT lower(p_brand) AS name, 'brand' AS kind, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT lower(n_name), 'nation', 1 FROM nation), x AS (SELECT *, CASE WHEN substr(name, 1, {len(key)}) = '{key}' THEN 0 ELSE 1 END AS tier FROM c WHERE instr(name, '{key}') > 0) SELECT name, kind, n, tier FROM x ORDER BY tier, n DESC, name LIMIT 8"


def interval_overlap_range(d):
    return f"WITH x AS (SELECT o_orderkey, {d.secs('o_orderdate')} AS a, {d.secs('o_orderdate')} + (o_orderkey % 30) * 86400 AS b FROM orders), n AS (SELECT max(a) AS now FROM x) SELECT o_orderkey, a, b FROM x CROSS JOIN n WHERE b > now - 14 * 86400 AND a < now + 400 * 86400"


def visit_days_level(d):
    """Levels: 100 points a day; level L needs floor(20 (L - 1)^1.9)."""
    series = "explode(sequence(1, 99))" if d.name == "spark" else "unnest(generate_series(1, 99))"
    return f"WITH days AS (SELECT user_id, 100 * count(DISTINCT CAST(floor({d.secs('ts')} / 86400) AS BIGINT)) AS points FROM events GROUP BY user_id), l AS (SELECT CAST(level AS BIGINT) AS level, floor(20 * power(level - 1, 1.9)) AS need FROM (SELECT {series} AS level) s) SELECT user_id, points, max(level) AS level FROM days JOIN l ON need <= points GROUP BY user_id, points"


def bookmark_unread(d):
    return f"WITH v AS (SELECT user_id, event_id, event_type, {d.secs('ts')} AS t FROM events), b AS (SELECT user_id, max(t) AS mark FROM v WHERE event_type = 'purchase' GROUP BY user_id) SELECT v.user_id, count(*) AS unread, min(t) AS next_t FROM v JOIN b ON v.user_id = b.user_id WHERE v.t > b.mark GROUP BY v.user_id"


def read_set_latest(d):
    return f"WITH x AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY {d.secs('ts')} DESC, event_id DESC) AS k FROM events WHERE event_type = 'click') SELECT user_id, event_id FROM x WHERE k <= 4000"


def daily_tumbling(d):
    return f"SELECT CAST(floor({d.secs('ts')} / 86400) AS BIGINT) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY CAST(floor({d.secs('ts')} / 86400) AS BIGINT), event_type"


def session_visits(d):
    return f"WITH x AS (SELECT user_id, {d.secs('ts')} AS t, event_id FROM events), y AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) < 7200 THEN 0 ELSE 1 END AS fresh FROM x), z AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id) AS s FROM y) SELECT user_id, min(t) AS begin_t, max(t) AS last_t, count(*) AS n FROM z GROUP BY user_id, s"


def wire_projection(d):
    return f"WITH {rich(d)} SELECT ord AS i, title AS t, source AS s, pub AS p, CASE WHEN {R.verdict(d, RULES, 'whole')} THEN 1 ELSE 0 END AS x, {'array_join' if d.name == 'spark' else 'array_to_string'}(cats, ',') AS c FROM rich"


def xml(e: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        e = f"replace({e}, '{a}', '{b}')"
    return e


def rss_rows(d):
    return f"WITH {items(d)} SELECT ord, concat('<item><title>', {xml('title')}, '</title><guid>', CAST(ord AS VARCHAR(20)), '</guid></item>') AS xml FROM items ORDER BY pub DESC, ord LIMIT 50"


def sitemap_rows(d):
    return f"WITH {rich(d)}, w AS (SELECT concat('/work/', lower(w), '/') AS loc, max(pub) AS lastmod FROM rich {d.each('works', 'w')} GROUP BY lower(w) HAVING count(DISTINCT ord) >= 2) SELECT loc, lastmod FROM w UNION ALL SELECT '/', (SELECT max(pub) FROM items)"


def calendar_groups(d):
    """Entries of one key, date and verb as one: sources summed; the entry shown is the last that has more sources than all before it together."""
    return f"""WITH x AS (SELECT o_custkey % 97 AS k, substr(CAST(o_orderdate AS VARCHAR(30)), 1, 7) AS month, o_orderstatus AS verb, o_orderkey AS ord, (o_orderkey * 7) % 5 + 1 AS sources FROM orders),
y AS (SELECT *, sum(sources) OVER (PARTITION BY k, month, verb ORDER BY ord ROWS UNBOUNDED PRECEDING) - sources AS before FROM x)
SELECT k, month, verb, CAST(sum(sources) AS BIGINT) AS sources, max(CASE WHEN sources > before THEN ord END) AS shown FROM y GROUP BY k, month, verb"""


def calendar_months(d):
    """A month's entries that name the month alone, and its days with their number of entries."""
    return "WITH x AS (SELECT substr(CAST(o_orderdate AS VARCHAR(30)), 1, 7) AS month, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE substr(CAST(o_orderdate AS VARCHAR(30)), 1, 10) END AS day, o_orderkey FROM orders) SELECT month, day, count(*) AS n, min(o_orderkey) AS first_ord FROM x WHERE month >= (SELECT max(month) FROM x) OR day >= '1996-01-01' GROUP BY month, day"


def feed_probe(d):
    """Liveness of each source: its number of items and the title of the latest."""
    return f"WITH {items(d)}, x AS (SELECT source, title, row_number() OVER (PARTITION BY source ORDER BY pub DESC, ord) AS k, count(*) OVER (PARTITION BY source) AS n FROM items) SELECT source, n, title AS latest FROM x WHERE k = 1"


PLANS = [calendar_groups, calendar_months, feed_probe, score_threshold_topk, keyword_flags, hard_exclude, off_topic_filter, multilabel_tags_exploded, tag_exclusion_terms, decision_list_flag, discount_max, compare_norm, publisher_split, truncated_brackets, summary_clean_truncate, html_to_text, first_image_link, link_key, url_host, slugify, run_stats_left, per_feed_limit, known_entity_semijoin, read_antijoin, fresh_rows, display_name_vote, text_query, disposition_counts, new_since_visit, hot_order_topk, trending_sum, trending_count, count_with_zero_dims, entity_pages_min2, entity_top3_tags, day_runs, page_whole_day, suggest_rank, interval_overlap_range, visit_days_level, bookmark_unread, read_set_latest, daily_tumbling, session_visits, wire_projection, rss_rows, sitemap_rows]

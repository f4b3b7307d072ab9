"""DuckDB SQL of plans in views.py, written apart from them: keywords are looked up in lists of a text's words, order and windows are told by
lists, correlated questions or other windows. They replace the plans' own text as what Spark is checked against."""

from __future__ import annotations

ITEMS = """WITH i AS (SELECT doc_id AS ord, text[1:strpos(concat(text, chr(10)), chr(10)) - 1] AS title, replace(text[strpos(concat(text, chr(10)), chr(10)) + 1:], chr(10), ' ') AS summary, lang, source, CAST(replace(source, 'src', '') AS INT) AS no FROM documents),
it AS (SELECT *, concat(title, ' ', summary) AS whole, ['specialist', 'general', 'aggregator', 'press'][no % 4 + 1] AS kind, ord * 7 AS pub FROM i),
t AS (SELECT *, string_split_regex(lower(title), '[^a-z0-9]+') AS tw, string_split_regex(lower(summary), '[^a-z0-9]+') AS sw, string_split_regex(lower(whole), '[^a-z0-9]+') AS ww FROM it)"""
WEIGHTS = {"that": 2, "with": 1, "license": 3, "of": -1, "der": 1, "que": 1, "###": -4, "trash": -3}


def holds(words: str, text: str, word: str) -> str:
    return f"list_contains({words}, '{word}')" if word.isalpha() else f"contains({text}, '{word}')"


SCORE = " + ".join(f"CASE WHEN {holds('tw', 'title', w)} THEN {v * (2 if v > 0 else 1)} WHEN {holds('sw', 'summary', w)} THEN {v} ELSE 0 END" for w, v in WEIGHTS.items())
SCORED = f"{ITEMS}, s AS (SELECT *, {SCORE} AS score FROM t)"
EVENTS = "WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(floor(epoch(ts)) AS BIGINT) // 86400 AS day FROM events)"

ORACLES = {
    "score_threshold_topk": f"{SCORED} SELECT ord, kind, CAST(score AS BIGINT) AS score FROM s WHERE score >= MAP {{'specialist': -99, 'general': 3, 'aggregator': 4, 'press': 6}}[kind] ORDER BY ord DESC LIMIT 6000",
    "keyword_flags": f"{ITEMS} SELECT ord, " + ", ".join(f"{holds('ww', 'whole', w)} AS f{i}" for i, w in enumerate(WEIGHTS)) + ", FALSE AS none FROM t",
    "hard_exclude": f"{ITEMS} SELECT ord, contains(upper(title), 'THE THE THE') OR contains(title, '!!') OR list_has_any(ww, ['idiot', 'scum']) AS excluded FROM t",
    "off_topic_filter": f"{SCORED} SELECT ord FROM s WHERE score > 0 OR list_has_any(tw, ['with', 'que']) OR NOT (contains(title, 'Der ') OR len(list_filter(string_split_regex(title, '[^A-Za-z]+'), lambda w: regexp_matches(w, 'Th[a-z]+ing'))) > 0)",
    "multilabel_tags_exploded": f"{ITEMS}, c(tag, words) AS (VALUES ('law', ['license', 'licensed']), ('motion', ['in', 'from', 'to']), ('link', ['and', 'und', 'et', 'y']), ('place', ['at', 'on', 'la', 'der'])) SELECT tag, lang, count(*) AS n FROM t JOIN c ON list_has_any(ww, words) GROUP BY tag, lang",
    "tag_exclusion_terms": f"{ITEMS}, p(plat, words, gone) AS (VALUES ('alpha', ['the'], ['the the']), ('beta', ['is', 'was'], ['it is']), ('gamma', ['de'], ['de la', 'de los'])), x AS (SELECT ord, plat, words, list_reduce(list_concat([whole], gone), lambda a, b: replace(a, b, '')) AS rest FROM t, p) SELECT plat, count(*) AS n, min(ord) AS first_ord FROM x WHERE list_has_any(string_split_regex(lower(rest), '[^a-z0-9]+'), words) GROUP BY plat",
    "decision_list_flag": f"{ITEMS} SELECT ord, list_has_any(ww, ['stupid', 'clown']) AND NOT list_contains(ww, 'license') OR NOT list_has_any(ww, ['license', 'with']) AND (list_contains(ww, 'worthless') OR list_contains(ww, 'of') AND list_contains(ww, 'that')) AS spoiler FROM t",
    "text_query": f"{ITEMS} SELECT ord FROM t WHERE lower(concat(whole, ' ', source)) LIKE '%the%' AND lower(concat(whole, ' ', source)) LIKE '%tion%' AND lower(concat(whole, ' ', source)) NOT LIKE '%license%'",
    "fresh_rows": "SELECT batch, count(*) AS fresh FROM (SELECT user_id, min(event_id % 3) AS batch FROM events GROUP BY user_id) u GROUP BY batch",
    "day_runs": f"{EVENTS} SELECT event_id, day, row_number() OVER (ORDER BY day DESC, t, event_id) AS place, day IS DISTINCT FROM lag(day) OVER (ORDER BY day DESC, t, event_id) AS header FROM e",
    "page_whole_day": f"{EVENTS} SELECT event_id, day FROM e WHERE day >= (SELECT min(day) FROM (SELECT day FROM e ORDER BY day DESC LIMIT 30) u)",
    "bookmark_unread": f"{EVENTS} SELECT user_id, count(*) AS unread, min(t) AS next_t FROM e WHERE t > (SELECT max(b.t) FROM e b WHERE b.user_id = e.user_id AND b.event_type = 'purchase') GROUP BY user_id",
    "read_antijoin": "SELECT event_id, user_id FROM events e WHERE event_type = 'view' AND ts < coalesce((SELECT min(r.ts) FROM events r WHERE r.user_id = e.user_id AND r.event_type = 'click'), TIMESTAMP '9999-01-01')",
    "read_set_latest": f"{EVENTS} SELECT user_id, unnest(list(event_id ORDER BY t DESC, event_id DESC)[:4000]) AS event_id FROM e WHERE event_type = 'click' GROUP BY user_id",
    "daily_tumbling": "SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) // 86400 AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY date_trunc('day', ts), event_type",
    "session_visits": f"{EVENTS}, b AS (SELECT user_id, t FROM (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM e) u WHERE gap IS NULL OR gap >= 7200), j AS (SELECT e.user_id, e.t, b.t AS begin_t FROM e ASOF JOIN (SELECT DISTINCT user_id, t FROM b) b ON e.user_id = b.user_id AND e.t >= b.t) SELECT user_id, begin_t, max(t) AS last_t, count(*) AS n FROM j GROUP BY user_id, begin_t",
    "archive_upsert": f"{EVENTS}, r AS (SELECT user_id AS k, event_id AS ord, event_type AS title, event_id % 3 AS batch, CASE WHEN event_id % 7 <> 0 THEN t END AS pub FROM e), l AS (SELECT k, list({{'b': batch, 'o': ord, 'title': title, 'pub': pub}} ORDER BY batch, ord) AS rows FROM r GROUP BY k), a AS (SELECT k, rows[len(rows)].o AS ord, rows[len(rows)].title AS title, list_filter(rows, lambda x: x.pub IS NOT NULL)[1].pub AS pub, rows[1].b AS first_batch FROM l) SELECT k, ord, title, pub, first_batch FROM a WHERE coalesce(pub >= (SELECT max(pub) FROM a) - 2592000, TRUE)",
    "visit_days_level": f"{EVENTS} SELECT user_id, CAST(100 * len(list_distinct(list(day))) AS BIGINT) AS points, CAST(list_max(list_filter(range(1, 100), lambda l: floor(20 * power(l - 1, 1.9)) <= 100 * len(list_distinct(list(day))))) AS BIGINT) AS level FROM e GROUP BY user_id",
    "calendar_groups": "WITH x AS (SELECT o_custkey % 97 AS k, strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS verb, list({'o': o_orderkey, 's': (o_orderkey * 7) % 5 + 1} ORDER BY o_orderkey) AS l FROM orders GROUP BY 1, 2, 3) SELECT k, month, verb, CAST(list_sum(list_transform(l, lambda e: e.s)) AS BIGINT) AS sources, list_max(list_transform(list_filter(l, lambda e: e.s > coalesce(list_sum(list_transform(list_filter(l, lambda f: f.o < e.o), lambda f: f.s)), 0)), lambda e: e.o)) AS shown FROM x",
}

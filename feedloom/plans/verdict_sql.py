"""DuckDB SQL of the verdict jobs, written from what the rules mean: keywords are a table, texts are taken apart by lists.

Only the headlines (MADE) are shared with the jobs. Nothing here is made from the jobs' plans.
"""

from __future__ import annotations

from .verdicts import DECORATED, MADE


def fold(e: str) -> str:
    return f"trim(regexp_replace(array_to_string(list_transform(string_split({e}, ''), lambda c: CASE WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) WHEN c = chr(12288) THEN ' ' ELSE c END), ''), '\\s+', ' ', 'g'))"


def first_of_each(e: str) -> str:
    return f"list_filter({e}, lambda x, i: list_position({e}, x) = i)"


NUMERALS = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi"]


def key(e: str) -> str:
    k = f"replace(replace(lower({fold(e)}), 'スターサーガ', 'ss'), 'star saga', 'ss')"
    for n, r in sorted(enumerate(NUMERALS, 1), key=lambda x: -len(x[1])):
        k = f"regexp_replace({k}, '(ss|part) ?{r}([^a-z]|$)', '\\1{n}\\2', 'g')"
    return f"regexp_replace({k}, '[\\s・･:：~〜～™®]', '', 'g')"


def canonical(e: str) -> str:
    for p in ("新作", "劇場版", "映画"):
        e = f"trim(regexp_replace({e}, '^{p}(..+)$', '\\1'))"
    return f"trim(regexp_replace({e}, '(?i)\\s*\\(film\\)$', ''))"


def names(e: str, lenient: str = "FALSE") -> str:
    behind = f"list_transform(regexp_extract_all({e}, '(?:映画|作品|film)\\s*「[^」]{{1,40}}」'), lambda x: regexp_extract(x, '「([^」]*)」', 1))"
    any_short = f"list_transform(regexp_extract_all({e}, '(?:映画|作品|film)\\s*「[^」]{{1,40}}」|「[^」。、！？!?…]{{1,25}}」'), lambda x: regexp_extract(x, '「([^」]*)」', 1))"
    found = f"list_concat(list_concat(regexp_extract_all({e}, '『([^』]{{1,60}})』', 1), CASE WHEN {lenient} THEN {any_short} ELSE {behind} END), regexp_extract_all({e}, '^''([^'']{{2,60}})''', 1))"
    each = f"list_transform({found}, lambda w: {canonical(fold('w'))})"
    return f"list_filter({first_of_each(each)}, lambda w: length(w) > 1 AND w <> '未定')"


def compared(folded: str) -> str:
    """A folded title without source: its characters one by one."""
    return f"array_to_string(list_filter(string_split(lower(CASE WHEN starts_with({folded}, '【') OR starts_with({folded}, '[') THEN regexp_replace({folded}, '^.[^】\\]]*[】\\]]', '') ELSE {folded} END), ''), lambda c: NOT contains(concat(' 「」『』【】[]（）()、。！？!?・:：-—―~〜\"“”‘’…', chr(39)), c)), '')"


DEAL = """d AS (SELECT ord, t, list_filter([CASE WHEN regexp_matches(concat(t, ' ', s), 'alpha ?store', 'i') THEN 'alpha' END, CASE WHEN regexp_matches(concat(t, ' ', s), 'beta|ベータ', 'i') THEN 'beta' END], lambda x: x IS NOT NULL) AS stores,
  list_max(list_filter(list_transform(regexp_extract_all(t, '(?i)([0-9]{1,3})\\s*%\\s*(?:オフ|off|割引)', 1), lambda x: CAST(x AS BIGINT)), lambda x: x BETWEEN 1 AND 100)) AS off,
  regexp_matches(t, '無料配布|free to keep|(^|[^0-9,])0円で', 'i') AS free FROM dealt WHERE regexp_matches(t, '[0-9]+\\s*%\\s*(off|オフ)|セール|無料配布', 'i') AND NOT regexp_matches(t, '還元|console', 'i'))"""

BASE = f"""WITH {MADE},
a AS (SELECT *, regexp_replace(title, '^(Photo|写真)\\s*[|｜]\\s*', '') AS t0, coalesce(summary, '') AS s0 FROM made),
b AS (SELECT *, {fold('t0')} AS ft, {fold('s0')} AS s, CASE WHEN regexp_matches(t0, '^.*\\S\\s+-\\s+[^-]{{1,40}}$') THEN regexp_extract(t0, '^(.*\\S)\\s+-\\s+([^-]{{1,40}})$', 1) ELSE t0 END AS head FROM a),
c AS (SELECT *, trim(regexp_replace(head, '[（(][^（）()]{{1,30}}[）)]\\s*$', '')) AS mt FROM b WHERE NOT (contains(upper(ft), '[AD]') OR contains(ft, '求人') OR contains(concat(ft, ' ', s), '宝くじ') OR regexp_matches(concat(ft, ' ', s), '(^|[^A-Za-z0-9])lottery ticket($|[^A-Za-z0-9])', 'i'))),
m AS (SELECT *, {fold('mt')} AS t FROM c),
words(no, word, weight, ascii) AS (VALUES (1, 'film', 3, true), (2, 'cinema', 2, true), (3, '映画', 3, false), (4, 'premiere', 2, true), (5, '監督', 1, false), (6, 'stock price', -4, true), (7, '株価', -4, false), (8, 'recipe', -3, true), (9, 'review', 0, true)),
met AS (SELECT ord, no, word, weight, CASE WHEN ascii THEN regexp_matches(t, concat('(^|[^A-Za-z0-9])', word, '($|[^A-Za-z0-9])'), 'i') ELSE contains(lower(t), word) END AS in_t, CASE WHEN ascii THEN regexp_matches(s, concat('(^|[^A-Za-z0-9])', word, '($|[^A-Za-z0-9])'), 'i') ELSE contains(lower(s), word) END AS in_s FROM m, words),
scored AS (SELECT ord, sum(CASE WHEN in_t THEN CASE WHEN weight > 0 THEN 2 * weight ELSE weight END WHEN in_s THEN weight ELSE 0 END) AS plain, string_agg(CASE WHEN in_t OR in_s THEN word END, '|' ORDER BY no) AS hits FROM met GROUP BY ord),
n AS (SELECT m.*, plain, coalesce(hits, '') AS hits, {names('mt', "kind = 'specialist'")} AS works, {names('mt', 'TRUE')} AS sought FROM m JOIN scored ON m.ord = scored.ord WHERE NOT (regexp_matches(t, '舞台|Stage play') AND NOT (regexp_matches(t, '(^|[^A-Za-z0-9])Star Saga($|[^A-Za-z0-9])', 'i') OR contains(t, 'スターサーガ')) AND plain <= 0)),
known AS (SELECT DISTINCT {key('w')} AS k FROM (SELECT unnest({names('title', 'TRUE')}) AS w FROM made WHERE kind = 'specialist' AND lang = 'ja') u),
bonus AS (SELECT DISTINCT ord FROM (SELECT ord, {key('w')} AS k FROM (SELECT ord, unnest(sought) AS w FROM n) u) v WHERE k IN (SELECT k FROM known)),
judged AS (SELECT n.*, plain + CASE WHEN bonus.ord IS NULL THEN 0 ELSE 4 END AS score, CASE WHEN bonus.ord IS NULL THEN hits WHEN hits = '' THEN '#known-work' ELSE concat(hits, '|#known-work') END AS all_hits FROM n LEFT JOIN bonus ON n.ord = bonus.ord),
ok AS (SELECT * FROM judged WHERE kind = 'specialist' OR score >= coalesce(min_score, CASE kind WHEN 'aggregator' THEN 4 WHEN 'press' THEN 6 ELSE 3 END)),
dealt AS (SELECT ord, t, s FROM ok), {DEAL},
tags(no, id, word, ascii) AS (VALUES (1, 'release', 'release date', true), (1, 'release', '公開日', false), (2, 'event', 'festival', true), (2, 'event', '上映会', false), (3, 'trouble', 'lawsuit', true), (3, 'trouble', '訴訟', false), (4, 'sequel', 'sequel', true), (4, 'sequel', '続編', false)),
tagged AS (SELECT DISTINCT ord, no, id FROM (SELECT ord, no, id, word, ascii, CASE id WHEN 'trouble' THEN regexp_replace(t, '『[^』]*』|「[^」]*」', ' ', 'g') WHEN 'sequel' THEN replace(concat(t, ' ', s), '続編未定', ' ') ELSE concat(t, ' ', s) END AS x FROM ok, tags) u WHERE CASE WHEN ascii THEN regexp_matches(x, concat('(^|[^A-Za-z0-9])', word, '($|[^A-Za-z0-9])'), 'i') ELSE contains(lower(x), word) END
  UNION SELECT ord, 5, 'sale' FROM d),
cats AS (SELECT ord, string_agg(id, '|' ORDER BY no) AS cats, list(id) AS ids FROM tagged GROUP BY ord),
full_ok AS (SELECT ok.*, coalesce(cats.cats, '') AS cats, cats.ids, d.ord IS NOT NULL AS is_deal, d.stores,
  CASE WHEN lower({fold('source')}) IN ('portal news', 'まとめ') THEN TRUE ELSE regexp_extract(link, '^https://([^/]+)/', 1) IN ('example.org', 'portal.example.com') OR regexp_matches(regexp_extract(link, '^https://([^/]+)/', 1), '\\.(example\\.org|portal\\.example\\.com)$') END AS synd
  FROM ok LEFT JOIN cats ON ok.ord = cats.ord LEFT JOIN d ON ok.ord = d.ord)"""

PLATS = """array_to_string(list_filter([
  CASE WHEN regexp_matches(replace(concat(t, ' ', s), 'home theatre', ' '), '(^|[^A-Za-z0-9])theatre($|[^A-Za-z0-9])', 'i') OR contains(concat(t, ' ', s), '劇場') THEN 'theatre' END,
  CASE WHEN regexp_matches(concat(t, ' ', s), '(^|[^A-Za-z0-9])stream 2($|[^A-Za-z0-9])', 'i') THEN 'stream2' END,
  CASE WHEN regexp_matches(replace(concat(t, ' ', s), 'Stream 2', ' '), '(^|[^A-Za-z0-9])stream($|[^A-Za-z0-9])', 'i') THEN 'stream' END,
  CASE WHEN regexp_matches(concat(t, ' ', s), '(^|[^A-Za-z0-9])(blu-ray|dvd)($|[^A-Za-z0-9])', 'i') OR contains(concat(t, ' ', s), '円盤') THEN 'disc' END], lambda x: x IS NOT NULL), '|')"""
SPOILER = """CASE WHEN regexp_matches(t, 'spoiler[- ]free|ネタバレなし', 'i') THEN FALSE WHEN regexp_matches(t, 'spoilers? ahead|ネタバレ注意', 'i') THEN TRUE WHEN regexp_matches(t, 'trailer|予告', 'i') THEN FALSE
  WHEN regexp_matches(t, 'ending explained|結末', 'i') THEN TRUE ELSE regexp_matches(t, 'episode [0-9]+|第[0-9]+話', 'i') AND regexp_matches(t, 'reactions?|感想', 'i') END"""
SHOWN = """CASE WHEN synd AND regexp_matches(t0, '[（(][^（）()]{1,30}[）)]\\s*$') THEN concat(trim(regexp_extract(t0, '[（(]([^（）()]{1,30})[）)]\\s*$', 1)), '（', source, '）') ELSE source END"""
#: The shown spelling of every name: most frequent, then shorter, then first.
VOTED = f"""spelled AS (SELECT ord, generate_subscripts(works, 1) AS pos, unnest(works) AS w FROM full_ok),
votes AS (SELECT w, count(*) AS n, min(ord * 1000 + pos) AS met, {key('w')} AS k FROM spelled GROUP BY w),
best AS (SELECT k, w AS shown FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, length(w), met) AS r FROM votes) u WHERE r = 1),
named AS (SELECT DISTINCT ord, shown, min(pos) AS pos FROM spelled JOIN votes ON spelled.w = votes.w JOIN best ON votes.k = best.k GROUP BY ord, shown)"""
PAGES = f"""{VOTED}, counted AS (SELECT shown AS name, count(*) AS n, regexp_replace(regexp_replace(trim(regexp_replace(shown, '[/?#%&:*"<>|\\s.,!！?？’`^~{{}}\\[\\]()（）【】「」『』〈〉'']+', '-', 'g')), '-+', '-', 'g'), '^-|-$', '', 'g') AS base FROM named GROUP BY shown HAVING count(*) >= 2),
placed AS (SELECT name, n, row_number() OVER (ORDER BY n DESC, name COLLATE ja, name) AS place, base FROM counted),
paged AS (SELECT name, n, place, CASE WHEN row_number() OVER (PARTITION BY base ORDER BY place) = 1 THEN base ELSE concat(base, '-', row_number() OVER (PARTITION BY base ORDER BY place)) END AS slug FROM placed)"""

ORACLES = {
    "item_verdict": f"{BASE} SELECT ord, CAST(score AS BIGINT) AS score, all_hits AS hits, cats, {PLATS} AS plats, array_to_string(works, '|') AS works, {SPOILER} AS spoiler, synd AS syndicated, {SHOWN} AS shown_source FROM full_ok",
    "compared_titles": f"WITH {MADE}, {DECORATED}, h AS (SELECT ord, CASE WHEN regexp_matches(t, '^.*\\S\\s+-\\s+[^-]{{1,40}}$') THEN regexp_extract(t, '^(.*\\S)\\s+-\\s+([^-]{{1,40}})$', 1) ELSE t END AS t FROM decorated), f AS (SELECT ord, {fold("trim(regexp_replace(t, '[（(][^（）()]{1,30}[）)]\\s*$', ''))")} AS t FROM h), k AS (SELECT ord, {compared('t')} AS norm FROM f) SELECT ord, norm, length(norm) AS n FROM k",
    "truncated_titles": f"WITH {MADE}, {DECORATED}, c AS (SELECT ord, string_split(substr(t, 1, CAST(3 + ord % 40 AS INT)), '') AS c FROM decorated), n AS (SELECT ord, list_transform(['『』', '「」', '【】', '（）', '《》', '〈〉'], lambda b: len(list_filter(c, lambda x: x = b[1])) - len(list_filter(c, lambda x: x = b[2]))) AS open FROM c) SELECT ord, list_max(open) > 0 AS truncated FROM n",
    "text_fold": f"WITH {MADE}, x AS (SELECT ord, concat(chr(12288), ' ', title, ' ！', chr(9), '～') AS t FROM made) SELECT ord, {fold('t')} AS folded FROM x",
    "work_keys": f"WITH {MADE}, x AS (SELECT ord, generate_subscripts(w, 1) - 1 AS place, unnest(w) AS work FROM (SELECT ord, {names('title')} AS w FROM made) u) SELECT ord, CAST(place AS BIGINT) AS place, work, {key('work')} AS key FROM x",
    "deals_found": f"WITH {MADE}, dealt AS (SELECT ord, {fold('title')} AS t, {fold('coalesce(summary, chr(32))')} AS s FROM made), {DEAL} SELECT ord, array_to_string(stores, '|') AS stores, off, free, CASE WHEN free THEN 'Free' WHEN off IS NOT NULL THEN concat('-', off, '%') ELSE 'Sale' END AS label FROM d",
    "current_deals": f"{BASE} SELECT ord, pub, cats FROM full_ok WHERE is_deal AND lang = 'ja' AND (pub IS NULL OR pub >= (SELECT max(pub) FROM full_ok) - 604800) AND NOT list_contains(ids, 'trouble')",
    "deal_feeds": f"{BASE} SELECT feed, count(*) AS n FROM (SELECT unnest(list_concat(['all'], stores)) AS feed FROM full_ok WHERE is_deal) u GROUP BY feed",
    "run_report": f"{BASE}, registry AS (SELECT concat('f', (k * 4) % 10) AS feed, CAST(k AS BIGINT) AS place FROM range(10) r(k) WHERE k <> 3) SELECT feed, place, (SELECT count(*) FROM made WHERE made.feed = registry.feed) AS archived, (SELECT count(*) FROM full_ok WHERE full_ok.feed = registry.feed) AS accepted FROM registry",
    "run_totals": f"{BASE}, g AS (SELECT lang, {compared('t')} AS k, count(*) AS n, sum(CASE WHEN synd THEN 1 ELSE 0 END) AS s FROM full_ok GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS accepted, count(*) AS shown, CAST(sum(n) - count(*) AS BIGINT) AS merged, CAST(sum(s) AS BIGINT) AS reposts, CAST(sum(CASE WHEN n = s THEN 1 ELSE 0 END) AS BIGINT) AS reposts_left FROM g",
    "display_names": f"{BASE}, {VOTED} SELECT full_ok.ord, coalesce(string_agg(shown, '|' ORDER BY pos), '') AS works FROM full_ok LEFT JOIN named ON full_ok.ord = named.ord GROUP BY full_ok.ord",
    "work_pages": f"{BASE}, {PAGES} SELECT name, n, place, slug FROM paged",
    "published_feeds": f"""{BASE}, p AS (SELECT *, string_split({PLATS}, '|') AS ps, coalesce(ids, []) AS tags FROM full_ok), f AS (SELECT 'all' AS feed, ord, pub, works, tags FROM p UNION ALL SELECT concat('category/', unnest(tags)), ord, pub, works, tags FROM p UNION ALL SELECT concat('platform/', x), ord, pub, works, tags FROM (SELECT *, unnest(ps) AS x FROM p) u WHERE x <> ''
  UNION ALL SELECT concat('deal/', unnest(list_concat(['all'], stores))), ord, pub, works, tags FROM p WHERE is_deal), k AS (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY pub DESC NULLS LAST, ord) AS r FROM f) SELECT feed, count(*) AS entries, CAST(sum(len(works) + len(tags)) AS BIGINT) AS categories FROM k WHERE r <= 50 GROUP BY feed""",
    "rules_changed": f"{BASE}, c2 AS (SELECT ord, coalesce(kind = 'specialist' OR score >= coalesce(min_score, CASE kind WHEN 'aggregator' THEN 4 WHEN 'press' THEN 6 ELSE 3 END), FALSE) AS was, coalesce(kind = 'specialist' OR score >= coalesce(min_score, CASE kind WHEN 'aggregator' THEN 2 WHEN 'press' THEN 6 ELSE 8 END), FALSE) AS now FROM judged) SELECT ord, was, now FROM c2 WHERE was <> now",
    "work_list": f"{BASE}, {PAGES} SELECT name, n, n / (SELECT greatest(1, max(n)) FROM paged) AS bar FROM paged WHERE contains(lower(name), 'red')",
    "calendar_of_pages": f"{BASE}, {PAGES}, firsts AS (SELECT ord, arg_min(shown, pos) AS first FROM named GROUP BY ord) SELECT first AS subject, '1970-12-10' AS date, 'open' AS verb, count(*) AS sources, slug FROM full_ok JOIN firsts ON full_ok.ord = firsts.ord JOIN paged ON firsts.first = paged.name WHERE full_ok.ord % 24 = 0 AND lang = 'ja' AND pub IS NOT NULL GROUP BY first, slug",
    "item_slugs": f"{BASE}, {PAGES}, firsts AS (SELECT ord, arg_min(shown, pos) AS first FROM named GROUP BY ord) SELECT full_ok.ord, slug FROM full_ok LEFT JOIN firsts ON full_ok.ord = firsts.ord LEFT JOIN paged ON firsts.first = paged.name",
}

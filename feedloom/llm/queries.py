"""One query an operator over its whole table, with the digests that the contracts name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontam, filter_audit, licenses, mixing, near_dedup, pii, quality, secret_scan, simhash, substring_dedup, token_count, toxicity
from .common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.scan(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.scan(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "toxic_spans")


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "n_shards", "runs")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.scan(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scan(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_secrets, op3_quality, op4_decontam, op5_substring_dedup, op6_toxicity, op7_token_count, op8_near_dedup, op9_mixing, op10_licenses, op11_simhash, op12_filter_audit, op13_alignment)}

#: DuckDB SQL of the queries that SQL can express.
ORACLES = {
    "op4_decontam": r"""
WITH iw AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, w[i + 1 : least(i + 10, len(w))] AS win FROM iw, unnest(generate_series(0, greatest(0, len(w) - 10))) AS g(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
lens AS (SELECT DISTINCT len(win) AS n FROM wins),
dp AS (SELECT doc_id, n, i, w[i + 1 : i + n] AS win FROM dw, lens, unnest(generate_series(0, len(w) - n)) AS g(i) WHERE len(w) >= n),
hit AS (SELECT dp.doc_id, dp.i, dp.n, wins.item_id FROM dp JOIN wins ON dp.win = wins.win),
pos AS (SELECT DISTINCT doc_id, p FROM hit, unnest(generate_series(i, i + n - 1)) AS g(p)),
nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
ni AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
""",
    "op12_filter_audit": r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
m AS (SELECT doc_id, part, CAST(len(ws) < 200 AS INT) AS a, CAST(100 * len(list_distinct(ws)) < 50 * len(ws) AS INT) AS b, CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INT) AS c,
    CAST(regexp_matches(t, '[#$%&*|]') AS INT) AS d, CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INT) AS e FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT f1.x || f2.x || f3.x || f4.x || f5.x AS filter_order FROM f f1 JOIN f f2 ON f2.x <> f1.x JOIN f f3 ON f3.x NOT IN (f1.x, f2.x) JOIN f f4 ON f4.x NOT IN (f1.x, f2.x, f3.x) JOIN f f5 ON f5.x NOT IN (f1.x, f2.x, f3.x, f4.x)),
s AS (SELECT g.*, substring('A', 1, a) || substring('B', 1, b) || substring('C', 1, c) || substring('D', 1, d) || substring('E', 1, e) AS fails, filter_order, CAST(step AS INT) AS step, filter_order[step] AS x, filter_order[1 : step - 1] AS earlier FROM g, o, unnest([1, 2, 3, 4, 5]) AS u(step)),
r AS (SELECT *, contains(fails, x) AS hit, len(list_filter(regexp_split_to_array(earlier, ''), lambda y: y <> '' AND contains(fails, y))) > 0 AS gone FROM s),
t AS (SELECT part, filter_order, step, x, sum(n) FILTER (WHERE NOT gone AND NOT hit) AS kept, sum(n) FILTER (WHERE NOT gone AND hit) AS removed, sum(n) FILTER (WHERE gone AND hit) AS redundant, sum(n) FILTER (WHERE fails = x) AS unique_fails,
    sum(n_good) FILTER (WHERE NOT gone AND hit) AS good_lost, sum(n_toxic) FILTER (WHERE NOT gone AND hit) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, x), 0) AS BIGINT) AS shapley FROM t
""",
}

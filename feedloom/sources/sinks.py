"""Whole-document sinks: one RSS document a feed, a site map, and an archive; documents and archive are replaced as a whole."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .feeds import all_versions, versions

FEED_LIMIT = 50


def escaped(c: Column) -> Column:
    """Text for XML; control characters that XML forbids are dropped."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def rss_documents(items: DataFrame, feed: str, limit: int = FEED_LIMIT) -> DataFrame:
    """(feed, xml): the newest items (title, link, pub, summary, ord) of each feed; undated last, ties by ord. A feed gathers `limit` rows at most.

    If items have them, works and cats become categories, and the names of other sources that are no reposts follow the summary.
    """
    none = F.array().cast("array<string>")
    tags = F.concat(*(F.coalesce(F.col(c), none) if c in items.columns else none for c in ("works", "cats")))
    also = F.transform(F.filter(F.slice("sources", 2, F.greatest(F.size("sources"), F.lit(1))), lambda s: ~F.coalesce(s["syndicated"], F.lit(False))), lambda s: s["name"]) if "sources" in items.columns else none
    told = F.concat_ws(" ", "summary", F.when(F.size(also) > 0, F.concat(F.lit("("), F.array_join(also, ", "), F.lit(")"))))
    x = items.withColumn("feed", F.col(feed)).where("feed IS NOT NULL").select("feed", "title", "link", "pub", told.alias("summary"), tags.alias("tags"), "ord")
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("feed").orderBy(F.desc_nulls_last("pub"), "ord"))).where(F.col("k") <= limit)
    date = F.coalesce(F.concat(F.lit("<pubDate>"), F.date_format(F.timestamp_seconds("pub"), "EEE, dd MMM yyyy HH:mm:ss Z"), F.lit("</pubDate>")), F.lit(""))
    item = F.concat(F.lit("<item><title>"), escaped(F.col("title")), F.lit("</title><link>"), escaped(F.col("link")), F.lit("</link>"), date, F.array_join(F.transform("tags", lambda t: F.concat(F.lit("<category>"), escaped(t), F.lit("</category>"))), ""), F.lit("<description>"), escaped(F.col("summary")), F.lit("</description></item>"))
    body = F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("x")))), lambda s: s["x"]))
    return x.groupBy("feed").agg(body.alias("body")).select("feed", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"><channel><title>'), escaped(F.col("feed")), F.lit("</title>\n"), "body", F.lit("\n</channel></rss>")).alias("xml"))


def site_map(pages: DataFrame) -> DataFrame:
    """One XML row a page (loc, lastmod in seconds)."""
    return pages.select(F.concat(F.lit("<url><loc>"), escaped(F.col("loc")), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), F.date_format(F.timestamp_seconds("lastmod"), "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("</lastmod>")), F.lit("")), F.lit("</url>")).alias("xml"))


def replaced(write, spark: SparkSession, path: str, keep: int) -> str:
    """A new version at `path`, which write(folder) fills; it counts once it is whole, and a write that fails leaves what was there. `keep` whole versions stay."""
    old = versions(spark, path)
    n = 1 + max(all_versions(spark, path), default=0)
    write(new := f"{path.rstrip('/')}/version={n:09d}")
    P = spark._jvm.org.apache.hadoop.fs.Path
    for p in old[keep - 1 :]:
        P(p).getFileSystem(spark._jsc.hadoopConfiguration()).delete(P(p), True)
    return new


def replace_archive(df: DataFrame, path: str) -> None:
    """A new version of the archive at `path`, which df may read from. It counts once it is whole; only then older ones go, so a crash at any point leaves a table to read."""
    replaced(lambda new: df.write.parquet(new), df.sparkSession, path, 1)


def write_documents(docs: DataFrame, path: str) -> str:
    """All documents (feed, xml) as a new version, one file a document in a folder named by its feed; returns the version's folder.

    A set of documents is whole or not there: until Spark has committed the last file, and if a task fails for good, readers get the set
    before. That one stays beside the new one for readers that have begun on it. Rows of a null feed are one feed; of several rows of a
    feed, all lines stay, in one file.
    """
    lines = docs.repartition("feed").select("feed", F.col("xml").alias("value"))
    return replaced(lambda new: lines.write.partitionBy("feed").option("lineSep", "\n").text(new), docs.sparkSession, path, 2)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(feed, xml) of the newest whole set; no rows if there is none."""
    whole = versions(spark, path)
    if not whole:
        return spark.createDataFrame([], "feed string, xml string")
    read = spark.read.schema("value string, feed string").text(whole[0], wholetext=True)
    return read.select("feed", F.regexp_replace("value", r"\n\z", "").alias("xml"))


def envelope(items: DataFrame, generated: str, **parts: DataFrame) -> DataFrame:
    """One JSON document a run (column `value`), a row for each line: a head with the number of items and the small parts, then the items one by one, so that no task holds them all."""
    n = items.count()
    head = {"generatedAt": generated, "count": n} | {k: [r.asDict(True) for r in v.collect()] for k, v in parts.items()}
    first = json.dumps(head, ensure_ascii=False, default=str)[:-1] + ', "items": ['
    lines = items.select(F.to_json(F.struct(*items.columns), {"ignoreNullFields": "false"}).alias("value"), F.row_number().over(Window.orderBy(F.desc_nulls_last("pub"), "ord")).alias("k"))  # bounded by the run's limit of items
    body = lines.select("k", F.concat("value", F.when(F.col("k") < n, ",").otherwise("")).alias("value"))
    ends = items.sparkSession.createDataFrame([(0, first), (n + 1, "]}")], "k int, value string")
    return body.unionByName(ends).orderBy("k").select("value")

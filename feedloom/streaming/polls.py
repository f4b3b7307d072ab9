"""Polls of feeds as a stream: what was fetched is committed first, and each entry passes on once.

A feed on the network can't be read a second time as it was, so a stream can't replay it. write_poll() therefore writes what one poll
fetched under `polls/poll=n`, by Spark's own commit of files (of several attempts at a task one counts), and new_entries() is a stream over these
files: its log replays a broken micro-batch with the same rows, and the file sink's log keeps a batch from being written twice. A
key (feed, link) is new once; its state goes KEEP_DAYS after the poll that it came with, and an entry that a feed still offers then is new again.

hourly() is one run of a schedule. It first passes on what a run that was broken off has left, then polls, then passes that on, so each
micro-batch holds one poll and the poll that an entry came with doesn't depend on where a run was broken off. A poll that was broken off while
its files were committed counts with the files it has; the next poll brings the rest.

Entries without a title or link are not rows of a poll; of equal links in one document the first counts; a feed that failed is a row with
`error` in its poll, which passes on nothing. Null feeds are one feed. Empty polls are polls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import feeds

POLL = f"{feeds.SCHEMA}, polled long"
ENTRIES = f"{POLL}, poll int"
KEEP_DAYS = 30


def next_poll(spark: SparkSession, folder: str) -> int:
    """One more than the highest number there, whole or not."""
    top = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/polls")
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    return 1 + max((int(n.removeprefix("poll=")) for n in names if n.startswith("poll=")), default=-1)


def write_poll(rows: DataFrame, folder: str, polled: int) -> int:
    """Commits one poll's rows (feeds.SCHEMA), fetched at `polled` (seconds since 1970, above 0), and returns its number."""
    n = next_poll(rows.sparkSession, folder)
    rest = [c for c in rows.columns if c not in ("feed", "link", "place")]
    first = rows.groupBy("feed", "link").agg(F.min_by(F.struct("place", *rest), F.coalesce("place", F.lit(-1))).alias("r")).select("feed", "link", "r.*")
    first.select(*(c.split()[0] for c in feeds.SCHEMA.split(", ")), F.lit(polled).cast("long").alias("polled")).write.parquet(f"{folder}/polls/poll={n}")
    return n


def new_entries(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of entries that no earlier poll had. A stop of more than KEEP_DAYS loses polls that are older than that."""
    polls = spark.readStream.schema(ENTRIES).option("maxFileAge", f"{KEEP_DAYS}d").parquet(f"{folder}/polls")
    dated = polls.where("error IS NULL").withColumn("at", F.timestamp_seconds("polled"))
    return dated.withWatermark("at", f"{KEEP_DAYS} days").dropDuplicatesWithinWatermark(["feed", "link"]).drop("at")


def pass_on(spark: SparkSession, folder: str) -> None:
    """Appends to `entries` what is new in the polls that have not been passed on."""
    if next_poll(spark, folder):
        out = new_entries(spark, folder).writeStream.outputMode("append").format("parquet")
        out.option("path", f"{folder}/entries").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()


def hourly(spark: SparkSession, rows: DataFrame, folder: str, polled: int) -> DataFrame:
    """One run: `rows` are those of feeds.scan() or feeds.stored_feeds(); returns all entries so far."""
    pass_on(spark, folder)
    write_poll(rows, folder, polled)
    pass_on(spark, folder)
    return entries(spark, folder)


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """All entries passed on so far, each with its first poll."""
    return spark.read.schema(ENTRIES).parquet(f"{folder}/entries")


def failures(spark: SparkSession, folder: str) -> DataFrame:
    """(feed, first_poll, last_poll, n, error): feeds that failed, with the number of polls and the last one's error."""
    polls = spark.read.schema(ENTRIES).parquet(f"{folder}/polls").where("error IS NOT NULL")
    return polls.groupBy("feed").agg(F.min("poll").alias("first_poll"), F.max("poll").alias("last_poll"), F.count_distinct("poll").alias("n"), F.max_by("error", "poll").alias("error"))

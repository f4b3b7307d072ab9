"""The archive as a stream: keyed upsert with retention by micro-batch, and counts by event-time day under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEEP_SECONDS = 30 * 86400
STATE = "k long, ord long, title string, pub long, first_batch long, batch long"


def merged(rows: DataFrame) -> DataFrame:
    """One row a key: the newest row's columns, but the first known pub and the first batch. One shuffle, combined before it."""
    order = F.struct("batch", "ord")
    return rows.groupBy("k").agg(
        F.max_by(F.struct("ord", "title", "batch"), order).alias("n"), F.min_by("pub", F.when(F.col("pub").isNotNull(), order)).alias("pub"), F.min("first_batch").alias("first_batch")
    ).select("k", "n.ord", "n.title", "pub", "first_batch", "n.batch")


def first_seen(rows: DataFrame, now: int) -> DataFrame:
    """k, first_seen: when a key was first met. rows: k, batch, ord, pub, first_seen (null in a new row, and in old rows that never had one).

    A row of the archive keeps its own; if it has none, its time of publication stands in once the key is met again, else now; a new key
    is first seen now.
    """
    order = F.struct("batch", "ord")
    x = rows.groupBy("k").agg(F.min_by(F.struct("batch", "pub", "first_seen"), order).alias("old"), F.count(F.lit(1)).alias("n"))
    old = F.col("old.batch") < 0
    return x.select("k", F.when(old & (F.col("n") > 1), F.coalesce("old.first_seen", "old.pub", F.lit(now))).when(old, F.col("old.first_seen")).otherwise(F.lit(now)).cast("long").alias("first_seen"))


def retained(rows: DataFrame, keep: int = KEEP_SECONDS) -> DataFrame:
    """Rows at most `keep` seconds older than the newest; undated rows stay."""
    newest = rows.agg(F.max("pub").alias("newest"))
    return rows.crossJoin(F.broadcast(newest)).where(F.col("pub").isNull() | (F.col("pub") >= F.col("newest") - keep)).drop("newest")


def run_upsert(stream: DataFrame, path: str) -> DataFrame:
    """Runs all that the stream has (k, ord, title, pub, batch) into a table at `path` and returns it.

    Version n of the table is a function of version n - 1 and batch n, so a batch that is run again after a failure gives the same.
    """
    spark = stream.sparkSession
    P, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()

    def version(n: int) -> str:
        return f"{path}/version={n:09d}"

    def step(batch: DataFrame, n: int) -> None:
        rows = batch.select("k", "ord", "title", "pub", F.col("batch").alias("first_batch"), "batch")
        if n:
            rows = batch.sparkSession.read.schema(STATE).parquet(version(n - 1)).unionByName(rows)
        retained(merged(rows)).write.mode("overwrite").parquet(version(n))
        if n > 1:
            P(path).getFileSystem(conf).delete(P(version(n - 2)), True)

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    last = q.lastProgress["batchId"] if q.lastProgress else 0
    fs = P(path).getFileSystem(conf)
    while last >= 0 and not fs.exists(P(version(last))):
        last -= 1
    return spark.read.schema(STATE).parquet(version(last)) if last >= 0 else spark.createDataFrame([], STATE)


def run_daily_counts(stream: DataFrame, path: str, late: str = "1 day") -> DataFrame:
    """(day, event_type, n) of days that the watermark has passed; stream has ts and event_type. Later rows of such days are dropped."""
    days = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return run_append(days.select(F.floor(F.unix_seconds("w.start") / 86400).alias("day"), "event_type", "n"), path, "day long, event_type string, n long")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as a stream; times carry no zone and count as UTC."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern may name a file, a plain path may not
    return raw.withColumn("secs", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")).withColumn("ts", F.timestamp_seconds("secs"))


def run_append(stream: DataFrame, path: str, schema: str) -> DataFrame:
    """Runs all that the stream has into a table of appended rows at `path` and returns it."""
    stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/rows")


def run_sliding_counts(stream: DataFrame, path: str, span: str = "3 days", step: str = "1 day", late: str = "1 day") -> DataFrame:
    """(begin, event_type, n) of overlapping windows that the watermark has passed; begin in seconds."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", span, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return run_append(w.select(F.unix_seconds("w.start").alias("begin"), "event_type", "n"), path, "begin long, event_type string, n long")


def run_interval_pairs(left: DataFrame, right: DataFrame, path: str, seconds: int = 3600, late: str = "1 day") -> DataFrame:
    """(user_id, a, b): events of two streams by one user, b from a on and at most `seconds` later. Both sides' state is bounded by the watermarks and the interval."""
    a = left.select("user_id", F.col("event_id").alias("a"), F.col("ts").alias("ts_a")).withWatermark("ts_a", late)
    b = right.select(F.col("user_id").alias("user_b"), F.col("event_id").alias("b"), F.col("ts").alias("ts_b")).withWatermark("ts_b", late)
    near = F.expr(f"user_id = user_b AND ts_b >= ts_a AND ts_b <= ts_a + interval {seconds} seconds")
    return run_append(a.join(b, near).select("user_id", "a", "b"), path, "user_id long, a long, b long")

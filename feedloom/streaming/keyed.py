"""The archive as keyed state, and visits as session windows.

run_keyed() holds one value a key in Spark's state store: the newest row's columns, the first known time and the first batch. A micro-batch
touches the keys that it names alone; what changed is appended to a table, exactly once (the file sink's log), and archive_of() reads the last change of
each key. A key with a time has an event-time timer: once the newest time is more than KEEP_SECONDS later, it goes, and its state with it; a
key that is met again after that is new. Keys without a time have no timer and stay. Rows whose time lies that far back on arrival are late and
dropped by the watermark. The result does not depend on how rows are split into micro-batches, nor on a restart from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .archive import KEEP_SECONDS, retained, run_append

STATE = "ord long, title string, batch long, pub long, pub_batch long, pub_ord long, first_batch long"
CHANGE = "k long, ord long, title string, pub long, first_batch long, batch long, changed long, gone boolean"


def _known(x):
    return None if pd.isna(x) else int(x)


def upserted(held: tuple | None, rows: pd.DataFrame) -> tuple:
    """The state after rows (ord, title, pub, batch), whatever their order."""
    new = rows.sort_values(["batch", "ord"])
    last = new.iloc[-1]
    first_batch = int(new["batch"].min())
    dated = new[new["pub"].notna()]
    pub = (int(dated.iloc[0]["batch"]), int(dated.iloc[0]["ord"]), int(dated.iloc[0]["pub"])) if len(dated) else None
    top = (int(last["batch"]), int(last["ord"]), last["title"] if isinstance(last["title"], str) else None)
    if held:
        ord_, title, batch, old, old_batch, old_ord, first = held
        first_batch = min(first_batch, first)
        if (batch, ord_) > top[:2]:
            top = (batch, ord_, title)
        if old is not None and (pub is None or (old_batch, old_ord) < pub[:2]):
            pub = (old_batch, old_ord, old)
    pub_batch, pub_ord, at = pub or (None, None, None)
    return top[1], top[2], top[0], at, pub_batch, pub_ord, first_batch


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, columns = state.getCurrentProcessingTimeMs(), [c.split()[0] for c in CHANGE.split(", ")]
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame([(key[0], None, None, None, None, None, now, True)], columns=columns).astype({"ord": "Int64", "pub": "Int64", "first_batch": "Int64", "batch": "Int64"})
        return
    held = tuple(state.get) if state.exists else None
    held = held and (held[0], held[1], held[2], _known(held[3]), _known(held[4]), _known(held[5]), held[6])
    for rows in batches:
        held = upserted(held, rows)
    state.update(held)
    if held[3] is not None:
        state.setTimeoutTimestamp(max(1000 * held[3] + 1, state.getCurrentWatermarkMs() + 1))
    row = (key[0], held[0], held[1], held[3], held[6], held[2], now, False)
    yield pd.DataFrame([row], columns=columns).astype({"pub": "Int64"})


def run_keyed(stream: DataFrame, path: str, keep: int = KEEP_SECONDS) -> DataFrame:
    """Runs all that the stream has (k, ord, title, pub, batch) through the state at `path`, and returns the archive. It may be called again with more rows."""
    rows = stream.withColumn("at", F.timestamp_seconds("pub")).withWatermark("at", f"{keep} seconds")
    changes = rows.groupBy("k").applyInPandasWithState(_step, CHANGE, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return archive_of(run_append(changes, path, CHANGE), keep)


def archive_of(changes: DataFrame, keep: int = KEEP_SECONDS) -> DataFrame:
    """The last state of each key that is not gone; keys whose timer is due but has not rung yet go too."""
    last = changes.groupBy("k").agg(F.max_by(F.struct("ord", "title", "pub", "first_batch", "batch", "gone"), "changed").alias("x"))
    return retained(last.where("NOT x.gone").select("k", "x.ord", "x.title", "x.pub", "x.first_batch", "x.batch"), keep)


def run_sessions(stream: DataFrame, path: str, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """(user_id, begin_t, last_t, n): visits that end where the next event of the user is `gap` or more away, once the watermark has passed their end. Rows later than the watermark are dropped."""
    # Spark joins events that are just the gap apart, so that its gap is the least time shorter
    w = stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", f"{gap} -1 microseconds").alias("w")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return run_append(w.select("user_id", F.unix_seconds("a").alias("begin_t"), F.unix_seconds("b").alias("last_t"), "n"), path, "user_id long, begin_t long, last_t long, n long")


def stored_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of Parquet files as a stream, one file a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

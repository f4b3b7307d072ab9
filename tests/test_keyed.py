"""The keyed archive against the upsert over a whole table, over any split and after a restart; session windows with late rows."""

import datetime
import random

import pytest

from feedloom.streaming import archive, keyed

ROWS = "k long, ord long, title string, pub long, batch long"
DAY = 86400
T = 1000 * DAY


def whole(spark, rows):
    x = spark.createDataFrame([(*r, r[4]) for r in rows], ROWS + ", first_batch long")
    return sorted(map(tuple, archive.retained(archive.merged(x)).select("k", "ord", "title", "pub", "first_batch").collect()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    return [(rng.randrange(25), o, f"t{o}", rng.choice([None, rng.randrange(29 * DAY)]), o // 20) for o in range(120)]


def fed(spark, path, parts):
    for part in parts:
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(path)


def got(df):
    return sorted(map(tuple, df.select("k", "ord", "title", "pub", "first_batch").collect()))


@pytest.mark.parametrize("split", ["in order", "shuffled"])
def test_any_split_and_a_restart(spark, rows, tmp_path, split):
    order = list(rows)
    if split == "shuffled":
        random.Random(1).shuffle(order)
    source, place = str(tmp_path / "in"), str(tmp_path / "state")
    fed(spark, source, [order[i : i + 30] for i in range(0, 60, 30)])
    first = keyed.run_keyed(keyed.stored_stream(spark, source, ROWS), place)
    assert got(first) == whole(spark, order[:60])
    fed(spark, source, [order[60:90], order[90:]])  # a new query goes on from the checkpoint
    assert got(keyed.run_keyed(keyed.stored_stream(spark, source, ROWS), place)) == whole(spark, rows)
    assert got(keyed.run_keyed(keyed.stored_stream(spark, source, ROWS), place)) == whole(spark, rows)  # nothing new: nothing changes


def test_timers(spark, tmp_path):
    source, place = str(tmp_path / "in"), str(tmp_path / "state")
    run = lambda: got(keyed.run_keyed(keyed.stored_stream(spark, source, ROWS), place))
    fed(spark, source, [[(1, 1, "old", T, 0), (2, 2, "undated", None, 0), (3, 3, "mid", T + 20 * DAY, 0)]])
    assert len(run()) == 3
    fed(spark, source, [[(4, 4, "new", T + 31 * DAY, 1)], [(5, 5, "newer", T + 31 * DAY + 5, 2)]])
    assert run() == [(2, 2, "undated", None, 0), (3, 3, "mid", T + 20 * DAY, 0), (4, 4, "new", T + 31 * DAY, 1), (5, 5, "newer", T + 31 * DAY + 5, 2)]
    changes = spark.read.schema(keyed.CHANGE).parquet(f"{place}/rows")
    assert [r["k"] for r in changes.where("gone").collect()] == [1]
    fed(spark, source, [[(1, 6, "late", T + 1, 3)], [(1, 7, "again", T + 30 * DAY, 4), (2, 8, "dated now", T + 32 * DAY, 4)]])
    assert run() == [(1, 7, "again", T + 30 * DAY, 4), (2, 8, "dated now", T + 32 * DAY, 0), (3, 3, "mid", T + 20 * DAY, 0), (4, 4, "new", T + 31 * DAY, 1), (5, 5, "newer", T + 31 * DAY + 5, 2)]


def test_sessions(spark, tmp_path):
    from pyspark.sql import functions as F

    source, schema = str(tmp_path / "in"), "user_id long, t long"
    for part in ([(1, 0), (1, 7199), (1, 14398), (1, 21598), (2, 5)], [(1, 20000), (2, 10 * DAY)], [(2, 10 * DAY + 1)], [(1, 100), (3, 8 * DAY)], [(9, 30 * DAY)]):
        spark.createDataFrame([(u, T + t) for u, t in part], schema).coalesce(1).write.mode("append").parquet(source)
    stream = keyed.stored_stream(spark, source, schema).withColumn("ts", F.timestamp_seconds("t"))
    rows = sorted(map(tuple, keyed.run_sessions(stream, str(tmp_path / "out")).collect()))
    assert [(u, a - T, b - T, n) for u, a, b, n in rows] == [(1, 0, 21598, 5), (2, 5, 5, 1), (2, 10 * DAY, 10 * DAY + 1, 2)]


def test_visits_end_at_the_gap_itself(spark, tmp_path):
    gap = 7200
    times = {1: [0, gap - 1], 2: [0, gap], 3: [0, gap + 1], 4: [0, gap - 1, 2 * gap - 1, 2 * gap], 9: [10 * 86400]}
    rows = [(u, datetime.datetime.fromtimestamp(t, datetime.UTC)) for u, ts in times.items() for t in ts]
    spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = keyed.stored_stream(spark, str(tmp_path / "in"), "user_id long, ts timestamp")
    got = {tuple(r) for r in keyed.run_sessions(stream, str(tmp_path / "out")).collect()}
    assert got == {(1, 0, gap - 1, 2), (2, 0, 0, 1), (2, gap, gap, 1), (3, 0, 0, 1), (3, gap + 1, gap + 1, 1), (4, 0, gap - 1, 2), (4, 2 * gap - 1, 2 * gap, 2)}

"""All queries of the feed engine and their DuckDB SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .plans import calendars, jobs, reader, segments, verdict_sql, verdicts, view_sql
from .plans.dialect import Duck, Spark
from .plans.views import PLANS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def over_tables(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs a plan on the tables of a folder; they are arguments of the statement, so no view is left behind."""
    used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    views = ", ".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in used)
    sql = sql.strip()
    return spark.sql(f"WITH {views}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {views} {sql}")


def query(plan):
    text = plan(Spark())
    return lambda spark, sf_dir: over_tables(spark, sf_dir, text)


MORE = (verdicts.JOBS, calendars.JOBS, reader.JOBS, segments.JOBS)
QUERIES = {p.__name__: query(p) for p in PLANS} | {j.__name__: j for j in (*jobs.JOBS, *(j for m in MORE for j in m))}
ORACLES = {p.__name__: p(Duck()) for p in PLANS} | jobs.oracles(Duck()) | verdict_sql.ORACLES | calendars.ORACLES | reader.ORACLES | segments.ORACLES | view_sql.ORACLES

"""From raw documents to a mixed training set: five stages, each over all rows that its predecessor kept.

All stages but the last return the columns of documents, whatever else these are called. The tables beside documents (labels,
benchmark) are read from the data folder. Rows are documents: null and repeated doc_ids are not put together by any stage. Null and
empty texts pass the first stage if their score, that of a text without any learnt form, is below one half; they have no near
copies, no benchmark windows and no personal data, and a size of 0 in the mix. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import decontam, mixing, near_dedup, pii, toxicity
from feedloom.llm.common import discard, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents with a toxicity score of one half or more go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each class of near copies the document with the lowest doc_id (null last) stays, of these the first in the table."""
    return near_dedup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that hold a benchmark window go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: personal data is replaced by its kind; n_chars follows."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: the words that the mix takes of each document, and where in the shards they stand."""
    return mixing.taken(docs).select("doc_id", "size", "source_size", "target", "taken", "n_shards", "runs")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontam", drop_leaks), ("pii", redact_personal_data), ("mixing", mix_sources)]
#: SQL can't express a trained field nor hashed draws; tests hold the pipeline against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's rows are written as Parquet and read by the next, and deleted when that has written its own."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), made := [])
        discard(spark, before)
        before = made
    return STAGES[-1][1](spark, docs, sf_dir)

"""Shared plumbing: reading tables, bounded Arrow batches, and cutting lineage in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once inside a Python worker; one longer document is handled alone.
PIECE_BYTES = 4 << 20
#: Bytes of an Arrow batch on its way to a Python worker, about; the session's own bound counts where it is lower.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the columns an operator reads; a null text counts as empty. Other columns, whatever their names, are left out."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


#: Numbers of rows go to all tasks up to this many; beyond it Spark shuffles.
BROADCAST_ROWS = 2_000_000
#: Vocabulary files go to all tasks up to this size.
SHIPPED_BYTES = 64 << 20
#: Rows of one file that numbered() can tell apart, as a power of two.
FILE_ROWS = 40


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def shipped(spark: SparkSession, path: str):
    """The bytes of a vocabulary file that the driver can read, broadcast to all tasks; a file of over SHIPPED_BYTES is refused."""
    with open(path, "rb") as f:
        data = f.read(SHIPPED_BYTES + 1)
    if len(data) > SHIPPED_BYTES:
        raise ValueError(f"{path} has more than {SHIPPED_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def numbered(df: DataFrame, name: str, made: list[str], columns: list[str] | None = None) -> DataFrame:
    """df (or some columns of it) with a column `name` (long) that tells its rows apart and is the same whenever df is read again, also after an executor is lost.

    Rows of a plain Parquet table are named by file and place in it; the list of files, which the driver plans with anyway, is
    joined to give them numbers. Whatever else df is, it is written once, with numbers, to a table whose path is added to `made`.
    """
    columns = columns or df.columns
    if "Relation" in df._jdf.queryExecution().analyzed().getClass().getSimpleName():
        try:
            path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
            files = sorted(r[0] for r in df.select(path.alias("p")).distinct().collect())
            at = df.select(*columns, path.alias(p := fresh(df, "path")), place.alias(i := fresh(df, "place")))
        except AnalysisException:
            pass  # not Parquet: no such columns
        else:
            if len(files) == 1:
                return at.withColumnRenamed(i, name).drop(p)
            n = fresh(at, "file")
            few = df.sparkSession.createDataFrame([(f, k) for k, f in enumerate(files)] or [("", 0)], f"{p} string, {n} long")
            return at.join(F.broadcast(few), p).withColumn(name, F.shiftleft(n, FILE_ROWS) + F.col(i)).select(*columns, name)
    return stored(df.select(*columns, F.monotonically_increasing_id().alias(name)), made)


def few_rows(rows: DataFrame, name: str) -> DataFrame:
    """The numbers of rows in a column, as `row`; broadcast if they are few enough for their size (8 bytes each) to be bounded."""
    rows = rows.select(F.col(name).alias("row"))
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most `most` bytes of text each (or of one row)."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(sizes):
        n = 0 if n != n else int(n)
        if i > begin and total + n > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    yield batch.slice(begin)


def map_pieces(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str, most: int = PIECE_BYTES) -> DataFrame:
    """mapInArrow over bounded slices. make() runs once a task and returns the function for a slice. Batches of the session are bounded by BATCH_BYTES from then on."""
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))

    def run(batches):
        fn = make()
        for b in batches:
            for p in pieces(b, most=most):
                if (out := fn(p)) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. Only a session on one machine may go without: it gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="feedloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the cluster's shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, made: list[str] | None = None) -> DataFrame:
    """As cut(), but written as a Parquet table in the shared checkpoint folder, which is smaller for wide results. Its path is added to `made`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/feedloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if made is not None:
        made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], made: list[str]) -> DataFrame:
    """As stored(), in as many buckets by `keys` as a shuffle has partitions, so that joins on them move only the other side."""
    spark = df.sparkSession
    name = f"feedloom_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).option("path", path).format("parquet").saveAsTable(name)
    made.append(path)
    return spark.table(name)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Deletes tables of stored() and bucketed() that no later step reads, and lets Spark drop the shuffles of plans that are gone."""
    for path in made:
        if (name := path.rsplit("/", 1)[-1]).startswith("feedloom_"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    made.clear()
    gc.collect()
    spark._jvm.System.gc()

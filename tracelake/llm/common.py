"""What the operators share: reading tables, bounded Arrow batches, tables in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of one Arrow batch between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table; Arrow batches get bounds so that long texts don't pile up in a worker."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a folder of our own only where it is unset (local mode)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tracelake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Tables of written() that are still there, in the order in which they were made.
_paths: list[str] = []


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder, with a folder for each value of the column by: cuts lineage, so a lost
    executor costs no more than its own tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracelake_path = path
    _paths.append(path)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _delete(spark: SparkSession, path: str) -> None:
    _remove(spark, path)
    _paths.remove(path)


def dropped(*frames: DataFrame) -> None:
    """Deletes tables of written() that no later plan reads."""
    for df in frames:
        _delete(df.sparkSession, df._tracelake_path)


def dropped_part(df: DataFrame, folder: str) -> None:
    """Deletes a folder of a table of written(), given as column=value, that no later plan reads."""
    _remove(df.sparkSession, f"{df._tracelake_path}/{folder}")


def settled(df: DataFrame, name: str, since: int) -> DataFrame:
    """df as a table, and the end of all tables that were made for it: those that written() made after the first
    ``since``."""
    made = _paths[since:]
    out = written(df, name)
    for path in made:
        _delete(df.sparkSession, path)
    return out


def tables_made() -> int:
    """How many tables of written() there are."""
    return len(_paths)


def clean_shuffles(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect garbage: only then does Spark delete shuffle files of jobs that are over. What
    the first round frees is what holds the last job's shuffles, which go in the second."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

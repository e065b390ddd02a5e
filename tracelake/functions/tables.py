"""Tables between the steps of an operator, in the folder that the cluster shares.

An operator that reads what it has made more than once writes it first: the plan stays short, nothing is worked out
twice, and a lost executor costs its own tasks only. The tables of a session lie in one folder, which ``forget`` deletes
once the results made from them have been used.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SESSION = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; one of our own, gone at exit, only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tracelake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own."""
    path = f"{shared_dir(df.sparkSession)}/steps-{_SESSION}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Deletes the tables of all steps of this session; results that were not read yet are lost with them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/steps-{_SESSION}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

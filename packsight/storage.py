"""Tables between two steps, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a temporary folder stands in for it if all of Spark runs in this process; on a
    cluster the setting is needed, as no executor sees another's folders.
    """
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir is unset, which {master} needs for tables between steps")
    if _local_dir is None:
        _local_dir = "file://" + tempfile.mkdtemp(prefix="packsight-")
    return _local_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/packsight/{name}-{uuid.uuid4().hex}"


def deleted_at_exit(spark: SparkSession, path: str) -> str:
    """Have a folder deleted when the application ends; only one that exists can be marked."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def stored(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors.

    few: rows are dealt anew first, so that a small table is one file and not one a task. The files
    are deleted when the application ends.
    """
    spark = df.sparkSession
    if few:
        df = df.hint("rebalance")
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(deleted_at_exit(spark, path))

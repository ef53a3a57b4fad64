"""Written tables in the folder that the driver and all executors share (``spark.checkpoint.dir``)."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a temporary folder in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-hushlake-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/hushlake/{name}-{uuid.uuid4().hex}"


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder that goes when the driver's JVM ends."""
    path = new_folder(spark, name)
    files, where = hadoop_path(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once for each Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_hushlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-hushlake-')}/hushlake", "zip", root.parent, root.name))
    sc._hushlake_shipped = True


def hadoop_path(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage ends at files that survive executors.

    The files go when ``release`` is called, or else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    files, where = hadoop_path(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing will read any more."""
    for table in tables:
        files, where = hadoop_path(table.sparkSession, table._written_to)
        files.delete(where, True)

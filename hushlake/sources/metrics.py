"""Tables of metrics as CSV: folders of files with a header.

Defined results: rows without a method are never known; metrics of several methods are appended for those that the table lacks; an empty table of metrics
appends nothing.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import hadoop_path

COLUMNS = "method string, entity_type string, precision double, recall double, f1 double, tp long, fp long, fn long, total_true long, total_pred long, class_proportion double"


def file_name(dataset: str, method: str) -> str:
    return f"{dataset}_{method.replace(' ', '_').replace('/', '_')}_metrics.csv"


def write_metrics(metrics: DataFrame, path: str) -> None:
    """One CSV file with a header in a new folder; a table of metrics has a row for each type."""
    metrics.coalesce(1).write.option("header", True).mode("errorifexists").csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COLUMNS).option("header", True).csv(path)


def append_absent(table: DataFrame, more: DataFrame) -> DataFrame:
    """``table`` and those rows of ``more`` whose method it does not have."""
    return table.unionByName(more.join(table.select("method").distinct(), "method", "left_anti").select(table.columns))


def combined(by_method: dict[str, DataFrame]) -> DataFrame:
    """Metrics of several methods in one table."""
    out = None
    for method, metrics in by_method.items():
        rows = metrics.withColumn("method", F.lit(method))
        out = rows if out is None else out.unionByName(rows)
    return out.select("method", *[c for c in out.columns if c != "method"])


def append_method(metrics: DataFrame, method: str, path: str) -> bool:
    """Adds a method's metrics to a table on disk, in a file of its own. False, and nothing is changed, if the table is not there or knows the method.

    The file is written beside the table and then takes a name that follows from the method, which only one writer can: two writers of two methods both
    add theirs, and of two writers of one method the second gets False.
    """
    spark = metrics.sparkSession
    files, table = hadoop_path(spark, path)
    if not files.exists(table) or read_metrics(spark, path).where(F.col("method") == method).limit(1).count():
        return False
    name = f"method-{hashlib.sha256(method.encode()).hexdigest()[:16]}"
    beside = f"{path.rstrip('/')}/_{name}-{os.urandom(8).hex()}"
    columns = [c for c in read_metrics(spark, path).columns if c != "method"]
    write_metrics(metrics.select(F.lit(method).alias("method"), *columns), beside)
    made = next(f.getPath() for f in files.listStatus(hadoop_path(spark, beside)[1]) if f.getPath().getName().startswith("part-"))
    try:
        return _take_name(spark, made, hadoop_path(spark, f"{path.rstrip('/')}/{name}.csv")[1])
    finally:
        files.delete(hadoop_path(spark, beside)[1], True)


def _take_name(spark: SparkSession, made, name) -> bool:
    """Gives a file a name that no file has; False if one has it."""
    if made.toUri().getScheme() in (None, "file"):
        try:
            os.link(made.toUri().getPath(), name.toUri().getPath())
        except FileExistsError:
            return False
        return True
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(made.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(made, name, none)
    except Exception as e:  # noqa: BLE001 - the gateway's error wraps the file system's
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    return True

"""What several operators share: written tables, this package on the workers, fences and slices."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_folder, release, written

__all__ = ["fenced", "names_without", "new_folder", "release", "ship", "slices", "small_batches", "written"]


def names_without(df: DataFrame, names: list[str]) -> list[str]:
    """Names of the columns of ``df`` other than ``names`` (without regard to case), which new columns can then take."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once for each Spark context."""
    import shutil
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_hushlake_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    made = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-hushlake-')}/hushlake", "zip", root.parent, root.name)
    sc.addPyFile(made)
    sc._hushlake_shipped = True


def fenced(df: DataFrame, columns: list) -> DataFrame:
    """``df.select(columns)`` behind a generator of one row.

    A filter on a computed column is otherwise pushed below the projections that compute it, with a copy of their
    expressions for each use; deep expressions then grow beyond planning.
    """
    return df.select(F.inline(F.array(F.struct(*columns))))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """What is written within gives Python workers so many rows at a time: for rows with long arrays, of which a usual batch is too much memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batch, rows: int = 1000):
    """An Arrow batch in parts of so many rows, without copying it: what Python makes of a part is freed before the next."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)

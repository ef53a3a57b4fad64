"""Rows whose input columns stand in one struct ``row``, so that no name of a user's can clash with a name used on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """``row``, the columns of ``df``, and further columns."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def unpacked(made: DataFrame, columns: list[str], new: dict[str, Column]) -> DataFrame:
    """The columns that ``row`` was made of, but for those named like a new one (whatever the case), and the new ones.

    They come from a generator of one row: names there cannot be taken for one another, and filters are not copied into long expressions.
    """
    taken = {n.lower() for n in new}
    keep = [F.col("row").getField(c).alias(c) for c in columns if c.lower() not in taken]
    return made.select(F.inline(F.array(F.struct(*keep, *[c.alias(n) for n, c in new.items()]))))

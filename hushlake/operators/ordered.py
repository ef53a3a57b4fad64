"""Rows in one order over many tasks: what a row needs of the rows before it, without a window over a whole group.

Rows are range-partitioned by their order and written with their part and their place in it. Windows then run within parts only. What is
open at a part's end is handed on by a boundary table of one row for each part, which the driver folds in order.

Defined results: rows that are equal in all columns stand in any order, and in one part; an empty table has no parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import release, written

#: Columns that ``placed`` and ``islands`` add.
PART, PLACE, ISLAND = "part", "place", "island"


def placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with ``part`` and ``place`` (from 0), ordered by ``by``, then by a hash of the row: a written table."""
    plain = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    keys = [*map(F.col, by), F.xxhash64(*plain)]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    # The number that Spark gives here is the partition's in its upper bits and the row's in the lower 33.
    return written(ordered.select(*rows.columns, F.shiftright("at", 33).cast("int").alias(PART), F.col("at").bitwiseAND(2**33 - 1).alias(PLACE)), "placed")


def _carried(table: DataFrame, group: list[str], value: str, most: bool) -> DataFrame:
    """part, the group of its first row, and the value that the parts before hand on to that group, where they end in it."""
    of_group = table.groupBy(PART, *group).agg(F.min(PLACE).alias("first"), F.max(PLACE).alias("last"), (F.max(value) if most else F.max_by(value, PLACE)).alias("out"))
    key = F.struct(*group)
    ends = of_group.groupBy(PART).agg(F.min_by(key, "first").alias("head"), F.max_by(key, "last").alias("tail"), F.max_by("out", "last").alias("out"), F.count(F.lit(1)).alias("groups"))
    rows, tail, value_at_end = [], None, None
    for r in ends.orderBy(PART).collect():  # a row for each part
        carried = value_at_end if r.head == tail else None
        rows.append((r.part, *r.head, carried))
        # A part of one group hands on what it got itself, if that is more.
        passes = r.groups == 1 and carried is not None and (r.out is None or most and carried > r.out)
        tail, value_at_end = r.tail, carried if passes else r.out
    fields = table.select(PART, *group, F.col(value).alias("carried")).schema
    return table.sparkSession.createDataFrame(rows, fields)


def islands(rows: DataFrame, group: list[str], by: list[str], reach: str, joins: Column | None = None, furthest: bool = True) -> DataFrame:
    """Rows with ``island`` (part and number), part and place: a written table.

    A row joins the island of the row before it in its group where ``joins`` holds; that sees ``reached``, the largest ``reach`` of the rows
    before (``furthest``), or that of the last one, and null for none. Without ``joins``: where its first column after the group's is below ``reached``.
    """
    joins = F.col(next(c for c in by if c not in group)) < F.col("reached") if joins is None else joins
    table = placed(rows, [*group, *by])
    before = Window.partitionBy(PART, *group).orderBy(PLACE).rowsBetween(Window.unboundedPreceding if furthest else -1, -1)
    of_part = (F.max if furthest else F.last)(reach).over(before)
    carried = _carried(table, group, reach, furthest)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (PART, *group)]
    # One row for each part.
    known = table.alias("r").join(F.broadcast(carried).alias("c"), same, "left").select("r.*", "carried")
    reached = F.greatest(of_part, "carried") if furthest else F.when(F.lag(PLACE).over(Window.partitionBy(PART, *group).orderBy(PLACE)).isNull(), F.col("carried")).otherwise(of_part)
    fresh = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    in_part = Window.partitionBy(PART).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    flagged = known.withColumn("reached", reached).withColumn("fresh", fresh).withColumn("number", F.sum("fresh").over(in_part))
    numbered = written(flagged.select(*rows.columns, PART, PLACE, "number"), "numbered")
    release(table)
    # The rows of a part before its first island belong to the last island of the parts before.
    opened, island = [], (0, 0)
    for part, most in sorted(numbered.groupBy(PART).agg(F.max("number")).collect()):  # a row for each part
        opened.append((part, *island))
        island = (part, most) if most else island
    by_part = numbered.sparkSession.createDataFrame(opened, f"{PART} int, open_part int, open_number long")
    own, open_ = F.struct(F.col(PART).alias("part"), F.col("number").cast("long").alias("number")), F.struct(F.col("open_part").alias("part"), F.col("open_number").alias("number"))
    joined = numbered.join(F.broadcast(by_part), PART)
    return joined.select(*rows.columns, F.when(F.col("number") > 0, own).otherwise(open_).alias(ISLAND), PART, PLACE)

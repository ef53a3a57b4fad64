"""Reading one JSON document with many tasks.

Spark's text reader deals a file out by byte ranges and cuts it at ``}``, which also stands inside strings. Whether a piece begins inside a string,
and how deep, follows from all pieces before it. So every range counts its quotes and brackets for both cases; one row for each
range is folded in order by the driver, which settles the case and the depth at which it begins. Elements of the list are then the
runs of pieces up to where the depth comes back to the list's.

Defined results: elements that are no objects are skipped, as are those that do not fit the shape; a file without a list gives no elements; an empty
list gives none. Text is UTF-8; a compressed file is one range. A document may also be all files of a folder, one after the other in order of
their names, of which each but the last ends with a brace; ``file`` is then the folder. A quote, bracket or brace in a string is text like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import release, written

#: The range of a piece, and its place there.
RANGE, PLACE = ["file", "part", "block"], "place"
#: A piece's place in its document.
HERE = [*RANGE[1:], PLACE]


def _count(text: Column, marks: str) -> Column:
    return F.length(text) - F.length(F.translate(text, marks, ""))


def _outside(pieces: Column, odd: int) -> Column:
    """What stands outside strings, of parts between quotes, if the first is (0) or is not (1)."""
    return F.array_join(F.filter(pieces, lambda _, i: i % 2 == odd), "")


def _deeper(outside: Column) -> Column:
    """By how much brackets and braces open more than they close."""
    return _count(outside, "{[") - _count(outside, "]}")


def pieces(spark: SparkSession, paths: str | list[str], key: str, in_parts: bool = False) -> DataFrame:
    """Pieces of files up to each ``}``: file, part (its name, for documents in parts), block, place, text, depth, depth_after, closes (whether its brace is one) and level. A written table.

    ``level`` is the depth of the list's elements in the piece where the list begins: 2 in the value of ``key`` of the outermost object, 1 if
    the whole document is the list; else 0.
    """
    name = F.input_file_name()
    file, part = (F.regexp_replace(name, "/[^/]*$", ""), F.substring_index(name, "/", -1)) if in_parts else (name, F.lit(""))
    lines = spark.read.option("lineSep", "}").text(paths).select(file.alias("file"), part.alias("part"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias(PLACE), F.col("value").alias("text"))
    # An escape is never cut: no valid one has a brace.
    parts = lines.withColumn("parts", F.split(F.regexp_replace("text", r"(?s)\\.", ""), '"', -1))
    quotes = F.size("parts") - 1
    before = Window.partitionBy(*RANGE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum(quotes).over(before), F.lit(0)) % 2
    counted = parts.withColumn("odd", odd).withColumn("odd_after", (F.col("odd") + quotes) % 2)

    def change(case: int) -> Column:
        """The change of depth over a piece with its brace, if the range begins outside (0) or inside (1) a string."""
        first, last = (F.col("odd") + case) % 2, (F.col("odd_after") + case) % 2
        return F.when(first == 0, _deeper(_outside(F.col("parts"), 0))).otherwise(_deeper(_outside(F.col("parts"), 1))) - F.when(last == 0, 1).otherwise(0)

    up_to = before.rowsBetween(Window.unboundedPreceding, 0)
    both = counted.select(*RANGE, PLACE, "text", "odd", "odd_after", *[change(c).alias(f"change{c}") for c in (0, 1)])
    table = written(both.select("*", *[F.sum(f"change{c}").over(up_to).alias(f"sum{c}") for c in (0, 1)]), "pieces")
    ends = table.groupBy(*RANGE).agg(F.max_by("odd_after", PLACE).alias("odd"), *[F.sum(f"change{c}").alias(f"change{c}") for c in (0, 1)])
    begun, file, case, depth = [], None, 0, 0
    for r in ends.orderBy(*RANGE).collect():  # a row for each range
        case, depth = (case, depth) if r.file == file else (0, 0)
        begun.append((r.file, r.part, r.block, case, depth))
        file, depth, case = r.file, depth + (r.change1 if case else r.change0), case ^ r.odd
    known = spark.createDataFrame(begun, "file string, part string, block long, begun int, begun_depth long")
    settled = table.join(F.broadcast(known), RANGE)
    of_case = lambda name: F.when(F.col("begun") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))
    after = F.col("begun_depth") + of_case("sum")
    closes = (F.col("odd_after") + F.col("begun")) % 2 == 0
    within = (F.col("odd") + F.col("begun")) % 2 == 1
    placed = settled.select(*RANGE, PLACE, "text", within.alias("within"), (after - of_case("change")).alias("depth"), after.alias("depth_after"), closes.alias("closes"))
    # The list's own bracket: that of the key at depth 1, or the document's first character.
    at = F.regexp_extract("text", rf'(?s)^(.*?)"{key}"\s*:\s*\[', 1)
    named = F.regexp_like("text", F.lit(rf'"{key}"\s*:\s*\['))
    bare_before = F.split(F.regexp_replace(at, r"(?s)\\.", ""), '"', -1)
    outside = F.when(F.col("within"), _outside(bare_before, 1)).otherwise(_outside(bare_before, 0))
    opens_named = named & (F.col("depth") + _deeper(outside) == 1)
    opens_bare = (F.col("block") == 0) & (F.col("depth") == 0) & F.regexp_like("text", F.lit(r"^\x{FEFF}?\s*\["))
    out = written(placed.withColumn("level", F.when(opens_bare, 1).when(opens_named, 2).otherwise(0)).drop("within"), "pieces")
    release(table)
    return out


def elements(spark: SparkSession, paths: str | list[str], key: str = "dialogs", in_parts: bool = False) -> DataFrame:
    """The objects in the list of each file: file, pos (from 0), json. No task holds more of a file than a byte range and the pieces of some elements."""
    table, here = pieces(spark, paths, key, in_parts), F.struct(*HERE)
    # A row for each file: where its list begins, and how deep.
    lists = table.where("level > 0").groupBy("file").agg(F.min(here).alias("at"), F.min_by("level", here).alias("level"))
    inside = table.drop("level").join(F.broadcast(lists), "file").where(here >= F.col("at")).withColumn("first", here == F.col("at"))
    head = F.when(F.col("level") == 2, F.regexp_replace("text", rf'(?s)^.*?"{key}"\s*:\s*\[', "")).otherwise(F.regexp_replace("text", r"^[^\[]*\[", ""))
    cut = inside.withColumn("text", F.when(F.col("first"), head).otherwise(F.col("text")))
    # The list ends where a bracket closes it between two elements, which is before a piece's first object.
    lead = F.regexp_replace(F.substring_index(_outside(F.split(F.regexp_replace("text", r"(?s)\\.", ""), '"', -1), 0), "{", 1), r"\[[^\[\]]*\]", "")
    ends = (F.col("first") | (F.col("depth") == F.col("level"))) & F.contains(lead, F.lit("]"))
    # A row for each file too: a join by files would send each to one task.
    last = cut.groupBy("file").agg(F.min(F.when(ends, here)).alias("end"))
    closed = F.col("closes") & (F.col("depth_after") == F.col("level"))
    listed = cut.join(F.broadcast(last), "file").where(F.col("end").isNull() | (here < F.col("end"))).withColumn("closed", closed.cast("int"))
    before = Window.partitionBy(*RANGE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    numbered = written(listed.select(*RANGE, PLACE, "text", "closed", F.coalesce(F.sum("closed").over(before), F.lit(0)).alias("n")), "elements")
    total, file, offsets = 0, None, []
    for r in numbered.groupBy(*RANGE).agg(F.sum("closed").alias("n")).orderBy(*RANGE).collect():  # a row for each range
        total = total if r.file == file else 0
        offsets.append((r.file, r.part, r.block, total))
        file, total = r.file, total + r.n
    known = spark.createDataFrame(offsets, "file string, part string, block long, passed long")
    rows = numbered.join(F.broadcast(known), RANGE).select("file", (F.col("passed") + F.col("n")).alias("pos"), F.struct(*HERE, F.concat("text", F.lit("}")).alias("text"), "closed").alias("piece"))
    grouped = rows.groupBy("file", "pos").agg(F.array_sort(F.collect_list("piece")).alias("pieces"), F.max("piece.closed").alias("closed")).where("closed = 1")
    joined = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return grouped.select("file", "pos", F.regexp_replace(joined, r"^[^{]*", "").alias("json"))

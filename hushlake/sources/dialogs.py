"""Dialog files: one JSON document of metadata and dialogs, or a bare list of dialogs; and tables of dialogs.

A document is one JSON value in one file, or in parts: files of one folder that are the value one after the other. ``read_dialogs`` reads each
file with one task; ``read_large_dialogs`` deals a file, or the parts of a document, out to many. A document is written in parts of a bounded size,
a task for each; a small one has one part. Datasets of any size may also be written as JSON lines beside a document of their metadata
(``write_dataset``), or as shards of documents of a bounded number of dialogs.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import datasets
from ..scratch import release, written
from . import parts

_ENTITY = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("value", T.StringType())])
_DIALOG = T.StructType(
    [
        T.StructField("text", T.StringType()), T.StructField("entities", T.ArrayType(_ENTITY)), T.StructField("personal_data", T.ArrayType(_ENTITY)),
        T.StructField("has_pd", T.BooleanType()), T.StructField("description", T.StringType()), T.StructField("id", T.LongType()),
    ]
)
_METADATA = T.StructType(
    [
        T.StructField("total_dialogs", T.LongType()), T.StructField("generation_timestamp", T.DoubleType()), T.StructField("model_used", T.StringType()),
        T.StructField("total_cost_tokens", T.LongType()), T.StructField("parent_dataset", T.StringType()), T.StructField("subset_number", T.LongType()), T.StructField("dialog_range", T.StringType()),
    ]
)
_DOCUMENT = T.StructType([T.StructField("metadata", _METADATA), T.StructField("dialogs", T.ArrayType(_DIALOG)), *_DIALOG.fields, T.StructField("_corrupt_record", T.StringType())])
ENTITY = "struct<start:long,end:long,type:string,text:string>"
#: Bytes of a document's part, about: parts have equal numbers of dialogs.
PART_BYTES = 32 * 2**20


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Each file's metadata and dialogs as they are, with ``file``; globs are fine. A bare list gives a row for each dialog."""
    return spark.read.schema(_DOCUMENT).option("multiLine", True).json(paths).withColumn("file", F.input_file_name())


def read_dialogs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Dialogs: file, pos, id (default: place from 1), text, entities, has_pd (whether there are entities), description.

    Entities may be named ``personal_data`` and their text ``value``.
    """
    rows = read_documents(spark, paths)
    whole = rows.where("dialogs IS NOT NULL").select("file", F.posexplode("dialogs").alias("pos", "d"))
    # A file of a bare list is one document, which one task reads: its rows are numbered in their order.
    listed = rows.where("dialogs IS NULL AND text IS NOT NULL").withColumn("n", F.monotonically_increasing_id())
    place = F.row_number().over(Window.partitionBy("file").orderBy("n")) - 1
    bare = listed.select("file", place.alias("pos"), F.struct(*[f.name for f in _DIALOG.fields]).alias("d"))
    return _dialogs(whole.unionByName(bare))


def read_large_dialogs(spark: SparkSession, paths: str | list[str], in_parts: bool = False) -> DataFrame:
    """What ``read_dialogs`` gives, each file read by many tasks. Objects that do not fit a dialog's shape are left out.

    ``in_parts``: the files of a folder are one document, as ``write_document`` writes it; ``file`` is then the folder.
    """
    found = parts.elements(spark, paths, in_parts=in_parts).select("file", F.col("pos").cast("int").alias("pos"), F.from_json("json", T.StructType(_DIALOG.fields)).alias("d"))
    return _dialogs(found.where("d.text IS NOT NULL OR d.id IS NOT NULL OR d.entities IS NOT NULL OR d.personal_data IS NOT NULL"))


def _dialogs(rows: DataFrame) -> DataFrame:
    """Dialogs of rows of file, pos and d, in one form."""
    found = F.coalesce("d.entities", "d.personal_data", F.array().cast(T.ArrayType(_ENTITY)))
    named = F.transform(found, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["type"].alias("type"), F.coalesce(e["text"], e["value"], F.lit("")).alias("text"))).cast(f"array<{ENTITY}>")
    return rows.select(
        "file", "pos", F.coalesce("d.id", (F.col("pos") + 1).cast("long")).alias("id"), "d.text", named.alias("entities"), (F.size(named) > 0).alias("has_pd"), F.coalesce("d.description", F.lit("")).alias("description")
    )


def write_dialogs(dialogs: DataFrame, path: str, by: str | None = None) -> None:
    """Dialogs as JSON lines, in a folder for each value of ``by`` if given."""
    writer = dialogs.write.mode("errorifexists")
    (writer.partitionBy(by) if by else writer).json(path)


def _document(dialogs: Column, metadata: Column) -> Column:
    """A document's text. Fields without a value are left out of it."""
    return F.to_json(F.struct(metadata.alias("metadata"), dialogs.alias("dialogs")), {"ignoreNullFields": "true"})


def _listed(order: Column) -> Column:
    """All dialogs of a group in the order of a column."""
    row = F.struct(order.alias("at"), F.struct("text", "entities", "has_pd", "description", "id").alias("d"))
    return F.transform(F.array_sort(F.collect_list(row)), lambda x: x["d"])


def write_document(dialogs: DataFrame, metadata: dict, path: str, part_bytes: int = PART_BYTES) -> None:
    """One document as text files in a new folder, a dialog a line in the order of their ids. A task that fails leaves no file.

    The files are the document one after the other in order of their names, one for each ``part_bytes``: a small document is one file. Each is
    written by a task that sorts its lines and holds none, and ends with a brace. ``total_dialogs`` of the metadata is set to the number of dialogs,
    ``generation_timestamp`` to now if there is none.
    """
    fields = [c for c in ("text", "entities", "has_pd", "description", "id") if c in dialogs.columns]
    text = F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})
    # Without their last brace, which ends each line of the files. What makes the dialogs runs once.
    lines = written(dialogs.select("id", F.substring(text, F.lit(1), F.length(text) - 1).alias("value")), "lines")
    rows, n = datasets.numbered_rows(lines, [F.col("id")])
    size = lines.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    known = {"generation_timestamp": time.time()} | metadata | {"total_dialogs": n}
    head = '{"metadata": ' + json.dumps(known, ensure_ascii=False) + ', "dialogs": [\n'
    listed = F.concat(F.when(F.col("number") == 1, F.lit(head)).otherwise(F.lit(",\n")), "row.value")
    last = lines.sparkSession.createDataFrame([(n + 1, "\n]" if n else head + "]")], "number long, value string")
    every = rows.select("number", listed.alias("value")).unionByName(last)
    ordered = every.repartitionByRange(max(1, -(-size // part_bytes)), "number").sortWithinPartitions("number")
    ordered.select("value").write.mode("errorifexists").option("lineSep", "}").option("compression", "none").text(path)
    release(lines)


def shard_documents(sharded: DataFrame, parent: str, model_used: str = "unknown") -> DataFrame:
    """From dialogs with place, shard and dialog_range (``datasets.shards``) a row for each shard: shard, name, document (text).

    A shard's document holds its own metadata; shards are of a bounded size, so no task holds more than some of them.
    """
    metadata = F.struct(
        F.col("n").alias("total_dialogs"), F.lit(time.time()).alias("generation_timestamp"), F.lit(model_used).alias("model_used"),
        F.lit(parent).alias("parent_dataset"), F.col("shard").alias("subset_number"), F.col("dialog_range").alias("dialog_range"),
    )
    listed = sharded.groupBy("shard", "dialog_range").agg(_listed(F.col("place")).alias("dialogs"), F.count(F.lit(1)).alias("n"))
    name = F.concat(F.lit(f"{parent}."), F.col("shard").cast("string"))
    return listed.select("shard", name.alias("name"), _document(F.col("dialogs"), metadata).alias("document"))


def write_shards(sharded: DataFrame, path: str, parent: str, model_used: str = "unknown") -> None:
    """A folder for each shard with its document, which ``read_documents`` reads again."""
    shard_documents(sharded, parent, model_used).select("name", F.col("document").alias("value")).write.mode("errorifexists").partitionBy("name").text(path)


def write_dataset(dialogs: DataFrame, metadata: dict, path: str) -> None:
    """A dataset of any size: ``path/dialogs`` as JSON lines, ``path/metadata`` as one line."""
    write_dialogs(dialogs, f"{path}/dialogs")
    known = {"generation_timestamp": time.time()} | metadata | {"total_dialogs": dialogs.sparkSession.read.json(f"{path}/dialogs").count()}
    dialogs.sparkSession.createDataFrame([(json.dumps(known, ensure_ascii=False),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/metadata")


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """What ``write_dataset`` wrote."""
    dialogs = spark.read.schema(T.StructType([*_DIALOG.fields])).json(f"{path}/dialogs")
    return dialogs, json.loads(spark.read.text(f"{path}/metadata").first().value)


def valid_metadata(metadata: dict) -> bool:
    """Whether the one required field is there."""
    return "total_dialogs" in metadata


def with_generation_stats(metadata: dict, stats: dict) -> dict:
    """Metadata with generation statistics added to those that it has, and the time."""
    return metadata | {"generation_stats": metadata.get("generation_stats", {}) | stats, "last_updated": time.time()}


def with_annotation(metadata: dict, kind: str, count: int) -> dict:
    """Metadata with the number of annotations of a kind, and the time."""
    return metadata | {f"{kind}_annotation": count, f"{kind}_annotation_timestamp": time.time()}


def write_report(lines: DataFrame, path: str) -> None:
    """Lines (line_no, line) in order as one text file in a new folder. A report has a line for each type."""
    lines.coalesce(1).sortWithinPartitions("line_no").select(F.col("line").alias("value")).write.mode("errorifexists").text(path)


def dataset_name(path: str) -> str:
    """A path's last part without its ending."""
    return path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]

"""Dialog datasets: normalising, validating, describing, merging, splitting and sharding.

A dialog is a row of text, entities (array of start, end, type, text), has_pd, description, id.

Defined results: null entities are none and a null has_pd is false; rows that repeat an id are dialogs of their own; counts of an empty dataset
are 0, its means null; other columns stay where rows are returned, but for those named like an output, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rows import packed, unpacked
from ..functions.text import strip
from ..scratch import written

ENTITY = "struct<start:long,end:long,type:string,text:string>"


def repaired_entity(entity: Column, text: Column) -> Column:
    """A valid entity, its text taken from the dialog if only white space differs; null for one that does not fit."""
    start, end = entity["start"], entity["end"]
    whole = entity["type"].isNotNull() & entity["text"].isNotNull() & (start >= 0) & (start < end) & (end <= F.length(text))
    cut = F.substring(text, start.cast("int") + 1, (end - start).cast("int"))
    fixed = F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), entity["type"].alias("type"), cut.alias("text"))
    return F.when(whole & (strip(cut) == strip(entity["text"])), fixed.cast(ENTITY))


def normalise_dialogs(dialogs: DataFrame, default_id: Column | None = None) -> DataFrame:
    """Dialogs with a text; only valid entities; has_pd says whether any is left; an empty description for none.

    ``default_id`` stands in for a missing id, as the place of a dialog in its batch or file; without it, ids stay as they are.
    """
    repaired = F.filter(F.transform(F.coalesce("entities", F.array().cast(f"array<{ENTITY}>")), lambda e: repaired_entity(e, F.col("text"))), lambda e: e.isNotNull())
    kept = dialogs.where("text IS NOT NULL").withColumn("entities", repaired)
    if default_id is not None:
        kept = kept.withColumn("id", F.coalesce(F.col("id"), default_id.cast("long")))
    return kept.withColumn("has_pd", F.size("entities") > 0).withColumn("description", F.coalesce("description", F.lit("")))


def valid_dialog(text: Column, entities: Column, has_pd: Column, id_: Column) -> Column:
    """Whether the four required fields, and the four of each entity, are there."""
    fields = F.forall(entities, lambda e: e["start"].isNotNull() & e["end"].isNotNull() & e["type"].isNotNull() & e["text"].isNotNull())
    return text.isNotNull() & has_pd.isNotNull() & id_.isNotNull() & entities.isNotNull() & F.coalesce(fields, F.lit(False))


def _grains(dialogs: DataFrame) -> DataFrame:
    """A row for each type (n), and one of a null type for the dialogs (n, with_pd), from one pass over them."""
    one = F.struct(F.lit(None).cast("string").alias("type"), F.lit(1).cast("long").alias("n"), F.coalesce("has_pd", F.lit(False)).cast("long").alias("with_pd"))
    each = F.transform(F.coalesce("entities", F.array().cast(f"array<{ENTITY}>")), lambda e: F.struct(F.coalesce(e["type"], F.lit("UNKNOWN")).alias("type"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("with_pd")))
    return dialogs.select(F.inline(F.concat(F.array(one), each))).groupBy("type").agg(F.sum("n").alias("n"), F.sum("with_pd").alias("with_pd"))


def dataset_stats(dialogs: DataFrame) -> DataFrame:
    """One row: total_dialogs, dialogs_with_pd, dialogs_without_pd, pd_percentage, total_entities, entity_types (map)."""
    return _stats(_grains(dialogs))


def _stats(grains: DataFrame) -> DataFrame:
    of_all, of_type = F.col("type").isNull(), F.col("type").isNotNull()
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    listed = F.array_sort(F.collect_list(F.when(of_type, F.struct("type", "n"))))  # an entry for each type
    one = grains.agg(total("n", of_all).alias("total_dialogs"), total("with_pd", of_all).alias("dialogs_with_pd"), total("n", of_type).alias("total_entities"), F.map_from_entries(listed).alias("entity_types"))
    share = F.coalesce(F.try_divide(F.col("dialogs_with_pd") * 100.0, F.col("total_dialogs")), F.lit(0.0))
    return one.select(
        "total_dialogs", "dialogs_with_pd", (F.col("total_dialogs") - F.col("dialogs_with_pd")).alias("dialogs_without_pd"),
        share.alias("pd_percentage"), "total_entities", "entity_types",
    )


def type_histogram(dialogs: DataFrame) -> DataFrame:
    """type, n, most frequent first; a missing type is UNKNOWN."""
    types = dialogs.select(F.explode("entities").alias("e")).groupBy(F.coalesce("e.type", F.lit("UNKNOWN")).alias("type"))
    return types.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def length_stats(dialogs: DataFrame) -> DataFrame:
    """One row: text length mean, least, most; entities a dialog mean and most."""
    n = F.coalesce(F.size("entities"), F.lit(0))
    length = F.length("text")
    return dialogs.agg(
        F.avg(length).alias("avg_text_length"), F.min(length).cast("long").alias("min_text_length"), F.max(length).cast("long").alias("max_text_length"),
        F.avg(n).alias("avg_entities"), F.max(n).cast("long").alias("max_entities"),
    )


def compare_datasets(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row of differences, second less first."""
    a, b = dataset_stats(first), dataset_stats(second)
    pair = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]).join(b, how="left")  # one row each
    return pair.select(*[(F.col(c) - F.col(f"a_{c}")).alias(f"{c}_difference") for c in ("total_dialogs", "pd_percentage", "total_entities")])


def report_lines(dialogs: DataFrame) -> DataFrame:
    """The text report: a row for each line, in order of ``line_no``. The dialogs are read once."""
    lengths = [F.sum(F.length("text")).alias("chars"), F.count("text").alias("texts"), F.min(F.length("text")).alias("shortest"), F.max(F.length("text")).alias("longest")]
    grains = written(_grains(dialogs), "grains")  # a row for each type
    stats = _stats(grains).join(dialogs.agg(*lengths), how="left")  # one row each
    mean = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    heads = [
        F.format_string("dialogs: %d", "total_dialogs"),
        F.format_string("with personal data: %d (%.1f%%)", "dialogs_with_pd", "pd_percentage"),
        F.format_string("entities: %d", "total_entities"),
        F.format_string("entities a dialog: %.1f", mean("total_entities", "total_dialogs")),
        F.format_string("characters a dialog: %.0f, %d to %d", mean("chars", "texts"), F.coalesce("shortest", F.lit(0)), F.coalesce("longest", F.lit(0))),
    ]
    head = stats.select(F.posexplode(F.array(*heads)).alias("line_no", "line"))
    types = grains.where("type IS NOT NULL")
    share = F.try_divide(F.col("n") * 100.0, F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row for each type
    rows = types.select((F.row_number().over(Window.orderBy("type")) + len(heads) - 1).alias("line_no"), F.format_string("  %s: %d (%.1f%%)", "type", "n", share).alias("line"))
    return head.unionByName(rows)


def numbered(df: DataFrame, order: list[str], out: str = "id", start: int = 1) -> DataFrame:
    """Adds consecutive numbers in the given order without one task seeing all rows; a column named ``out`` is replaced."""
    rows, _ = numbered_rows(df, [F.col(f"`{c}`") for c in order])
    return unpacked(rows, df.columns, {out: F.col("number") + (start - 1)})


def numbered_rows(df: DataFrame, order: list[Column]) -> tuple[DataFrame, int]:
    """Each row as a struct ``row`` with its ``number`` from 1, and how many there are.

    Rows are range-partitioned by the order and written with their partition and their place in it, so that all later steps see
    one and the same partitioning. A partition starts where those before it end: a number for each partition. Equal keys are
    dealt apart by a hash of the row; rows that are equal in that too have any order, and keep it.
    """
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    rest = F.xxhash64(*[F.col(f"`{c}`") for c in plain])
    keyed = packed(df, **{f"k{i}": c for i, c in enumerate(order)}, rest=rest)
    by = [*[f"k{i}" for i in range(len(order))], "rest"]
    # The number that Spark gives here is the partition's in its upper bits and the row's in the lower 33.
    placed = keyed.repartitionByRange(*by).sortWithinPartitions(*by).select("row", F.monotonically_increasing_id().alias("at"))
    table = written(placed.select("row", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND(2**33 - 1).alias("place")), "numbered")
    before, offsets = 0, []
    for part, n in sorted(table.groupBy("part").count().collect()):  # a row for each partition
        offsets.append((part, before + 1))
        before += n
    known = df.sparkSession.createDataFrame(offsets, "part int, first long")
    return table.join(F.broadcast(known), "part").select("row", (F.col("first") + F.col("place")).alias("number")), before


def merge_datasets(parts: list[DataFrame]) -> DataFrame:
    """All dialogs in the order of the parts and their ids, numbered from 1; ``original_id`` and ``part`` say where they come from."""
    out = None
    for k, df in enumerate(parts):
        rows = df.drop("part", "original_id").withColumn("part", F.lit(k)).withColumnRenamed("id", "original_id")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return numbered(out, ["part", "original_id"])


def split_dataset(dialogs: DataFrame, train_ratio: float = 0.7, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and validation sets of exactly floor(n * ratio) and the other dialogs, in an order shuffled by a seeded hash, numbered from 1.

    ``original_id`` is the id before. Rows that share an id, or have none, are shuffled by a hash of the whole row.
    """
    rows = dialogs.drop("original_id").withColumnRenamed("id", "original_id")
    shuffled, n = numbered_rows(rows, [shuffle_key(F.col("original_id"), seed), F.col("original_id")])
    cut = int(n * train_ratio)
    train = unpacked(shuffled.where(F.col("number") <= cut), rows.columns, {"id": F.col("number")})
    return train, unpacked(shuffled.where(F.col("number") > cut), rows.columns, {"id": F.col("number") - cut})


def shuffle_key(id_: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))))


def shards(dialogs: DataFrame, size: int = 50, order: str = "id") -> DataFrame:
    """Adds place (from 1), shard (from 1), and dialog_range ``first-last`` of the shard's places; columns of these names are replaced."""
    placed, n = numbered_rows(dialogs, [F.col(f"`{order}`")])
    shard = F.floor((F.col("number") - 1) / size) + 1
    label = F.concat(((shard - 1) * size + 1).cast("string"), F.lit("-"), F.least(shard * size, F.lit(n)).cast("string"))
    return unpacked(placed, dialogs.columns, {"place": F.col("number"), "shard": shard.cast("long"), "dialog_range": label})


def merge_metadata(metadata: DataFrame) -> DataFrame:
    """One row for several datasets' metadata (total_dialogs, total_cost_tokens, model_used, generation_configs).

    Sums, the distinct models, and all configurations; these are lists of one entry for each dataset or batch.
    """
    return metadata.agg(
        F.sum("total_dialogs").alias("total_dialogs"),
        F.coalesce(F.sum("total_cost_tokens"), F.lit(0)).alias("total_cost_tokens"),
        F.array_sort(F.collect_set("model_used")).alias("models_used"),
        F.flatten(F.collect_list(F.coalesce("generation_configs", F.array()))).alias("generation_configs"),
    )

"""Quality of annotations: annotated dialogs against their originals.

Defined results: of originals that share an id, the last by position counts; every annotated dialog counts, also where ids repeat; annotated dialogs without an original count only in the total; a null
has_pd is false, null entities are none; an entity with a missing place or text does not fit; without dialogs all counts are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .datasets import ENTITY

#: Names of the quality levels by number of errors: none, under 5, under 20, more.
LEVELS = ["ОТЛИЧНОЕ", "ХОРОШЕЕ", "СРЕДНЕЕ", "ПЛОХОЕ"]
#: Fixed value: how many issues a report shows.
FIRST_ISSUES = 10


def last_of_each_id(dialogs: DataFrame, order: str = "pos") -> DataFrame:
    """Of dialogs that share an id, the last by position (any one, if there is no column of positions)."""
    row = F.struct(*[F.col(f"`{c}`") for c in dialogs.columns])
    last = F.max_by("row", F.struct(F.coalesce("at", F.lit(-1).cast("long")), "h"))
    plain = [f.name for f in dialogs.schema.fields if "map<" not in f.dataType.simpleString()]
    at = F.col(f"`{order}`").cast("long") if order in dialogs.columns else F.lit(None).cast("long")
    keyed = dialogs.select(F.col("id").alias("k"), row.alias("row"), at.alias("at"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("h"))
    return keyed.groupBy("k").agg(last.alias("row")).select(*[F.col("row").getField(c).alias(c) for c in dialogs.columns])


def _fits(entity: Column, text: Column) -> Column:
    start, end = entity["start"], entity["end"]
    inside = (start >= 0) & (start < end) & (end <= F.length(text))
    return F.coalesce(inside & (F.substring(text, start.cast("int") + 1, (end - start).cast("int")) == entity["text"]), F.lit(False))


def _pairs(original: DataFrame, annotated: DataFrame) -> DataFrame:
    """Each annotated dialog: id, text, entities, checks (whether each entity fits), now, and its original's known, o_text, o_pd; all else null."""
    before = last_of_each_id(original).select("id", F.lit(True).alias("known"), F.col("text").alias("o_text"), F.coalesce("has_pd", F.lit(False)).alias("o_pd"))
    entities = F.coalesce("entities", F.array().cast(f"array<{ENTITY}>"))
    rows = annotated.select("id", "text", entities.cast(f"array<{ENTITY}>").alias("entities"), F.coalesce("has_pd", F.lit(False)).alias("now"))
    return rows.withColumn("checks", F.transform("entities", lambda e: _fits(e, F.col("text")))).join(before, "id", "left")


def checked_entities(original: DataFrame, annotated: DataFrame) -> DataFrame:
    """Each entity of the annotated dialogs that have an original: id, start, end, type, text, fits (its span holds its text)."""
    rows = _pairs(original, annotated).where("known").select("id", F.explode(F.arrays_zip(F.col("entities").alias("e"), F.col("checks").alias("fits"))).alias("x"))
    return rows.select("id", "x.e.*", "x.fits")


def annotation_types(original: DataFrame, annotated: DataFrame) -> DataFrame:
    """type, n of the entities that fit, most frequent first."""
    return checked_entities(original, annotated).where("fits").groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def annotation_issues(original: DataFrame, annotated: DataFrame, first: int | None = FIRST_ISSUES) -> DataFrame:
    """id, kind (text or position), detail: changed texts and entities that do not fit, by id; the first ones (None: all)."""
    shape = "array<struct<kind:string,detail:string>>"
    bad = F.filter(F.arrays_zip(F.col("entities").alias("e"), F.col("checks").alias("fits")), lambda x: ~x["fits"])
    of_text = F.when(~F.col("text").eqNullSafe(F.col("o_text")), F.array(F.struct(F.lit("text").alias("kind"), F.substring("text", 1, 50).alias("detail"))))
    of_places = F.transform(bad, lambda x: F.struct(F.lit("position").alias("kind"), F.concat_ws(":", x["e"]["type"], x["e"]["start"], x["e"]["end"], x["e"]["text"]).alias("detail")))
    rows = _pairs(original, annotated).where("known").select("id", F.explode(F.concat(F.coalesce(of_text.cast(shape), F.array().cast(shape)), of_places.cast(shape))).alias("x"))
    issues = rows.select("id", "x.kind", "x.detail").orderBy("id", F.desc("kind"), "detail")
    return issues if first is None else issues.limit(first)


def annotation_quality(original: DataFrame, annotated: DataFrame) -> DataFrame:
    """One row: total, annotated, text_changes, position_errors, false_to_true, true_to_false, valid_entities, percentage, quality."""
    known, fit = F.coalesce("known", F.lit(False)), F.size(F.filter("checks", lambda c: c))
    of_known = lambda n: F.coalesce(F.sum(F.when(known, n)), F.lit(0)).cast("long")
    row = _pairs(original, annotated).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(known & (F.size("entities") > 0)).alias("annotated"),
        F.count_if(known & ~F.col("text").eqNullSafe(F.col("o_text"))).alias("text_changes"),
        F.count_if(known & ~F.col("o_pd") & F.col("now")).alias("false_to_true"),
        F.count_if(known & F.col("o_pd") & ~F.col("now")).alias("true_to_false"),
        of_known(F.size("checks") - fit).alias("position_errors"),
        of_known(fit).alias("valid_entities"),
    )
    errors = F.col("text_changes") + F.col("position_errors")
    level = F.when(errors == 0, LEVELS[0]).when(errors < 5, LEVELS[1]).when(errors < 20, LEVELS[2]).otherwise(LEVELS[3])
    share = F.coalesce(F.try_divide(F.col("annotated") * 100.0, F.col("total")), F.lit(0.0))
    return row.withColumn("percentage", share).withColumn("quality", level)

"""Plans of synthetic dialogs: sampled configurations, batches, prompts, a model's replies and their repair.

A model's replies cannot be repeated. Each goes into a ledger as soon as it comes: a task that runs again, a result that is read again and a job that
is started again with its ledger send only what has no answer yet. A task that is lost between an answer and its entry sends that one prompt twice.

Defined results: a plan of no dialogs is empty; a batch without a prompt fails; a null or unreadable reply holds no dialogs; rows that are equal in all
columns are one request and share its reply; a failed request is an answer too, and is sent again only with another ledger.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import may_hold_personal_data
from ..scratch import ship, temporary_folder, written
from ..sources.ledger import Ledger
from .datasets import ENTITY, normalise_dialogs

# Weights of each choice, sizes of batches, and percentages.
SPHERES = {"автомобили": 0.2, "недвижимость": 0.2, "медицина": 0.15, "финансы": 0.15, "розничная торговля": 0.1, "образование": 0.1, "услуги": 0.05, "техподдержка": 0.05}
REGIONS = {"Москва": 0.3, "Санкт-Петербург": 0.25, "Новосибирск": 0.15, "Екатеринбург": 0.1, "Нижний Новгород": 0.08, "Казань": 0.07, "Ростов-на-Дону": 0.05}
QUALITIES = {"среднее": 0.45, "плохое": 0.25, "отличное": 0.3}
STYLES = {"смешанный": 0.5, "разговорный": 0.3, "официальный": 0.2}
BATCH_SIZES = [25, 30, 35, 40, 50]
PD_PERCENTAGE, FALSE_POSITIVE_PERCENTAGE = (70, 80), (10, 15)
#: Fixed value: the region whose details stand in for a region without its own.
DEFAULT_REGION = "Москва"

CONFIG = ["business_sphere", "regional_focus", "transcription_quality", "communication_style", "pd_percentage", "false_positive_percentage", "batch_size"]
DIALOGS = f"array<struct<text:string,entities:array<{ENTITY}>,has_pd:boolean,description:string,id:long>>"


def uniform(number: Column, salt: str, seed: int) -> Column:
    """A number in [0, 1) from an MD5 hash, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), number.cast("string"))), 1, 13), 16, 10).cast("double") / float(2**52)


def weighted_choice(u: Column, weights: dict[str, float]) -> Column:
    """The value in whose part of the cumulated weights a number of [0, 1) lies."""
    total, at, out = sum(weights.values()), 0.0, None
    for value, weight in weights.items():
        at += weight
        hit = u * total < at
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(list(weights)[-1])


def sample_configs(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``n`` configurations, numbered from 0."""
    return sampled(spark.range(n).withColumnRenamed("id", "batch"), seed)


def sampled(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Rows of ``batch`` and other columns with a configuration drawn by ``batch``."""
    u = lambda salt: uniform(F.col("batch"), salt, seed)
    between = lambda salt, low, high: (F.floor(u(salt) * (high - low + 1)) + low).cast("int")
    sizes = F.array(*[F.lit(s) for s in BATCH_SIZES])
    return rows.select(
        *rows.columns,
        weighted_choice(u("sphere"), SPHERES).alias("business_sphere"),
        weighted_choice(u("region"), REGIONS).alias("regional_focus"),
        weighted_choice(u("quality"), QUALITIES).alias("transcription_quality"),
        weighted_choice(u("style"), STYLES).alias("communication_style"),
        between("pd", *PD_PERCENTAGE).alias("pd_percentage"),
        between("fp", *FALSE_POSITIVE_PERCENTAGE).alias("false_positive_percentage"),
        F.get(sizes, F.floor(u("size") * len(BATCH_SIZES)).cast("int")).alias("batch_size"),
    )


#: Batches whose sizes are added up together.
RUN = 10_000


def plan_batches(spark: SparkSession, total: int, most: int = 50, seed: int = 42) -> DataFrame:
    """Batches whose sizes add up to ``total``, none above ``most``: the last one takes what is left.

    A batch's place is the sum of the runs before its own, one number a run, and of the batches before it in its run.
    """
    least = min(min(BATCH_SIZES), most)
    configs = sample_configs(spark, -(-total // least) if total > 0 else 0, seed).withColumn("batch_size", F.least("batch_size", F.lit(most)))
    run = F.floor(F.col("batch") / RUN)
    before, offsets = 0, []
    for r in configs.groupBy(run.alias("run")).agg(F.sum("batch_size").alias("n")).orderBy("run").collect():
        offsets.append((r.run, before))
        before += r.n
    starts = spark.createDataFrame(offsets, "run long, first long")
    in_run = F.coalesce(F.sum("batch_size").over(Window.partitionBy("run").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = configs.withColumn("run", run).withColumn("in_run", in_run).join(F.broadcast(starts), "run").withColumn("before", F.col("first") + F.col("in_run"))
    planned = placed.where(F.col("before") < total)
    return planned.withColumn("batch_size", F.least(F.col("batch_size"), F.lit(total) - F.col("before")).cast("int")).select("batch", *CONFIG)


def plan_batches_by(totals: DataFrame, key: str, total: str, most: int = 50, seed: int = 42) -> DataFrame:
    """A plan for each row of ``totals`` (one for each key): the key, number (from 0), batch (``key:number``) and CONFIG. A total that is null, or 0 or less, has no batch.

    A batch's place in its key's plan is the sum of the runs of batches before its own and of the batches before it in its run, so a key of
    any size is planned by many tasks.
    """
    least = min(min(BATCH_SIZES), most)
    each = totals.where(F.col(total) > 0).select(key, F.col(total).alias("of"), F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(total) / least) - 1)).alias("number"))
    named = each.withColumn("batch", F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("number").cast("string")))
    configs = sampled(named, seed).withColumn("batch_size", F.least("batch_size", F.lit(most))).withColumn("run", F.floor(F.col("number") / RUN))
    passed = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    runs = configs.groupBy(key, "run").agg(F.sum("batch_size").alias("n"))
    firsts = runs.select(F.col(key).alias("k"), F.col("run").alias("r"), F.coalesce(F.sum("n").over(passed(key).orderBy("run")), F.lit(0)).alias("first"))
    in_run = F.coalesce(F.sum("batch_size").over(passed(key, "run").orderBy("number")), F.lit(0))
    placed = configs.withColumn("in_run", in_run).join(firsts, F.col(key).eqNullSafe(F.col("k")) & (F.col("run") == F.col("r"))).withColumn("before", F.col("first") + F.col("in_run"))
    size = F.least(F.col("batch_size"), F.col("of") - F.col("before")).cast("int")
    return placed.where(F.col("before") < F.col("of")).withColumn("batch_size", size).select(key, "number", "batch", *CONFIG)


def preview_configs(n: int = 3, seed: int = 42) -> Callable[[SparkSession], DataFrame]:
    """Some configurations as they may be sampled."""
    return lambda spark: sample_configs(spark, n, seed)


def preview_plan(plan: DataFrame) -> DataFrame:
    """The plan's text, a row for each line in order of ``batch`` and ``line_no``: what a dry run shows."""
    show = lambda no, label, c: F.struct(F.lit(no).alias("line_no"), F.concat(F.lit(f"{label}: "), F.col(c).cast("string")).alias("line"))
    lines = [
        F.struct(F.lit(0).alias("line_no"), F.format_string("batch %d: %d dialogs", F.col("batch") + 1, "batch_size").alias("line")),
        *[show(k + 1, label, c) for k, (label, c) in enumerate((("sphere", "business_sphere"), ("region", "regional_focus"), ("style", "communication_style"), ("quality", "transcription_quality"), ("personal data, %", "pd_percentage")))],
    ]
    return plan.select("batch", F.inline(F.array(*lines)))


#: A template of our own: callers bring theirs.
TEMPLATE = (
    "Составь JSON-массив из {total_dialogs} телефонных диалогов на русском языке.\n"
    "Сфера: {business_sphere}. {sphere_details}\nРегион: {regional_focus}. {region_details}\n"
    "Запись речи: {transcription_quality}. {quality_details}\nСтиль: {communication_style}. {style_details}\n"
    "С личными данными: {pd_count} ({pd_percentage}%), без них: {no_pd_count} ({no_pd_percentage}%), похожее на них: {false_positive_percentage}%.\n"
    "Поля диалога: text, entities (start, end, type, text), has_pd, description, id. Только JSON."
)


def render_prompts(plan: DataFrame, details: dict[str, dict[str, str]] | None = None, template: str = TEMPLATE) -> DataFrame:
    """Adds ``prompt``. ``details``: texts by value for sphere, region, quality and style; a region without one takes the default region's."""
    details = details or {}

    def detail(kind: str, column: str, default: str = "") -> Column:
        table = {"": ""} | details.get(kind, {})
        found = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
        return F.coalesce(F.try_element_at(found, F.col(column)), F.lit(table.get(default, "")))

    pd_count = F.floor(F.col("batch_size") * F.col("pd_percentage") / 100).cast("int")
    values = {
        "total_dialogs": F.col("batch_size"), "pd_count": pd_count, "no_pd_count": F.col("batch_size") - pd_count, "no_pd_percentage": 100 - F.col("pd_percentage"),
        "sphere_details": detail("sphere", "business_sphere"), "region_details": detail("region", "regional_focus", DEFAULT_REGION),
        "quality_details": detail("quality", "transcription_quality"), "style_details": detail("style", "communication_style"),
        **{c: F.col(c) for c in CONFIG if c != "batch_size"},
    }
    prompt = F.lit(template)
    for name, value in values.items():
        prompt = F.replace(prompt, F.lit("{" + name + "}"), value.cast("string"))
    return plan.withColumn("prompt", prompt)


def parse_reply(reply: Column) -> Column:
    """A reply's dialogs: without code fences, a JSON array; anything else is an empty array."""
    bare = F.regexp_replace(F.regexp_replace(F.btrim(reply, F.lit(" \t\r\n")), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    is_list = F.startswith(bare, F.lit("["))
    return F.coalesce(F.when(is_list, F.from_json(bare, DIALOGS, {"mode": "PERMISSIVE"})), F.array().cast(DIALOGS))


def request(plan: DataFrame, make: Callable[[], Callable[[str], str]], column: str = "prompt", concurrency: int = 3, pause: float = 0.0, ledger: str | None = None) -> DataFrame:
    """Adds ``reply`` by a client made in each of ``concurrency`` tasks that has something to ask; a failed request has a null reply and an ``error``.

    ``pause``: seconds that a task waits between two requests. ``ledger``: a folder that all tasks reach, with the answers of earlier runs if
    there are any; without it, one in the shared folder that lasts as long as the driver.
    """
    folder = ledger or temporary_folder(plan.sparkSession, "ledger")
    ship(plan.sparkSession)
    rows = plan.select(*[F.col(f"`{c}`") for c in plan.columns], F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in plan.columns])), 256).alias("_key"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, client, waited = Ledger(folder, str(TaskContext.get().taskAttemptId())), None, False
        for batch in batches:
            answers = []
            for key, prompt in zip(batch["_key"], batch[column], strict=True):
                answer = kept.find(key)
                if answer is None:
                    client = client or make()
                    if waited and pause:
                        time.sleep(pause)
                    waited = True
                    try:
                        answer = client(prompt), None
                    except Exception as e:  # counted as a failed batch
                        answer = None, str(e)
                    answer = kept.keep(key, *answer)
                answers.append(answer)
            yield batch.assign(reply=[r for r, _ in answers], error=[e for _, e in answers])

    return rows.repartition(concurrency, "_key").mapInPandas(ask, fields + ", reply string, error string").drop("_key")


def generate(plan: DataFrame, make: Callable[[], Callable[[str], str]], concurrency: int = 3, pause: float = 0.0, ledger: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Normalised dialogs, and the replies they come from. A batch with a suspicious dialog without entities is asked for once more.

    If that second reply holds dialogs, they replace the batch's; if it fails, the first reply stays. Both replies are written tables.
    """
    replies = written(request(plan, make, "prompt", concurrency, pause, ledger), "replies").withColumn("dialogs", parse_reply(F.col("reply")))
    suspicious = F.exists("dialogs", lambda d: may_hold_personal_data(d["text"]) & (F.coalesce(F.size(d["entities"]), F.lit(0)) <= 0))
    asked = replies.withColumn("repair", F.coalesce(suspicious, F.lit(False)))
    wanted = asked.where("repair").withColumn("again", F.concat(F.lit("Дополни entities и верни весь массив:\n"), F.col("reply"))).select("batch", F.col("reply").alias("before"), F.col("dialogs").alias("found"), "again")
    second = written(request(wanted, make, "again", concurrency, pause, ledger), "repairs").withColumn("better", parse_reply(F.col("reply")))
    taken = F.size("better") > 0
    mended = second.select("batch", F.when(taken, F.col("reply")).otherwise(F.col("before")).alias("reply"), F.when(taken, F.col("better")).otherwise(F.col("found")).alias("dialogs"))
    rest = asked.drop("reply", "dialogs").join(mended, "batch").select(asked.columns)
    both = asked.where("NOT repair").unionByName(rest)
    rows = both.select("batch", F.posexplode("dialogs").alias("place", "d")).select("batch", "place", "d.*")
    return normalise_dialogs(rows, F.col("place") + 1), both


def generation_counters(replies: DataFrame) -> DataFrame:
    """One row: batches asked, failed, and dialogs received."""
    return replies.agg(
        F.count_if(F.col("reply").isNotNull()).alias("successful_batches"),
        F.count_if(F.col("reply").isNull()).alias("failed_batches"),
        F.coalesce(F.sum(F.size("dialogs")), F.lit(0)).alias("total_generated"),
    )


def sphere_distribution(plan: DataFrame) -> DataFrame:
    """Dialogs planned in each sphere."""
    return plan.groupBy("business_sphere").agg(F.sum("batch_size").alias("dialogs"))

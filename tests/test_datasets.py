import json
import math
import os

import pytest
from pyspark.sql import functions as F

from hushlake.operators import datasets, generation
from hushlake.sources.dialogs import (
    dataset_name, read_dataset, read_dialogs, read_documents, valid_metadata, with_annotation, with_generation_stats, write_dataset, write_dialogs, write_document, write_report,
    write_shards,
)
from hushlake.sources.ledger import Ledger
from hushlake.sources.metrics import file_name
from hushlake.sources.settings import Settings
from hushlake.streaming.masking import masked_stream, type_counts

DIALOG = "text string, entities array<struct<start:long,end:long,type:string,text:string>>, has_pd boolean, description string, id long"

ENTITIES = [
    ((0, 4, "PERSON", "Иван"), "Иван"),
    ((0, 5, "PERSON", " Иван"), "Иван "),
    ((0, 4, "PERSON", "Пётр"), None),
    ((4, 4, "PERSON", ""), None),
    ((-1, 4, "PERSON", "Иван"), None),
    ((0, 99, "PERSON", "Иван"), None),
    ((0, 4, None, "Иван"), None),
]


@pytest.mark.parametrize("entity,text", ENTITIES)
def test_entities_are_checked_and_repaired(spark, entity, text):
    df = spark.createDataFrame([("Иван тут", [entity], None, None, 1), (None, [], True, "", 2)], DIALOG)
    rows = datasets.normalise_dialogs(df).collect()
    assert len(rows) == 1 and rows[0].description == "" and rows[0].has_pd is (text is not None)
    assert [e.text for e in rows[0].entities] == ([text] if text is not None else [])


def some(spark, n):
    return spark.createDataFrame([(f"text {i}", [(0, 4, "A" if i % 2 else None, "text")] * (i % 3), i % 3 > 0, "", i) for i in range(1, n + 1)], DIALOG)


def test_stats_and_report(spark):
    r = datasets.dataset_stats(some(spark, 9)).first()
    assert (r.total_dialogs, r.dialogs_with_pd, r.total_entities) == (9, 6, 9) and r.pd_percentage == pytest.approx(200 / 3)
    assert sum(r.entity_types.values()) == 9 and "UNKNOWN" in r.entity_types
    empty = datasets.dataset_stats(some(spark, 9).limit(0)).first()
    assert (empty.total_dialogs, empty.pd_percentage, empty.total_entities) == (0, 0.0, 0)
    lines = [x.line for x in datasets.report_lines(some(spark, 9)).orderBy("line_no").collect()]
    assert lines[0] == "dialogs: 9" and len(lines) == 7 and lines[4] == "characters a dialog: 6, 6 to 6"
    d = datasets.compare_datasets(some(spark, 3), some(spark, 9)).first()
    assert (d.total_dialogs_difference, d.total_entities_difference) == (6, 6)


def test_valid_dialogs(spark):
    df = some(spark, 3).unionByName(spark.createDataFrame([(None, [], True, "", 7), ("x", None, True, "", 8)], DIALOG))
    ok = datasets.valid_dialog(F.col("text"), F.col("entities"), F.col("has_pd"), F.col("id"))
    assert {r.id: r.ok for r in df.select("id", ok.alias("ok")).collect()} == {1: True, 2: False, 3: True, 7: False, 8: False}


@pytest.mark.parametrize("n", [0, 1, 50, 51, 491])
def test_shards(spark, n):
    rows = datasets.shards(some(spark, max(n, 1)).limit(n)).orderBy("place").collect()
    assert [r.place for r in rows] == list(range(1, n + 1))
    assert {r.shard for r in rows} == set(range(1, math.ceil(n / 50) + 1))
    if n == 491:
        assert rows[-1].dialog_range == "451-491"


def test_merge_and_split(spark):
    merged = datasets.merge_datasets([some(spark, 30), some(spark, 11)])
    assert [r.id for r in merged.orderBy("part", "original_id").collect()] == list(range(1, 42))
    train, val = datasets.split_dataset(merged.drop("original_id"), 0.7, 42)
    assert sorted(r.id for r in train.collect()) == list(range(1, 29)) and sorted(r.id for r in val.collect()) == list(range(1, 14))
    again, _ = datasets.split_dataset(merged.drop("original_id").repartition(5), 0.7, 42)
    assert sorted((r.original_id, r.id) for r in train.collect()) == sorted((r.original_id, r.id) for r in again.collect())


def test_metadata(spark):
    df = spark.createDataFrame([(100, 5, "m", ["a"]), (50, None, "n", None), (1, 2, "m", ["b"])], "total_dialogs long, total_cost_tokens long, model_used string, generation_configs array<string>")
    r = datasets.merge_metadata(df).first()
    assert (r.total_dialogs, r.total_cost_tokens, r.models_used) == (151, 7, ["m", "n"]) and sorted(r.generation_configs) == ["a", "b"]


def test_files(spark, tmp_path):
    whole = {"metadata": {"total_dialogs": 2}, "dialogs": [{"text": "Иван", "personal_data": [{"start": 0, "end": 4, "type": "PERSON", "value": "Иван"}], "id": 7}, {"text": "x", "entities": [], "has_pd": True}]}
    (tmp_path / "a.json").write_text(json.dumps(whole, ensure_ascii=False, indent=2))
    (tmp_path / "b.json").write_text(json.dumps([{"text": "y", "entities": [], "id": 3, "description": "d"}, {"text": "z"}]))
    rows = read_dialogs(spark, f"{tmp_path}/*.json").orderBy("id", "text").collect()
    assert [(r.id, r.text, r.has_pd) for r in rows] == [(2, "x", False), (2, "z", False), (3, "y", False), (7, "Иван", True)]
    assert rows[3].entities[0].text == "Иван"
    assert read_documents(spark, f"{tmp_path}/a.json").first().metadata.total_dialogs == 2
    write_dialogs(some(spark, 4), f"{tmp_path}/out", "has_pd")
    assert spark.read.json(f"{tmp_path}/out").count() == 4
    assert dataset_name("/x/data.json") == "data" and file_name("d", "a b/c") == "d_a_b_c_metrics.csv"


def test_settings(tmp_path):
    (tmp_path / "c.env").write_text("# note\n\nA=1 # one\nB = yes\nAPI_KEY=secret=x\nbroken\nC=\nN=x")
    s = Settings.read(str(tmp_path / "c.env"))
    assert (s.integer("A"), s.flag("B"), s.text("API_KEY"), s.text("C", "d"), s.integer("N", 5), s.flag("Z", True)) == (1, True, "secret=x", "d", 5, True)
    assert s.shown()["API_KEY"] == "***" and "broken" not in s.values
    with pytest.raises(FileNotFoundError):
        Settings.read(str(tmp_path / "none"))


@pytest.mark.parametrize("total,most", [(0, 50), (1, 50), (137, 50), (1000, 30), (10, 3)])
def test_batches(spark, total, most):
    sizes = [r.batch_size for r in generation.plan_batches(spark, total, most).orderBy("batch").collect()]
    assert sum(sizes) == total and all(0 < s <= most for s in sizes)


def test_choices_follow_weights(spark):
    got = {r.regional_focus: r["count"] for r in generation.sample_configs(spark, 20_000).groupBy("regional_focus").count().collect()}
    for region, weight in generation.REGIONS.items():
        assert got[region] / 20_000 == pytest.approx(weight, abs=0.02)


def test_prompts(spark):
    plan = generation.plan_batches(spark, 100)
    details = {"region": {"Москва": "Метро."}}
    for r in generation.render_prompts(plan, details).collect():
        assert "{" not in r.prompt and "Метро." in r.prompt and str(int(r.batch_size * r.pd_percentage / 100)) in r.prompt


def test_a_plan_for_each_key(spark, monkeypatch):
    monkeypatch.setattr(generation, "RUN", 3)
    totals = spark.createDataFrame([("a", 1000), ("b", 7), (None, 120), ("none", 0), ("null", None)], "source string, total long")
    got = generation.plan_batches_by(totals, "source", "total", 40).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append((r.number, r.batch_size, r.batch))
    assert {k: sum(n for _, n, _ in v) for k, v in by.items()} == {"a": 1000, "b": 7, None: 120}
    for k, v in by.items():
        assert sorted(x for x, _, _ in v) == list(range(len(v))) and {b for _, _, b in v} == {f"{k or ''}:{x}" for x in range(len(v))}
        assert all(25 <= n <= 40 for _, n, _ in sorted(v)[:-1])


REPLIES = [("[]", 0), ('```json\n[{"text": "a"}]\n```', 1), ('{"text": "a"}', 0), ("[{broken", 0), (None, 0), ('[{"text": "a", "entities": []}, {"x": 1}]', 2)]


@pytest.mark.parametrize("reply,n", REPLIES)
def test_replies(spark, reply, n):
    got = spark.createDataFrame([(reply,)], "r string").select(generation.parse_reply(F.col("r")).alias("d")).first().d
    assert len(got) == n


def test_generation_with_repair(spark):
    good = json.dumps([{"text": "почта a@b.ru", "entities": [{"start": 6, "end": 12, "type": "EMAIL", "text": "a@b.ru"}]}], ensure_ascii=False)
    bad = json.dumps([{"text": "почта a@b.ru", "entities": []}], ensure_ascii=False)

    def make():
        def client(prompt):
            if prompt == "fail":
                raise ValueError("no")
            return good if prompt.startswith("Дополни") else bad if prompt == "bad" else "[]"

        return client

    plan = spark.createDataFrame([(0, "bad"), (1, "fail"), (2, "none")], "batch long, prompt string")
    dialogs, replies = generation.generate(plan, make, 2)
    rows = dialogs.collect()
    assert [(r.batch, r.has_pd) for r in rows] == [(0, True)]
    r = generation.generation_counters(replies).first()
    assert (r.successful_batches, r.failed_batches, r.total_generated) == (2, 1, 1)


def test_each_prompt_is_sent_once(spark, tmp_path):
    bad = json.dumps([{"text": "почта a@b.ru", "entities": []}], ensure_ascii=False)
    log = str(tmp_path / "log")

    def make():
        def client(prompt):
            with open(log, "a") as f:
                f.write("x")
            return bad

        return client

    plan = spark.range(10).select(F.col("id").alias("batch"), F.concat(F.lit("p"), "id").alias("prompt"))
    dialogs, replies = generation.generate(plan, make, 2)
    for _ in range(2):
        assert [r.id for r in dialogs.collect()] == [1] * 10 and generation.generation_counters(replies).first().successful_batches == 10
    assert len(open(log).read()) == 20  # one request and one repair for each batch


def test_a_killed_task_sends_one_prompt_twice_at_most(spark, tmp_path):
    log, ledger = tmp_path / "log", f"{tmp_path}/ledger"
    plan = spark.range(12).select(F.col("id").alias("batch"), F.concat(F.lit("p"), "id").alias("prompt"), F.lit("x").alias("reply_to"))

    def make(kill_after):
        def load():
            sent = []

            def client(prompt):
                with open(log, "a") as f:
                    f.write(prompt + "\n")
                sent.append(prompt)
                if len(sent) == kill_after:
                    os._exit(1)
                if prompt == "p3":
                    raise ValueError("no")
                return prompt.upper()

            return client

        return load

    with pytest.raises(Exception):
        generation.request(plan, make(5), concurrency=1, ledger=ledger).collect()
    asked = generation.request(plan, make(None), concurrency=2, ledger=ledger)
    for _ in range(2):
        assert sorted((r.prompt, r.reply, r.error) for r in asked.collect()) == sorted((f"p{i}", None if i == 3 else f"P{i}", "no" if i == 3 else None) for i in range(12))
    sent = log.read_text().split()
    assert set(sent) == {f"p{i}" for i in range(12)} and len(sent) <= 13
    again = plan.unionByName(plan.where("batch < 2"))
    assert generation.request(again, make(None), ledger=ledger).count() == 14 and len(log.read_text().split()) == len(sent)


def test_a_ledger_keeps_the_first_answer(tmp_path):
    one, two = Ledger(f"{tmp_path}/l", "1"), Ledger(f"file://{tmp_path}/l", "2")
    assert one.find("abcd") is None and one.keep("abcd", "r", None) == ("r", None)
    assert two.keep("abcd", "other", "e") == ("r", None) and len([p for p in tmp_path.rglob("*") if p.is_file()]) == 1


def test_documents_round_trip(spark, tmp_path):
    rows = some(spark, 7)
    write_document(rows, {"model_used": "m", "generation_stats": {"n": 1}}, f"{tmp_path}/one")
    read = read_documents(spark, f"{tmp_path}/one").first()
    assert (read.metadata.total_dialogs, read.metadata.model_used) == (7, "m") and read.metadata.generation_timestamp > 0
    assert [d.id for d in read.dialogs] == list(range(1, 8)) and [d.text for d in read.dialogs] == [f"text {i}" for i in range(1, 8)]
    write_shards(datasets.shards(rows, 3), f"{tmp_path}/shards", "parent")
    shards = {r.metadata.subset_number: r for r in read_documents(spark, f"{tmp_path}/shards/*/*.txt").collect()}
    assert sorted(shards) == [1, 2, 3] and shards[3].metadata.dialog_range == "7-7" and shards[1].metadata.parent_dataset == "parent"
    assert [d.id for k in (1, 2, 3) for d in shards[k].dialogs] == list(range(1, 8))
    write_dataset(rows, {"model_used": "m"}, f"{tmp_path}/any")
    dialogs, metadata = read_dataset(spark, f"{tmp_path}/any")
    assert dialogs.count() == metadata["total_dialogs"] == 7 and valid_metadata(metadata) and not valid_metadata({})
    assert with_generation_stats({"generation_stats": {"a": 1}}, {"b": 2})["generation_stats"] == {"a": 1, "b": 2}
    assert with_annotation({}, "manual", 3)["manual_annotation"] == 3
    write_report(datasets.report_lines(rows), f"{tmp_path}/report")
    assert spark.read.text(f"{tmp_path}/report").first().value == "dialogs: 7"
    plan = generation.preview_plan(generation.plan_batches(spark, 60))
    assert plan.where("line_no = 0").count() == generation.plan_batches(spark, 60).count()


def test_streams(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a@b.ru"), ("2024-01-01 00:03:00", "10.0.0.1 x@y.org"), ("2024-01-01 01:00:00", "нет")]
    spark.createDataFrame(rows, "t string, text string").withColumn("t", F.col("t").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("t timestamp, text string").parquet(f"{tmp_path}/in")
    for name, df, mode in (("masked", masked_stream(stream), "append"), ("counts", type_counts(stream, "t"), "complete")):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert sorted(r.masked for r in spark.table("masked").collect()) == ["<EMAIL>", "<IP_ADDRESS> <EMAIL>", "нет"]
    assert {(r.type, r.n) for r in spark.table("counts").collect()} == {("EMAIL", 2), ("IP_ADDRESS", 1)}


@pytest.mark.parametrize("n,partitions", [(50_000, "8"), (50_000, "211"), (300_000, "8")])
def test_numbers_are_whole_at_size(spark, tmp_path, n, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        wide = spark.range(n).select((F.lit(n) - F.col("id")).alias("id"), F.repeat(F.lit("wide"), 40).alias("text"), F.lit("clash").alias("part"), F.lit("clash").alias("row")).repartition(5)
        datasets.numbered(wide, ["id"], "number").write.parquet(f"{tmp_path}/numbered")
        r = spark.read.parquet(f"{tmp_path}/numbered")
        assert r.agg(F.count_distinct("number"), F.min("number"), F.max("number"), F.count_if(F.col("number") != F.col("id"))).first() == (n, 1, n, 0)
        assert r.where("part <> 'clash' OR row <> 'clash'").count() == 0
        train, val = datasets.split_dataset(wide)
        assert (train.count(), val.count(), train.unionByName(val).select("original_id").distinct().count()) == (int(n * 0.7), n - int(n * 0.7), n)
        shards = datasets.shards(wide, 1000).groupBy("shard").count().collect()
        assert sorted(r[0] for r in shards) == list(range(1, n // 1000 + 1)) and {r[1] for r in shards} == {1000}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_repeated_and_missing_ids_keep_their_rows(spark):
    df = spark.createDataFrame([(None, f"t{i}") for i in range(500)] + [(1, "same")] * 300, "id long, text string")
    train, val = datasets.split_dataset(df, 0.5)
    assert sorted(r.id for r in train.collect()) == list(range(1, 401)) and sorted(r.id for r in val.collect()) == list(range(1, 401))
    assert datasets.numbered(df, ["id"], "no").agg(F.count_distinct("no")).first()[0] == 800

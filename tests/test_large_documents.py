import json
import random

import pytest
from pyspark.sql import functions as F

from hushlake.sources import dialogs as files
from hushlake.sources import parts

HARD = ["}", "{", "]", "[", '"', "\\", '\\"', "\\\\", '"dialogs": [', "}]}", "é😀", "\n", "\t", ",", ":", "a", "слово ", "\\u007d", "/", "\x01", " "]


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def some(n, seed):
    rng = random.Random(seed)
    text = lambda most: "".join(rng.choice(HARD) for _ in range(rng.randint(0, most)))
    out = []
    for i in range(n):
        d = {"text": text(30), "id": rng.choice([i + 10, None]), "description": rng.choice([None, text(4)])}
        named = rng.choice([("entities", "text"), ("personal_data", "value"), None])
        if named:
            d[named[0]] = [{"start": k, "end": k + 1, "type": text(2), named[1]: text(3)} for k in range(rng.randint(0, 3))]
        out.append({k: v for k, v in d.items() if rng.random() > 0.1 or k == "text"})
    return out


METADATA = {"total_dialogs": 3, "model_used": "a}{\"[", "generation_configs": [{"a": {"b": [1, {"c": "]"}]}}, {"dialogs": [[1], [2]]}], "generation_timestamp": 1.5}
SHAPES = {
    "before": lambda d: {"metadata": METADATA, "dialogs": d}, "after": lambda d: {"dialogs": d, "metadata": METADATA, "x": {"y": {"z": 1}}}, "alone": lambda d: {"dialogs": d}, "bare": lambda d: d,
    "texts": lambda d: {"note": '\\"dialogs\\": [{}]', "dialogs": d},
}


@pytest.mark.parametrize("shape", SHAPES)
def test_equals_the_plain_reader(spark, tmp_path, small_ranges, shape):
    for k, (n, style) in enumerate([(0, {}), (1, {}), (60, {}), (60, {"indent": 2}), (40, {"ensure_ascii": False, "separators": (",", ":")}), (30, {"ensure_ascii": False, "indent": 1})]):
        (tmp_path / f"d{k}.json").write_text(json.dumps(SHAPES[shape](some(n, k)), **style), encoding="utf-8")
    paths = f"{tmp_path}/*.json"
    assert spark.read.option("lineSep", "}").text(paths).rdd.getNumPartitions() > 20
    key = lambda r: (r.file, r.pos)
    want = sorted(files.read_dialogs(spark, paths).collect(), key=key)
    got = sorted(files.read_large_dialogs(spark, paths).collect(), key=key)
    assert len(want) == 191 and [r.asDict(True) for r in got] == [r.asDict(True) for r in want]


def test_other_documents(spark, tmp_path, small_ranges):
    cases = {
        "scalars": ('{"dialogs": [1, "a{", [2, 3], null], "m": {"a": {"b": 1}}}', []), "mixed": ('[ [1], 7, {"text": "x"} , "s", {"text": "y"}]', ["x", "y"]), "none": ('{"metadata": {"a": {"b": [{}]}}}', []), "empty": ("", []),
        "bom": ('﻿ [{"text": "z"}]\n', ["z"]), "other shape": ('[{"text": "a"}, {"text": {"b": 1}}, {"q": 1}]', ["a", '{"b":1}']), "deep": ('{"m": {"dialogs": [{"text": "no"}]}, "dialogs" : [ {"text": "yes"} ] }', ["yes"]),
    }
    for name, (content, _) in cases.items():
        (tmp_path / f"{name}.json").write_text(content, encoding="utf-8")
    got = {name: [] for name in cases}
    for r in files.read_large_dialogs(spark, str(tmp_path)).orderBy("file", "pos").collect():
        got[r.file.rsplit("/", 1)[1][:-5].replace("%20", " ")].append(r.text)
    assert got == {name: want for name, (_, want) in cases.items()}


def test_a_document_is_written_and_read_by_many_tasks(spark, tmp_path):
    n = 20_000
    rows = spark.range(n).select((F.lit(n) - F.col("id")).alias("id"), F.concat(F.lit('}{"\\ '), F.col("id")).alias("text"), F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("T").alias("type"), F.lit("}").alias("text"))).alias("entities"), F.lit(True).alias("has_pd"), F.lit("").alias("description"))
    files.write_document(rows.repartition(6), {"model_used": "m"}, f"{tmp_path}/one")
    written = list((tmp_path / "one").glob("part-*"))
    assert len(written) == 1
    read = json.loads(written[0].read_text(encoding="utf-8"))
    assert read["metadata"]["total_dialogs"] == n and read["metadata"]["model_used"] == "m" and [d["id"] for d in read["dialogs"]] == list(range(1, n + 1))
    back = files.read_large_dialogs(spark, f"{tmp_path}/one")
    assert back.select("id", "text", "entities").exceptAll(rows.select("id", "text", F.col("entities").cast(f"array<{files.ENTITY}>"))).count() == 0 and back.count() == n
    assert back.where("pos + 1 <> id").count() == 0
    files.write_document(rows.limit(0), {}, f"{tmp_path}/none")
    assert json.loads(next((tmp_path / "none").glob("part-*")).read_text())["dialogs"] == [] and files.read_large_dialogs(spark, f"{tmp_path}/none").count() == 0


def test_no_task_writes_or_reads_a_whole_document(spark, tmp_path):
    n = 3000
    rows = spark.range(n).select((F.lit(n) - F.col("id")).alias("id"), F.concat(F.lit('"dialogs": [}{"\\ ]'), F.col("id")).alias("text"), F.when(F.col("id") % 2 == 0, F.lit("}")).alias("description"))
    path = f"{tmp_path}/in parts"
    files.write_document(rows, {"model_used": "m}"}, path, part_bytes=20_000)
    written = sorted((tmp_path / "in parts").glob("part-*"))
    whole = "".join(p.read_text(encoding="utf-8") for p in written)
    read = json.loads(whole)
    assert len(written) > 8 and max(p.stat().st_size for p in written) < len(whole) / 4
    assert read["metadata"]["total_dialogs"] == n and [d["id"] for d in read["dialogs"]] == list(range(1, n + 1))
    back = files.read_large_dialogs(spark, path, in_parts=True)
    got = {r.pos: (r.id, r.text, r.description) for r in back.collect()}
    assert len(got) == back.count() == n and got == {k: (d["id"], d["text"], d.get("description", "")) for k, d in enumerate(read["dialogs"])}
    assert back.select("file").distinct().count() == 1


def test_a_failed_task_leaves_no_document(spark, tmp_path):
    bad = spark.range(50).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"), F.lit("t").alias("text"))
    with pytest.raises(Exception, match="broken"):
        files.write_document(bad, {}, f"{tmp_path}/bad")
    assert not list(tmp_path.glob("bad/part-*"))


def test_pieces_know_their_depth(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": "}", "dialogs": [{"b": "{"}, {"c": {}}]}')
    rows = parts.pieces(spark, f"{tmp_path}/x.json", "dialogs").orderBy("place").collect()
    assert [(r.depth, r.depth_after, r.closes, r.level) for r in rows] == [(0, 1, False, 0), (1, 2, True, 2), (2, 3, True, 0), (3, 2, True, 0), (2, 0, True, 0)]

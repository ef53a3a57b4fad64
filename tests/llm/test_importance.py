import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushlake.llm import importance
from hushlake.llm.importance import BLOCK, RECORD, RunReader, RunWriter, buckets_of, ranks, resample, stream, tournament

COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]


def features(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(lower))
    return words, [zlib.crc32(f.encode()) % 10_000 for f in [*words, *map(" ".join, zip(words, words[1:], strict=False))]]


def brute(docs, target, percent=25, least=20, seed=7):
    s, t = Counter(), Counter()
    for text in target:
        t.update(features(text)[1])
    made = [(d, *features(x)) for d, x in docs]
    for _, _, f in made:
        s.update(f)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000)))) for b in range(10_000)}
    rows = []
    for d, words, f in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    may = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(may[: percent * len(may) // 100], 1)}
    return [(*r[:4], rank.get(id(r))) for r in rows]


def ordered(rows):
    return sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])


def some(n, seed=1):
    rng = random.Random(seed)
    vocab = ["the", "Of", "NEW", "été", "ÉTÉ", "x1", "42", "日本", "don't", "a_b", "İ"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    docs += [(None, "lonely words " * 15), (None, None), (5, ""), (5, "a b"), (-3, "new york " * 4000), (10**18, "x " * 19), (10**18 + 1, "x " * 20)]
    return docs, ["the new york été", None, "", "42 words of x1 the new"]


@pytest.mark.parametrize(("fan_in", "rows"), [(64, 500_000), (2, 1), (3, 2048)])
def test_equals_the_plain_version(spark, fan_in, rows):
    docs, target = some(900)
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score int").repartition(7)
    got = resample(df, spark.createDataFrame([(t,) for t in target], "text string"), fan_in=fan_in, rows_per_task=rows).collect()
    assert ordered(tuple(r[c] for c in COLUMNS) for r in got) == ordered(brute(docs, target))


def test_equal_rows_that_are_a_third_of_the_table(spark):
    docs = some(400)[0] + [(77, "one row again and again " * 6)] * 200
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = resample(df, spark.createDataFrame([("again",)], "text string"), fan_in=2, rows_per_task=1).collect()
    assert ordered(tuple(r[c] for c in COLUMNS) for r in got) == ordered(brute(docs, ["again"]))


def test_empty_tables(spark):
    none, target = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert resample(none, target).count() == 0
    short = spark.createDataFrame([(1, "two words")], "doc_id long, text string")
    assert [(r.n_features, r.weight, r["rank"]) for r in resample(short, target).collect()] == [(3, brute([(1, "two words")], [])[0][2], None)]


def test_hashes_go_on_over_two_words():
    text = "ÉTÉ an-d 4x the_The\t日本"
    found, n = buckets_of(text)
    words, want = features(text)
    assert sorted(found.tolist()) == sorted(want) and n == len(words)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 13])
def test_a_tournament_merges_all_streams(n):
    rng = random.Random(n)
    runs = [sorted((rng.randint(0, 50), rng.randint(0, 3), i) for i in range(rng.choice([0, 1, 40]))) for _ in range(n)]
    assert list(tournament([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_a_run_is_read_by_slices_and_keys(tmp_path):
    rng = np.random.default_rng(1)
    records = np.zeros(5 * BLOCK + 17, RECORD)
    for name in RECORD.names:
        records[name] = rng.integers(-50, 50, len(records))
    records = np.sort(records, order=["minus", "doc_id"])
    out = RunWriter(f"{tmp_path}/a/run", "1")
    for part in np.array_split(records, [3, BLOCK, BLOCK + 1, 4000]):
        out.add(part)
    assert not (tmp_path / "a" / "run").exists()
    out.close()
    reader, keys = RunReader(f"{tmp_path}/a/run"), [(r["minus"], r["doc_id"]) for r in records.tolist() and records]
    assert reader.index() == [tuple(map(int, keys[i])) for i in range(0, len(keys), BLOCK)]
    asked = [(-60, 0), (0, 0), (3, -9), (60, 1), tuple(map(int, keys[BLOCK])), tuple(map(int, keys[-1]))]
    assert reader.places(asked) == [sum(k < a for k in keys) for a in asked]
    assert list(stream([(f"{tmp_path}/a/run", 5, 3000), (f"{tmp_path}/a/run", 3000, 3001)])) == records[5:3001].tolist()


def test_segments_past_the_draw_are_not_merged(spark, monkeypatch):
    rows = spark.range(40_000).select(F.col("id").alias("row_no"), F.col("id").alias("doc_id"), (F.xxhash64("id") % 10_000).alias("score")).repartition(6)
    want = [r.row_no for r in rows.orderBy(F.desc("score"), "doc_id").limit(1234).collect()]
    got = ranks(rows, 1234, fan_in=3, rows_per_task=4096)
    plan = importance._merges(importance.write_runs(rows, importance.new_folder(spark, "sorted-runs")), 64, 4096)
    assert plan.count() > 4  # several tasks share a merge
    assert [r.row_no for r in got.orderBy("rank").collect()] == want and got.count() == 1234

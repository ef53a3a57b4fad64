import pytest

from hushlake.llm.mixing import mix_sources


def docs(spark, counts):
    rows, n = [], 0
    for source, count in counts.items():
        for _ in range(count):
            rows.append((n, f"text {n}", source, "clash"))
            n += 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy string")


def test_sources_reach_their_weights(spark):
    table = docs(spark, {"big": 6000, "small": 300, "none": 500, None: 200})
    mixed = mix_sources(table, {"big": 1.0, "small": 2.0, None: 1.0}, total=8000)
    got = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert got["big"] == pytest.approx(2000, rel=0.1)
    assert got["small"] == pytest.approx(4000, rel=0.1)
    assert got[None] == pytest.approx(2000, rel=0.1)
    assert "none" not in got


def test_counts_follow_the_distribution(spark):
    table = docs(spark, {"a": 4000})
    rows = mix_sources(table, total=4000 * 40).groupBy("doc_id").count().collect()  # a rate of 40: several draws
    counts = [r["count"] for r in rows]
    mean = sum(counts) / len(counts)
    assert mean == pytest.approx(40, rel=0.02)
    assert sum((c - mean) ** 2 for c in counts) / len(counts) == pytest.approx(40, rel=0.15)


def test_repeats_and_copies_are_whole(spark):
    table = docs(spark, {"a": 300, "b": 100}).repartition(3)
    first = mix_sources(table, seed=5).collect()
    again = mix_sources(table.repartition(7), seed=5).collect()
    assert sorted(first) == sorted(again)
    by = {}
    for r in first:
        by.setdefault(r.doc_id, []).append((r.copy, r.n_copies))
    assert all(sorted(c for c, _ in x) == list(range(x[0][1])) for x in by.values())


def test_empty_table_and_null_text(spark):
    schema = "doc_id long, text string, source string"
    assert mix_sources(spark.createDataFrame([], schema)).count() == 0
    assert mix_sources(spark.createDataFrame([(None, None, None)], schema), total=30).count() > 5


def test_rows_without_an_id_draw_on_their_own(spark):
    table = spark.createDataFrame([(None, f"text {i}", "a") for i in range(4000)] + [(7, "same", "a")] * 50 + [(8, "long " * 200_000, None)], "doc_id long, text string, source string")
    rows = mix_sources(table, {"a": 1.0, None: 0.0}, total=4050).collect()
    assert 3700 < len(rows) < 4400 and len({r.text for r in rows}) > 2300
    assert len({r.shuffle_key for r in rows if r.doc_id is None}) == sum(r.doc_id is None for r in rows)
    same = [r.n_copies for r in rows if r.doc_id == 7]
    assert len(same) == 50 * (same[0] if same else 0)
    assert mix_sources(table, {None: 1.0}, total=3).count() in range(20)

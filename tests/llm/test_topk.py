import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushlake.llm import topk
from hushlake.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, queries, k):
    def ints(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * x) for x in v]

    known = {(i, tuple(ints(v))) for i, v in rows if i is not None and ints(v) is not None}
    out = {}
    for qi, qv in {(i, tuple(ints(v))) for i, v in queries if ints(v) is not None}:
        scores = sorted((-max(-topk.MOST, min(topk.MOST, sum(a * b for a, b in zip(qv, v, strict=False)))), i) for i, v in known if i != qi)
        out[qi] = [(i, -s) for s, i in scores[:k]]
    return out


def check(spark, rows, queries, k=10, **options):
    make = lambda x: spark.createDataFrame([(i, v, 1) for i, v in x], SCHEMA)
    got = {}
    for r in sorted(top_k(make(rows), make(queries), k, **options).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {q: best for q, best in plain(rows, queries, k).items() if best}


@pytest.mark.parametrize("options", [{}, {"page_rows": 16, "block_queries": 4}, {"page_rows": 7, "fan_out": 3, "task_rows": 40}])
def test_equals_all_products(spark, options):
    rng = random.Random(6)
    f = lambda: round(rng.gauss(0, 1) * 64) / 64
    centers = [[4 * f() for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + f() / 4 for c in rng.choice(centers)]) for i in range(400)]
    rows += [(400 + i, [1.0] * 8) for i in range(60)] + [(460 + i, [0.0] * 8) for i in range(5)]
    rows += [(470, None), (471, [None] * 8), (472, [float("nan")] * 8), (473, [float("inf")] + [0.0] * 7), (474, [9.0] * 8), (None, [1.0] * 8), (3, rows[3][1])]
    check(spark, rows, [r for r in rows if r[0] is not None and r[0] % 10 == 0], **options)


def test_few_and_short_vectors(spark):
    check(spark, [(0, [1.0]), (100, [1.0, 2.0]), (7, [])], [(0, [1.0]), (100, [1.0, 2.0])])
    check(spark, [(0, [1.0])], [(0, [1.0])])


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(0, [1.0], 1)], SCHEMA)
    assert top_k(none, some).count() == 0 and top_k(some, none).count() == 0


@pytest.mark.parametrize("size", [1e6, 3e37])
def test_large_components_take_part(spark, size):
    rng = random.Random(2)
    single = lambda x: float(np.float32(x))
    rows = [(i, [single(rng.uniform(-size, size)), single(rng.random()), 1.0]) for i in range(60)] + [(100, [single(size), 1.0, 0.0]), (110, [single(-size), 0.5, 0.0])]
    check(spark, rows, [r for r in rows if r[0] % 10 == 0], page_rows=8, fan_out=3)


def test_an_id_with_several_vectors_and_equal_vectors(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(i, [1.0, 1.0]) for i in range(1, 30)] + [(50, [2.0, 2.0]), (50, [3.0, 1.0])]
    check(spark, rows, [rows[0], (10, [1.0, 1.0]), rows[-1]], k=5, page_rows=4)


def test_columns_named_like_the_tree_s_do_not_clash(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0], "x", "y", "z") for i in range(20)], "vec_id long, embedding array<float>, key string, node string, v string")
    assert top_k(rows, rows.where("vec_id = 0"), 3).count() == 3


def test_pages_are_balls_that_a_search_skips(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 4)) * 20
    rows = [(i, [float(x) for x in centers[i % 40] + rng.normal(size=4)]) for i in range(4000)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    space, pages = topk.indexed(vectors, 10, page_rows=32, fan_out=8, task_rows=700)
    kept = pages.collect()
    by_node = {p.node: p for p in kept}
    inner = [p for p in kept if p.children is not None]
    for p in inner:  # children's radii and stored distances are those of their vectors and routing objects
        x, radii, apart = np.frombuffer(p.matrix).reshape(-1, 4), np.frombuffer(p.radii), np.frombuffer(p.distances)
        assert len(set(np.round(radii, 6))) > 1
        for c, name in enumerate(p.children):
            child = by_node[name]
            assert child.children is not None or np.frombuffer(child.distances).max() == pytest.approx(radii[c])
            assert p.node == "r" or apart[c] >= 0 and len(x) == len(radii)
    leaves = [p for p in kept if p.children is None]
    assert sorted(i for p in leaves for ids in p.ids for i in ids) == list(range(4000)) and max(len(p.ids) for p in leaves) <= 32 and max(p.node.count(".") for p in leaves) >= 2
    asked = topk.written(topk._clean(vectors.where("vec_id % 100 = 0")).select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("query_id"), "v", "norm2"), "queries")
    read = topk.search_tree(pages, asked, space, 10).agg(F.sum("n_pages"), F.count("q")).first()
    assert read[1] == 40 and read[0] < 0.5 * 40 * len(kept)
    topk.drop_index(pages)
    check(spark, rows, [r for r in rows if r[0] % 100 == 0], page_rows=32, fan_out=8, task_rows=700)

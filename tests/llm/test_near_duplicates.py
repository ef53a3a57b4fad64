import random

import pytest

from hushlake.llm.near_duplicates import choose_bands, near_duplicates, one_of_each_class

from . import brute


def grams(text):
    words = brute.WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain(rows):
    sets = {i: grams(t) for i, t in rows}
    ids = list(sets)
    links = {i: 0 for i in ids}
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: (root(i), links[i]) for i in ids}


def corpus(seed=5, groups=25, near=30):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    texts = []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 6) if g else near):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    texts += [passage + " " + " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [None, "", "   ", "a b", "a  b", "a b c d"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("options", [{}, {"block_nodes": 7}, {"component_nodes": 3, "block_nodes": 5}])
def test_equals_all_pairs(spark, options):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = {r.k1: (r.class_id, r.n_links) for r in near_duplicates(docs, **options).collect()}
    assert got == plain(rows)


def test_one_of_each_class(spark):
    rows = corpus(9, 10, 10) + [(500, "the same row here twice now")] * 2 + [(None, "no id"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {c for c, _ in plain([r for r in rows if r[0] is not None]).values()}
    kept = [r.doc_id for r in one_of_each_class(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted(want)
    assert kept.count(None) == 2


def test_bands_reach_their_recall():
    for threshold in (0.5, 0.8, 0.95):
        bands, rows = choose_bands(threshold, 0.999, 256)
        assert bands * rows <= 256 and 1 - (1 - threshold**rows) ** bands >= 0.999


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_texts_and_clashing_columns(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(5000)}" for _ in range(40_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:20_000] + ["x"] + long[20_000:])), (3, " ".join(long[:20_000])), (4, "same " * 50_000), (5, "same " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.k1: (r.class_id, r.n_links) for r in near_duplicates(docs).collect()}
    assert got == plain(rows)
    kept = one_of_each_class(docs.selectExpr("*", "'a' AS k1", "'b' AS row", "'c' AS class_key", "'d' AS node")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 4] and {(r.k1, r.row, r.class_key, r.node) for r in kept} == {("a", "b", "c", "d")}

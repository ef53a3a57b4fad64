import random
import re
from collections import Counter

import numpy as np
import pytest

from hushlake.llm.collocations import Bitmaps, extended, mine_collocations, phrase_counts

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute_counts(rows):
    count, totals = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang or "und"] += len(words)
            for k in range(1, 5):
                count.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return count, totals


def brute(rows, least, most):
    count, totals = brute_counts(rows)
    cand = {k: f for k, f in count.items() if len(k[1]) > 1 and f >= least}
    out = []
    for (lang, words), a in cand.items():
        if any(100 * f >= 80 * a and len(w) > len(words) and any(w[i : i + len(words)] == words for i in range(len(w) - len(words) + 1)) for (g, w), f in cand.items() if g == lang):
            continue
        score, _, left, right = min((2_000_000 * a // (count[lang, words[:k]] + count[lang, words[k:]]), k, count[lang, words[:k]], count[lang, words[k:]]) for k in range(1, len(words)))
        out.append((lang, " ".join(words), a, left, right, totals[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:most]
        ranked += [(lang, rank, *x[1:]) for rank, x in enumerate(own, 1)]
    return sorted(ranked)


def some(n, seed=3):
    rng = random.Random(seed)
    vocab = ["the", "of", "new", "york", "city", "a", "é", "São", "paulo", "İ", "x y", "Ünder", "-"]
    weights = [9, 7, 4, 4, 4, 6, 2, 2, 2, 1, 1, 1, 1]
    join = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "?!", "\r\n", ":"]
    def one():
        return "".join(rng.choices(vocab, weights)[0] + rng.choice(join) for _ in range(rng.randint(0, 40)))
    rows = [(rng.choice(["en", "en", "de", None, "und"]), one()) for _ in range(n)]
    return rows + [("en", "New York City. " * 300), ("en", None), ("de", ""), (None, " \n.,"), ("fr", "une seule fois"), *[("de", "the same row of words")] * 200]


@pytest.mark.parametrize(("least", "most", "shard"), [(5, 2000, 2_000_000), (5, 7, 300), (30, 3, 50), (1, 100, 1000)])
def test_equals_counting_all_runs_of_words(spark, least, most, shard):
    rows = some(150 if least == 1 else 600)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = mine_collocations(docs, least, most, shard).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows, least, most)


def test_counts_are_sums_over_shards(spark):
    rows = some(300, 9)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    counts, totals = phrase_counts(docs, 10, 200)
    want, n = brute_counts(rows)
    assert {(r.lang, r.phrase): r.f for r in counts.collect()} == {(lang, " ".join(w)): f for (lang, w), f in want.items() if f >= 10}
    assert {r.lang: r.n for r in totals.collect()} == {k: v for k, v in n.items() if v}


@pytest.mark.parametrize("most_cuts", [1, 40, 10**9])
def test_bitmaps_find_every_run_of_words(most_cuts):
    rng = np.random.default_rng(5)
    places = rng.integers(-1, 6, 3000).astype(np.int32)
    want = Counter()
    for k in (2, 3, 4):
        for i in range(len(places) - k + 1):
            if (places[i : i + k] >= 0).all():
                want[tuple(places[i : i + k].tolist())] += 1
    got = {}
    for phrases, counts in extended(Bitmaps(places), lambda a, b: np.ones(len(a), bool), 4, most_cuts):
        for p, n in zip(phrases.tolist(), counts.tolist(), strict=True):
            assert tuple(p) not in got
            got[tuple(p)] = n
    assert got == want


def test_only_asked_phrases_are_extended():
    places = np.array([0, 1, 2, -1, 0, 1, 2, 0, 1, 1], np.int32)
    asked = {(0, 1), (1, 2)}
    found = {tuple(p): n for ps, ns in extended(Bitmaps(places), lambda a, b: np.array([(x, y) in asked for x, y in zip(a, b, strict=True)], bool), 4) for p, n in zip(ps.tolist(), ns.tolist(), strict=True)}
    assert found == {(0, 1): 3, (1, 2): 2, (0, 1, 2): 2}


def test_empty_tables_other_columns_and_long_texts(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert mine_collocations(empty).columns == COLUMNS and mine_collocations(empty).count() == 0
    long = [("en", "to be or not " * 30_000, 1)]
    got = mine_collocations(spark.createDataFrame(long, "lang string, text string, phrase int"), 30, 2000, 1000).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute([x[:2] for x in long], 30, 2000)

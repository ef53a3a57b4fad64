import random

from hushlake.llm.line_dedup import drop_frequent_lines

from . import brute


def test_equals_brute_force(spark):
    rng = random.Random(3)
    lines = ["", " ", "Cookie notice", "cookie notice ", "\tCOOKIE NOTICE\r", "É", "é", "one", "two", "three " * 5, "\x0bfour\x0c"]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8))) for _ in range(200)]
    texts += [None, "", "\n\n", "unique\nlines\n", *["same text\nsame"] * 12]
    rows = [(i if i % 7 else None, t, i, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, n_lines string")
    for least, chars in ((10, 1), (3, 0), (50, 4)):
        got = drop_frequent_lines(docs, least, chars)
        assert got.columns == ["doc_id", "text", "n", "n_lines", "n_dropped", "kept_text"]
        by = {r.n: (r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()}
        assert [by[i] for i in range(len(texts))] == brute.lines_kept(texts, least, chars)


def test_empty_table(spark):
    assert drop_frequent_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_very_long_text(spark):
    docs = spark.createDataFrame([(0, "x\n" * 60_000 + "y")] + [(i, "x") for i in range(1, 10)], "doc_id long, text string")
    row = drop_frequent_lines(docs).where("doc_id = 0").first()
    assert (row.n_lines, row.n_dropped, row.kept_text) == (60_001, 60_000, "y")

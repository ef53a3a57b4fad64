import random

from pyspark.sql import functions as F

from hushlake.llm.personal_data import find_personal_data, span_list

from . import brute


def spans(spark, texts):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, `row` string")
    found = find_personal_data(rows).select("doc_id", "row", span_list(F.col("spans")).alias("s")).collect()
    return {r.doc_id: r.s for r in found}


def base_only(joined):
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in joined.split(",") if x) if k in brute.BASE]


def test_base_spans_equal_finditer(spark):
    rng = random.Random(7)
    pieces = ["a", "b.c", "@", ".", "-", " ", "+1", "+49 ", "(202) 555-0143", "4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "256.1.1.1", "1.2", "é", "😀", "\n", "%", "123", "0", "00012.3.4.5"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += [None, "", "a@b.c.@d.e", "x@a..b", "+1 (988) 555-2485 4452413226465287 6 and", "1.2.3.4.5.6.7.8", "+12 345-678-9012)"]
    got = spans(spark, texts)
    for i, t in enumerate(texts):
        assert base_only(got[i]) == brute.base_spans(t), t


def test_very_long_texts_end_soon(spark):
    texts = ["a" * 300_000, "x@" + "a." * 50_000 + "b", "1" * 300_000, "1." * 100_000, "+1 " + "(" * 200_000, "4 " * 150_000]
    got = spans(spark, texts)
    assert got[1] == f"email:0:{len(texts[1])}"
    assert len(got) == 6


def test_checksums_and_context_decide_on_further_kinds(spark):
    texts = ["pay to IBAN DE89 3704 0044 0532 0130 00 now", "pay to IBAN DE89 3704 0044 0532 0130 01 now", "call (202) 555-0143", "set (202) 555-0143"]
    texts += ["hotel (202) 555-0143 is basically gone", "call about order (202) 555-0143", "(202) 555-0143, tel."]
    got = spans(spark, texts)
    assert got == {0: "iban:12:39", 1: "", 2: "local_phone:5:19", 3: "", 4: "", 5: "", 6: "local_phone:0:14"}


def test_scores_follow_words_beside_a_span_only(spark):
    texts = ["mail write@contact.example.com", "e-mail: a@b.example", "invoice card 4111111111111111", "discard 4111111111111111"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans[0].score for r in find_personal_data(docs).collect()}
    assert got == {0: 0.8, 1: 1.0, 2: 0.9, 3: 0.9}


def test_empty_table(spark):
    assert find_personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0

import pytest
from pyspark.sql import functions as F

from hushlake.functions import labels, masking, text
from hushlake.operators.detectors import PatternDetector
from hushlake.plans.jobs import mask_texts, mask_texts_with


@pytest.mark.parametrize(
    "value,expected",
    [
        ("Перезвоните по +7 912 345 67 89", True),
        ("Ответ жду на petrov@example.org", True),
        ("Документ 4510 654321", True),
        ("Оплата с 5469 1234 5678 9012", True),
        ("Вечером обещали дождь", False),
        (None, False),
    ],
)
def test_screen(spark, value, expected):
    assert spark.createDataFrame([(value,)], "t string").select(text.may_hold_personal_data(F.col("t"))).first()[0] is expected


@pytest.mark.parametrize("aggressiveness,expected", [(0.1, "+79161234567 10.0.0.1"), (0.3, "+79161234567 <IP_ADDRESS>"), (0.31, "<PHONE> <IP_ADDRESS>"), (7, "<PHONE> <IP_ADDRESS>")])
def test_gates(spark, aggressiveness, expected):
    df = spark.createDataFrame([("+79161234567 10.0.0.1",)], "text string")
    assert mask_texts(df, PatternDetector(0.8), aggressiveness=aggressiveness).first().masked == expected


def test_policies(spark):
    df = spark.createDataFrame([(1, "А123ВС77 и a@b.ru"), (2, None), (3, "нет")], "id long, text string")
    named = {r.id: r.masked for r in mask_texts(df, policy=masking.by_type({"EMAIL": "<@>"})).collect()}
    assert named == {1: "<СКРЫТО> и <@>", 2: None, 3: "нет"}
    made = [mask_texts(df, policy=masking.pseudonym(3), key="id").where("id = 1").first().masked for _ in range(2)]
    assert made[0] == made[1] != df.first().text
    again = PatternDetector().detect(spark.createDataFrame([(made[0],)], "text string")).first().spans
    assert [s.type for s in again] == ["CAR_NUMBER", "EMAIL"]


def test_extent_hides_all_digits(spark):
    df = spark.createDataFrame([("card 4785380592391139.",)], "text string")
    assert mask_texts(df).first().masked == "card 47<PHONE>139."
    assert mask_texts(df, PatternDetector(keep_extent=True)).first().masked == "card <PHONE>."


def test_report(spark):
    found = PatternDetector().detect(spark.createDataFrame([("x 10.0.0.1",)], "text string"))
    r = found.select(masking.report(F.col("spans"), 0.05).alias("r")).first().r[0]
    assert (r.length, r.will_anonymize) == (8, False)


def test_normalising_and_labels(spark):
    df = spark.createDataFrame([(" a \n b!!!!  c,,", "B-per")], "t string, l string")
    row = df.select(text.normalise(F.col("t")).alias("n"), labels.bert(F.col("l")).alias("b"), labels.natasha(F.col("l")).alias("n2"), labels.deeppavlov(F.lit("date")).alias("d")).first()
    assert tuple(row) == ("a b!! c,", "PERSON", None, "BIRTHDAY")
    row = df.select(labels.spacy(F.lit("GPE")).alias("a"), labels.spacy(F.lit("gpe")).alias("b"), labels.spacy(F.lit("WORK")).alias("c"), labels.bert(F.lit("I-B-CITY")).alias("d")).first()
    assert tuple(row) == ("LOCATION", None, "POSITION", "LOCATION")
    place = df.select(text.first_place(F.lit("x ИВАН, Иван"), F.lit("Иван"), F.lit(0), F.lit(4)).alias("p")).first().p
    assert tuple(place) == (2, 6)


def test_hints(spark):
    h = spark.createDataFrame([("меня зовут Анна работаю ООО Рога живу город Омск",)], "t string").select(text.hints(F.col("t")).alias("h")).first().h
    assert [x.word for x in h if x.name] == ["Анна", "ООО"] and "Рога" in [x.word for x in h if x.organisation]
    assert [x.word for x in h if x.place] == ["город", "Омск"]


def test_a_user_s_function_replaces_spans(spark):
    df = spark.createDataFrame([(1, "a@b.ru и 10.0.0.1", "x"), (2, None, "x"), (3, "нет", "x")], "id long, text string, masked string")
    got = {r.id: r.masked for r in mask_texts_with(df, lambda type_, text: f"[{type_[0]}{len(text)}]").collect()}
    assert got == {1: "[E6] и [I8]", 2: None, 3: "нет"}


def test_places_of_values(spark):
    df = spark.createDataFrame([("Анна  Ким, Анна Ким",)], "t string")
    place = lambda v, hint=0: (lambda p: p and tuple(p))(df.select(text.place_of(F.col("t"), F.lit(v), hint).alias("p")).first().p)
    assert place("Ким") == (6, 9) and place("Ким", 7) == (16, 19) and place(" Ким,  Анна ") is None and place("нет") is None and place("\nАнна Ким ") == (11, 19)

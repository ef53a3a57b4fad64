import random
import re

import pytest
from pyspark.sql import functions as F

from hushlake.functions import spans
from hushlake.functions.patterns import AFTER_NAMES, CATALOGUE, FULL_NAME, PRIORITY
from hushlake.operators.detectors import (
    REGISTRY, ModelDetector, PatternDetector, RecogniserDetector, RulesAndModelDetector, StagedDetector, TaggerDetector, TokenRuleDetector, blank_model, register,
)

TEXTS = [
    "Звоните по +7 912 345 67 89, 8(912)345-67-89 и 89123456789",
    "Пишите: email: petrov@example.org или x.y@mail.ru!",
    "ПАСПОРТ: 40 04 123456, ещё 4004 123456",
    "СНИЛС 123-456-789 12, инн: 7707083893, 770708389312",
    "карта 4276 4000 1234 5678 и 4276 **** **** 5678",
    "родился 01.02.1985, 3/4/1990, 5 Мая 2001, родилаь 01.02.1985",
    "😀 10.0.0.1 https://a.ru/x www.b.ru",
    "Иванов И.О. и Пётр Сидоров, авто А123ВС77, мне 25 лет",
    "ё123 лет 12 лет и 30 лет",
    "4785380592391139", "", "ничего",
]


def matches(text):
    """All candidates by Python's own regular expressions."""
    out = []
    for p in CATALOGUE:
        flags = re.IGNORECASE if p.ignore_case else 0
        out += [(m.start(), m.end(), p.order, PRIORITY[p.type], p.type, m[0]) for m in re.finditer(p.regex, text, flags)]
    before = [c for c in out if c[4] not in AFTER_NAMES]
    for m in re.finditer(FULL_NAME.regex, text):
        if not any(m.start() < e and s < m.end() for s, e, *_ in before):
            out.append((m.start(), m.end(), FULL_NAME.order, PRIORITY["PERSON"], "PERSON", m[0]))
    return out


def resolved(candidates):
    """Every candidate against every kept span."""
    kept = []
    for c in sorted(candidates):
        for i, k in enumerate(kept):
            if c[0] < k[1] and k[0] < c[1]:
                if c[3] > k[3]:
                    kept[i] = c
                break
        else:
            kept.append(c)
    return [(s, e, t, x) for s, e, _, _, t, x in kept]


def test_patterns_equal_python(spark):
    rng = random.Random(1)
    pieces = [w for t in TEXTS for w in re.findall(r"\S+|\s+", t)]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(30)) for _ in range(150)]
    got = PatternDetector().detect(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    for r in got:
        assert [(s.start, s.end, s.type, s.text) for s in r.spans] == resolved(matches(r.text)), r.text
        assert all(r.text[s.start : s.end] == s.text for s in r.spans)


def test_nulls_empty_texts_and_aggressiveness(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Пётр Сидоров")], "id long, text string")
    assert {r.id: r.spans for r in PatternDetector(0.6).detect(df).collect()} == {1: None, 2: [], 3: []}
    assert len(PatternDetector(0.61).detect(df).where("id = 3").first().spans) == 1


CANDIDATES = [
    ("replace", [(0, 16, 8), (2, 13, 10)], [(2, 13)], [(0, 16)], [(0, 16)]),
    ("equal keeps first", [(0, 5, 3), (3, 9, 3)], [(0, 5)], [(0, 5)], [(0, 9)]),
    ("touching", [(0, 5, 3), (5, 9, 3)], [(0, 5), (5, 9)], [(0, 5), (5, 9)], [(0, 5), (5, 9)]),
    ("same start", [(0, 5, 3), (0, 9, 3)], [(0, 5)], [(0, 9)], [(0, 9)]),
]


@pytest.mark.parametrize("name,candidates,priority,longest,extent", CANDIDATES)
def test_resolution(spark, name, candidates, priority, longest, extent):
    rows = [[(s, e, n, p, "T", "") for n, (s, e, p) in enumerate(candidates)]]
    df = spark.createDataFrame([(rows[0],)], f"c array<{spans.CANDIDATE}>")
    row = df.select(spans.resolve_by_priority(F.col("c")).alias("p"), spans.resolve_by_length(F.col("c")).alias("l"), spans.union_of_overlaps(F.col("c")).alias("u")).first()
    places = lambda x: [(s.start, s.end) for s in x]
    assert (places(row.p), places(row.l), places(row.u)) == (priority, longest, extent)


def test_recognisers_and_token_rules(spark):
    df = spark.createDataFrame([("Меня зовут Иван Петров, 8-916-123-45-67, a@b.ru, тел: 123, студент МГУ",)], "text string")
    got = RecogniserDetector().detect(df).first().spans
    assert [(s.type, s.text, s.score) for s in got] == [("PERSON", "Иван Петров", 0.85), ("PHONE_NUMBER", "8-916-123-45-67", 0.9), ("EMAIL_ADDRESS", "a@b.ru", 0.95)]
    assert [(s.type, s.text) for s in TokenRuleDetector().detect(df).first().spans] == [("PHONE", "тел: 123"), ("EDUCATION", "студент МГУ")]


def test_models_and_stages(spark):
    def make(label, word, score=0.9):
        def load():
            def predict(texts):
                if "fail" in texts[0]:
                    raise RuntimeError
                return [[{"start": t.index(word), "end": t.index(word) + len(word), "label": label, "score": score} for _ in range(word in t)] for t in texts]

            return predict

        return load

    df = spark.createDataFrame([(1, "Анна  Ким, Омск"), (2, "fail Анна"), (3, None)], "id long, text string")
    united = ModelDetector([make("B-PER", "Анна"), make("PER", "Анна  Ким"), make("CITY", "Омск", 0.5), make("X", "Омск")])
    got = {r.id: r.spans and [(s.type, s.text) for s in r.spans] for r in united.detect(df).collect()}
    assert got == {1: [("PERSON", "Анна  Ким")], 2: [], 3: None}
    staged = StagedDetector([(make("PER", "Анна"), True), (make("LOC", "Омск"), False)])
    got = {r.id: r.spans and [(s.type, s.start) for s in r.spans] for r in staged.detect(df).collect()}
    assert got == {1: [("PERSON", 0), ("LOCATION", 11)], 2: [], 3: None}


BIO = [
    ("Иван Петров живёт", ["Иван", "Петров", "живёт"], ["B-PER", "I-PER", "O"], ["Иван Петров"]),
    ("а б", ["а", "б"], ["I-PER", "B-LOC"], ["б"]),
    ("а б в", ["а", "б", "в"], ["B-PER", "I-LOC", "I-PER"], ["а б в"]),
    ("а б в", ["а", "б", "в"], ["B-PER", "B-XXX", "I-PER"], ["а б в"]),
    ("а а", ["а", "а"], ["B-PER", "B-PER"], ["а", "а"]),
    ("а", ["нет", "а"], ["B-PER", "B-LOC"], ["а"]),
]


@pytest.mark.parametrize("text,tokens,tags,want", BIO)
def test_bio(spark, text, tokens, tags, want):
    detector = TaggerDetector([lambda: lambda texts: ([tokens], [tags])])
    got = detector.detect(spark.createDataFrame([(text,)], "text string")).first().spans
    assert [s.text for s in got] == want


def test_models_are_asked_in_batches_and_errors_are_kept(spark):
    def make():
        def model(texts):
            if any("fail" in t for t in texts):
                raise RuntimeError("bad text")
            return [[{"start": 0, "end": 1, "label": "PER", "text": str(len(texts))}] for _ in texts]

        return model

    df = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "id long, text string").coalesce(1)
    assert {r.spans[0].text for r in ModelDetector([make]).detect(df).collect()} == {"40"}
    mixed = df.unionByName(spark.createDataFrame([(99, "fail"), (100, None)], "id long, text string")).coalesce(1)
    got = {r.id: r for r in ModelDetector([make, make]).detect(mixed, error="why").collect()}
    assert got[99].spans == [] and got[99].why == "RuntimeError: bad text; RuntimeError: bad text" and got[100].spans is None
    assert all(got[i].why is None and len(got[i].spans) == 1 for i in range(40))

    def broken():
        raise OSError("no such model")

    assert {len(r.spans) for r in ModelDetector([broken], fallback=blank_model).detect(df).collect()} == {0}
    both = RulesAndModelDetector(make).detect(spark.createDataFrame([("я студент МФТИ",)], "text string")).first().spans
    assert [s.type for s in both] == ["PERSON", "EDUCATION"]
    only_rules = RulesAndModelDetector(broken).detect(spark.createDataFrame([("я студент МФТИ",)], "text string")).first().spans
    assert [s.type for s in only_rules] == ["EDUCATION"]


def test_columns_of_any_name_stay(spark):
    names = ["row", "t", "before", "names", "after", "every", "has_digits", "model0", "stage0", "normal", "tags0", "_all", "found"]
    df = spark.createDataFrame([("10.0.0.1", "old", *names)], "text string, spans string, " + ", ".join(f"`{n}` string" for n in names))
    make = lambda: lambda texts: [[] for _ in texts]
    tagger = lambda: lambda texts: ([[] for _ in texts], [[] for _ in texts])
    for d in (PatternDetector(), RecogniserDetector(), TokenRuleDetector(), ModelDetector([make]), StagedDetector([(make, True)]), TaggerDetector([tagger])):
        row = d.detect(df).first()
        assert [row[n] for n in names] == names and isinstance(row.spans, list)


def test_own_recognisers(spark):
    got = RecogniserDetector(recognisers=[("CODE", 0.5, [r"[A-Z]{2}-\d+"]), ("PHONE_NUMBER", 0.9, [r"\d{3}"])]).detect(spark.createDataFrame([("AB-12, 345",)], "text string")).first().spans
    assert [(s.type, s.text, s.score) for s in got] == [("CODE", "AB-12", 0.5), ("PHONE_NUMBER", "345", 0.9)]


def test_registry_and_several_taggers(spark):
    register("mine", lambda: PatternDetector(types=["URL"], name="mine"))
    assert REGISTRY["mine"]().name == "mine" and {"regexp", "recognisers", "spacy_rules"} <= set(REGISTRY)
    tag = lambda tags: lambda: lambda texts: ([t.split() for t in texts], [tags for _ in texts])
    both = TaggerDetector([tag(["B-PER", "O"]), tag(["O", "B-LOC"])])
    got = both.detect(spark.createDataFrame([("Иван Омск",), (None,)], "text string")).collect()
    assert [(s.type, s.text) for s in got[0].spans] == [("PERSON", "Иван"), ("LOCATION", "Омск")] and got[1].spans is None

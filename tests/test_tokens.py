import random

import pytest
import regex
from pyspark.sql import functions as F

from hushlake.functions import spans, tokens
from hushlake.functions.patterns import CATALOGUE, GUARDS, NUMERALS, RECOGNISERS, TOKEN_RULES, Pattern
from hushlake.operators.detectors import TokenRuleDetector

WORD = r"[\p{L}\p{M}\p{N}_]"


def cut(text):
    """Tokens one at a time from the left."""
    out, at = [], 0
    while at < len(text):
        m = regex.compile(r"\p{Nd}+(?:[.,/]\p{Nd}+)+").match(text, at) or regex.compile(f"{WORD}+(?:['’]{WORD}+)*").match(text, at)
        end = m.end() if m else at + 1
        if m or not regex.match(r"[ \t\n\x0b\f\r]|\p{Z}", text[at]):
            out.append((at, end))
        at = end
    return out


def fits(element, token):
    kind, values = element
    return {
        "lower": lambda: token.lower() in values, "text": lambda: token in values, "letters": lambda: bool(regex.fullmatch(r"\p{L}+", token)),
        "number": lambda: bool(regex.fullmatch(r"\p{Nd}+(?:[.,]\p{Nd}+)*(?:/\p{Nd}+)?", token)) or token.lower() in NUMERALS,
    }[kind]()


def brute(text, rules):
    """Every rule at every token; then the leftmost, longest, first of them."""
    found, places = [], cut(text)
    for n, (type_, row) in enumerate(rules):
        for i in range(len(places) - len(row) + 1):
            if all(fits(e, text[slice(*places[i + k])]) for k, e in enumerate(row)):
                s, e = places[i][0], places[i + len(row) - 1][1]
                found.append((s, -e, n, type_))
    kept, at = [], 0
    for s, minus, _, type_ in sorted(found):
        if s >= at:
            kept.append((s, -minus, type_, text[s:-minus]))
            at = -minus
    return kept


PIECES = [
    "25", "1,5", "10/12", "7-8", "лет", "Лет", "мне", "МНЕ", "возраст", ":", "тел", "тел.", "+", "+7", "5лет", "студент", "МГТУ2", "МГТУ-2", "выпускник", "окончил", "«вуз»", "(", ")", "работаю", "живу", "в", "на", "даче",
    "адрес", "улица", "Ново-Садовая", "двадцать", "d'Arc", "’", "_", "😀", "é", "...", "a", "12.5.", "½", "٣",
]
GAPS = ["", " ", " ", " ", "  ", "\n", "\t", " ", " ", "\r\n"]


def sentences(n, seed, pieces=PIECES):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) + rng.choice(GAPS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_token_rules_equal_a_plain_matcher(spark):
    latin = [p for p in PIECES if not regex.search(r"\p{Cyrillic}", p)]
    texts = [*sentences(2500, 1), *sentences(500, 2, latin), "+ 7\x01+ 8 +9", "мне 2\x01 лет, +5", "", "Мой тел.: 12, а тел: 34", "Мне двадцать лет " * 3000]
    got = TokenRuleDetector().detect(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect()
    assert sum(len(r.spans) for r in got) > 1000
    for r in got:
        assert [(s.start, s.end, s.type, s.text) for s in r.spans] == brute(r.text, TOKEN_RULES), r.text


def test_only_words_around_anchors_are_read(spark):
    rng = random.Random(7)
    # Words of no token, runs of other words of every length between anchors, and stretches that meet.
    pieces = ["word", "Latin", "x1", ":", "25", "лет", "мне", "студент", "тел", "+", "адрес", "\u00a0", "\u2003", "-", "a:b"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", " ", "\u00a0", "\n", "  "]) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [f"{a} {w * n}{b} MIT x" for n in range(8) for w in ("w ", "longer:words ", "seventeen-letters ") for a in ("студент", "+", "5") for b in ("лет", "+ 5", "студент")]
    texts += ["plain words only " * 2000 + "мне 25 лет", "студент \u00a0 \u2003 MIT", "студент" + " " * 5000 + "MIT", "лет " * 20000, "w" * 100000 + " 5 лет"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    for r in TokenRuleDetector().detect(df).collect():
        assert [(s.start, s.end, s.type, s.text) for s in r.spans] == brute(r.text, TOKEN_RULES), r.text
    long = df.where("text LIKE 'plain%'").select(tokens.windows(F.col("text"), TOKEN_RULES).alias("w")).first().w
    assert long.text == "words only мне 25 лет" and len(long.shifts) == 1
    assert tokens.anchors([*TOKEN_RULES, ("X", [("letters", [])])]) == ""


def test_more_rules_than_one_number_has_bits(spark):
    rules = [(f"T{k}", [("lower", [w]), ("letters", []), ("number", [])]) for k, w in enumerate("abcdefghijklmnopqrstuvwxyz")] + [("ONE", [("number", [])])]
    assert len(tokens._groups(rules)) == 2
    texts = sentences(400, 3, ["a", "B", "z", "w", "12", "x1", "мы", "-", "q"])
    for r in TokenRuleDetector(rules).detect(spark.createDataFrame(list(enumerate(texts)), "id long, text string")).collect():
        assert [(s.start, s.end, s.type, s.text) for s in r.spans] == brute(r.text, rules), r.text


def test_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "мне 2 лет")], "id long, text string")
    assert {r.id: r.spans and len(r.spans) for r in TokenRuleDetector().detect(df).collect()} == {1: None, 2: [], 3: 1}


def test_what_a_rule_needs():
    assert {tokens.needs(r) for r in TOKEN_RULES} == {"cyrillic", "window"} and tokens.needs(("X", [("lower", ["abc"])])) == ""


HARD = [
    "+7", "8", "(912)", "912", "345", "67", "89", "-", "--", "(", ")", "+", "*", "****", "4276", "email:", "Email:", "xemail:", "e:email:", "a@b.ru", "x.y@mail.example,", "www.a.b", "www.", "http://a", "https://", "10.0.0.1", "1.2.2001",
    "3/4/1990", "word", "end.", "e.g.", "a..b", "...", "Дом", "é2", "٣٤", "\x02", "#", "12-34-56", "123-456-789", "12", "40 04 123456", "7707083893", "d.", ":", "·", "89123456789",
]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_hold_every_match(spark, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(HARD) + rng.choice(GAPS) for _ in range(rng.randint(0, 25))) for _ in range(700)]
    texts += ["8\x01 912 345 67 89", "a@b.ru\x01www.x", "\x01", "no such thing here. Nor there.", "x " * 5000 + "a@b.ru and +7 (912) 345-67-89" + " y." * 5000]
    plain = [*CATALOGUE, *[Pattern(t, r, False, 0) for t, _, rs in RECOGNISERS for r in rs]]
    chosen = [p for p in plain if p.guard and p.guard != "cyrillic"]
    assert len(chosen) > 20 and set(GUARDS) - {p.guard for p in chosen} == {"cyrillic"}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumn("w", spans.windows(F.col("t")))
    some = df.select("t", *[spans.find(F.col("t"), p.java, p.type).alias(f"whole{k}") for k, p in enumerate(chosen)], *[spans.find_in(F.col("w"), p.java, p.type).alias(f"cut{k}") for k, p in enumerate(chosen)])
    hits = 0
    for r in some.collect():
        for k, p in enumerate(chosen):
            hits += len(r[f"whole{k}"])
            assert r[f"cut{k}"] == r[f"whole{k}"], (r.t, p.regex)
    assert hits > 1000
    assert df.where("t LIKE 'no such%'").first().w.text == "" and spark.createDataFrame([(None,)], "t string").select(spans.windows(F.col("t")).alias("w")).first().w is None

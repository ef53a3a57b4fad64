import math
import random
from collections import Counter

from pyspark.sql import functions as F

from hushlake.llm import quality
from hushlake.llm.quality import OUTPUT, js_distance, judge_quality, language_references

from . import brute

COMMON = ["the", "of", "and", "to", "in", "is"]


def prose(rng, n=150):
    return " ".join(rng.choice(COMMON) if rng.random() < 0.5 else "".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_counts_equal_brute_force(spark):
    rng = random.Random(11)
    parts = ["a", "b", "c", " ", "  ", "\n", "\t", "\x0b", "#", "$%", "é", "😀", " the cat sat", "A B C"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 160))) for _ in range(400)]
    texts += [None, "", " ", "\n", "x y z " * 5000, "one two", "one two three"]
    docs = spark.createDataFrame([(i, t, None if i % 5 else "en", "clash") for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept string")
    for r in judge_quality(docs).collect():
        want = brute.base_counts(texts[r.doc_id])
        assert {k: r[k] for k in want} == want, texts[r.doc_id]


def test_distance_equals_formula(spark):
    p, q = [0.5, 0.5, 0.0], [0.1, 0.4, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    want = math.sqrt(sum(0.5 * a * math.log2(a / c) for a, c in zip(p, m, strict=True) if a) + sum(0.5 * b * math.log2(b / c) for b, c in zip(q, m, strict=True) if b))
    row = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(js_distance(F.col("p"), F.col("q")).alias("d")).first()
    assert abs(row.d - want) < 1e-12


def test_divergent_texts_go_and_clean_ones_stay(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng), "en") for i in range(300)]
    rows.append((1000, " ".join(w + "$%#" for w in prose(rng).split()), "en"))
    rows.append((1001, " ".join("".join(rng.choice("klmnop") for _ in range(6)) for _ in range(200)), "en"))
    got = {r.doc_id: r.kept for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(300))
    assert not got[1000] and not got[1001]


def test_empty_table(spark):
    empty = judge_quality(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert empty.count() == 0 and empty.columns[3:] == OUTPUT


def fifth(rng, common, letters, n=200):
    """Prose of which common words, the first ones more often, make up about 20 %."""
    weights = [1 / (k + 1) for k in range(len(common))]
    return " ".join(rng.choices(common, weights)[0] if rng.random() < 0.2 else "".join(rng.choice(letters) for _ in range(7)) + rng.choice(["", "", " |"]) for _ in range(n))


def test_texts_without_their_language_s_words_go_at_a_fifth_coverage(spark):
    rng = random.Random(5)
    words = {"en": "the of and to in is that it for was on with as be by are at this".split(), "de": "der die und den von zu das sich mit auf des ist im dem nicht ein".split()}
    rows = [(i, fifth(rng, words[lang], "abcdefghij"), lang) for i, lang in enumerate(["en", "de"] * 150)]
    rows += [(1000 + i, fifth(rng, words["de"], "abcdefghij"), "en") for i in range(5)]
    rows += [(2000 + i, fifth(rng, ["abcabca"], "abcdefghij"), "de") for i in range(5)]
    rows += [(3000, fifth(rng, words["de"], "abcdefghij"), None), (3001, rows[0][1], None)]
    got = {r.doc_id: r.kept for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] for i in range(300)) and got[3000] and got[3001]
    assert not any(kept for i, kept in got.items() if 1000 <= i < 3000)


def test_long_words_and_capitals_count_as_common(spark):
    rng = random.Random(9)
    words = ["internationalisation", "notwithstanding", "counterrevolutionary"]
    text = lambda w: " ".join(rng.choice(w) if rng.random() < 0.4 else "".join(rng.choice("abcdef") for _ in range(7)) for _ in range(200))
    rows = [(i, text(words), "xx") for i in range(60)] + [(100, text([w.upper() for w in words]), "xx"), (101, text(["abcabc"]), "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    common = [r.common for r in language_references(docs).where("language = 'xx'").collect()][0]
    assert set(words) <= set(common[:3])
    got = {r.doc_id: r for r in judge_quality(docs, max_class_distance=1.0).collect()}
    assert got[100].kept and got[100].word_distance < 0.3 and not got[101].kept


def test_languages_without_enough_text_have_no_reference(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng), "en") for i in range(100)] + [(200, " ".join(w + "$%#" for w in prose(rng).split()), "rare"), (201, prose(rng), None), (202, prose(rng, 20), "rare")]
    got = {r.doc_id: r for r in judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got[200].kept and got[200].class_distance is None and got[200].word_distance is None
    assert got[201].kept and got[201].word_distance is not None and not got[202].kept


def test_words_that_share_a_slot_are_looked_up(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, prose(rng), "en") for i in range(40)] + [(100, prose(rng).upper(), "en"), (101, "A b C a B c " * 30 + prose(rng), "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # The lists of words are read back with their slots: every listed word has one, and with one slot all words are looked up.
    limits = quality._with_limits(language_references(docs)).where("language = 'en'")
    first = limits.select("common", "slots", F.transform("common", lambda w: F.get("slots", quality._slot(F.xxhash64(w)))).alias("own")).first()
    assert all(first.own) and len(first.slots) == quality.N_SLOTS and sum(first.slots) <= len(first.common) < quality.N_SLOTS / 10
    want = sorted(judge_quality(docs).collect())
    monkeypatch.setattr(quality, "N_SLOTS", 1)
    assert sorted(judge_quality(docs).collect()) == want


def test_texts_are_put_in_lower_case_once_and_as_a_whole(spark):
    rng = random.Random(6)
    words = ["ΟΔΟΣ", "οδος", "Σ", "ΑΣ.", "İstanbul", "ÉTÉ", "The", "tHe", "the", "áΣ", "Σ́", "😀", "ǅ"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\t", "\x0b", "\x0c", "\r", "  "]) for _ in range(300)) for _ in range(10)]
    texts += [" ".join(rng.choice(words) for _ in range(300)), None, "", "\t", "\x0b \n"]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    count = Counter(w.lower() for t in texts for w in brute.WORD.findall(t or ""))
    reference = language_references(docs).where("language = 'xx'").first()
    assert {w: round(s, 9) for w, s in zip(reference.common, reference.word_shares, strict=False)} == {w: round(n / count.total(), 9) for w, n in count.items()}
    judged = judge_quality(docs)
    for r in judged.collect():
        want = brute.base_counts(texts[r.doc_id])
        assert {k: r[k] for k in want} == want and (r.word_distance is None) is (r.n_words < 100)
    # A mapping for each word, or a text's length for each class or place, would be work for each element.
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and "lower(lambda" not in plan

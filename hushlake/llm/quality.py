r"""Operator 4: quality rules, with the divergence of a document from its language.

Counted rules come first: too few words, or too many words in three-word windows that the text
repeats. A document that passes them is compared with its language: the histogram of its character
classes, and of its language's most common words (in any case), against the language's own over the whole corpus, by the
Jensen-Shannon distance (base 2, between 0 and 1). A comparison counts only for texts that are long enough for it.
DataFrame functions only.

References come from all documents, in one pass: each text gives its words and one entry of its class counts, which meet
pre-aggregated. Every language whose documents hold ``MIN_REFERENCE_WORDS`` words has a reference; a shorter one could not be
told from chance, so texts of other languages have no distances and are judged by the counted rules alone. Texts without a
language are compared with the whole corpus. References are a written table of one small row for each language: Spark
broadcasts it under its threshold and joins by language beyond.

A text with none of its language's common words is only as far from it as these cover the language. So a language's own
limit is a share of that distance, over the listed words that hold a letter, and ``max_word_distance`` holds besides. It counts for
texts in which the language lets ``MIN_EXPECTED`` such words be expected, but not for texts without a language.

A text is put in lower case as a whole, before it is split: white space ends every context that the mapping of a letter looks at, so the words are
those of the text, each in lower case.

Repeated windows are found without comparing all pairs: equal windows have equal hashes (of words in lower case), and only where a text's hashes
repeat, they are sorted with their positions and the windows of equal ones are compared as text. By the same hashes most words that are not
listed are told from listed ones without looking them up, and most listed ones are compared with one word of the list.

Defined results: a null or empty text has no words and fails; every row is judged on
its own, so equal rows have equal results; an empty table stays empty; input columns that bear an
output's name are replaced, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import fenced, names_without, written
from .text import SPACE

OUTPUT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "kept"]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Characters that are in no class: most letters, and common white space. The other white space is in no class either, but few texts hold it.
COMMON_CLASS, RARE_SPACE = r"[a-z\x20\n]+", r"[\x09\x0B-\x0D]"
#: Character classes besides letters that are not capitals, which are the rest.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "punctuation": r"\p{P}", "symbol": r"\p{S}"}
SYMBOLS = "#*$%&|<>"
#: Words in a language's histogram, and words that a language must have for a reference.
N_COMMON, MIN_REFERENCE_WORDS = 40, 2000
#: Shortest texts that are compared, and the distances up to which they are kept.
MIN_CLASS_CHARS, MIN_COMMON_WORDS = 200, 100
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.45
#: A language's limit as a share of the distance of a text without its common words, and how many of them a text must let expect.
LACKING_SHARE, MIN_EXPECTED = 0.9, 15
COUNTED = [*CLASSES, "n_space", "rest"]
#: One character for each place in a language's list of words, and the start of an entry of class counts, which no word has.
PLACES = "".join(chr(0x30 + i) for i in range(N_COMMON))
#: Slots by hash, a power of two: a word whose slot no listed word has is not listed.
N_SLOTS = 2048
ENTRY = "\n"


def spaced(text: Column) -> Column:
    """A text with a space for each character of white space."""
    for c in SPACE[1:]:
        text = F.replace(text, F.lit(c), F.lit(SPACE[0]))
    return text


def spaced_by_few(text: Column) -> Column:
    """``spaced`` for a frame with the text's ``uncommon`` characters in ``few``: each replacement reads the whole text."""
    return F.when(F.regexp_like("few", F.lit(RARE_SPACE)), spaced(text)).otherwise(F.replace(text, F.lit("\n"), F.lit(SPACE[0])))


def split_words(text: Column) -> Column:
    """The words of a text that is not null."""
    return F.array_remove(F.split(spaced(text), SPACE[0], -1), "")


def count_class(text: Column, members: str) -> Column:
    """How many characters of a text are in a class of a regular expression."""
    return F.length(F.regexp_replace(text, f"[^{members}]+", ""))


def uncommon(text: Column) -> Column:
    """A text without the characters of COMMON_CLASS: all of CLASSES and SYMBOLS are left."""
    return F.regexp_replace(text, COMMON_CLASS, "")


def with_class_counts(frame: DataFrame) -> DataFrame:
    """Adds a count for each class of CLASSES (in the text's ``few`` characters) and the rest to a frame with ``few``, ``n_chars`` and ``n_space``."""
    named = frame.select("*", *[count_class(F.col("few"), c).alias(name) for name, c in CLASSES.items()])
    rest = F.col("n_chars") - F.col("n_space")
    for name in CLASSES:
        rest = rest - F.col(name)
    return named.withColumn("rest", rest)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of probabilities."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    def both(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return (part(x, m) + part(y, m)) / 2

    total = F.aggregate(F.zip_with(p, q, both), F.lit(0.0), lambda acc, x: acc + x)
    return F.sqrt(F.greatest(total, F.lit(0.0)))


def shares(counts: Column, total: Column) -> Column:
    """Counts as shares of their sum, which is given: in a lambda it would be added up for each element. All zero if it is zero."""
    return F.transform(counts, lambda c: F.coalesce(F.try_divide(c.cast("double"), total.cast("double")), F.lit(0.0)))


def language_references(docs: DataFrame) -> DataFrame:
    """A row for each language that has enough words, and one of the whole corpus with a null language: language, common, word_shares, class_shares."""
    t = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(F.col("lang").alias("language"), t.alias("t"), F.length(t).alias("n_chars"), uncommon(t).alias("few"))
    pieces = texts.withColumn("pieces", F.split(F.lower(spaced_by_few(F.col("t"))), SPACE[0], -1)).withColumn("n_space", F.size("pieces") - 1)
    counted = with_class_counts(pieces)
    entry = F.concat(F.lit(ENTRY), F.concat_ws(",", *[F.col(c).cast("string") for c in COUNTED]))
    words = counted.select("language", F.explode(F.concat("pieces", F.array(entry))).alias("word")).where("word <> ''")
    folded = written(words.groupBy("language", "word").agg(F.count(F.lit(1)).alias("n")), "quality-words")
    is_entry = F.startswith("word", F.lit(ENTRY))
    entries = folded.where(is_entry).select("language", "n", F.split(F.substring("word", len(ENTRY) + 1, 1000), ",").alias("c"))
    n_classes = len(COUNTED)
    sums = entries.groupBy("language").agg(*[F.sum(F.get("c", i).cast("long") * F.col("n")).alias(f"c{i}") for i in range(n_classes)])
    classes = written(sums, "quality-classes").select("language", F.array(*[F.col(f"c{i}") for i in range(n_classes)]).alias("classes"))
    words = folded.where(~is_entry)
    totals = words.groupBy("language").agg(F.sum("n").alias("total"))

    pooled = words.groupBy("word").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("language").orderBy(F.desc("n"), "word")
    both = words.where("language IS NOT NULL").select("language", "word", "n").unionByName(pooled.select(F.lit(None).cast("string").alias("language"), "word", "n"))
    top = both.withColumn("place", F.row_number().over(best)).where(F.col("place") <= N_COMMON)
    listed = top.groupBy("language").agg(F.array_sort(F.collect_list(F.struct("place", "word", "n"))).alias("top"))
    of_all = totals.agg(F.sum("total").alias("total")).select(F.lit(None).cast("string").alias("language"), "total")
    enough = totals.where(F.col("language").isNotNull() & (F.col("total") >= MIN_REFERENCE_WORDS)).unionByName(of_all)
    every = [F.coalesce(F.sum(F.get("classes", i)), F.lit(0)).alias(f"c{i}") for i in range(n_classes)]
    of_all = classes.agg(*every).select(F.lit(None).cast("string").alias("language"), F.array(*[F.col(f"c{i}") for i in range(n_classes)]).alias("classes"))
    with_classes = classes.where("language IS NOT NULL").unionByName(of_all)
    word_counts = F.concat(F.col("top.n"), F.array(F.col("total") - F.aggregate("top.n", F.lit(0).cast("long"), lambda a, n: a + n)))
    key = F.col("e.language")
    joined = enough.alias("e").join(with_classes.alias("c"), key.eqNullSafe(F.col("c.language"))).join(listed.alias("l"), key.eqNullSafe(F.col("l.language")), "left")
    joined = joined.withColumn("chars", F.aggregate("classes", F.lit(0).cast("long"), lambda a, c: a + c))
    return joined.select(
        key.alias("language"),
        F.coalesce(F.col("top.word"), F.array().cast("array<string>")).alias("common"),
        F.coalesce(shares(word_counts, F.col("total")), F.array(F.lit(0.0))).alias("word_shares"),
        shares(F.col("classes"), F.col("chars")).alias("class_shares"),
    )


def _slot(hash_: Column) -> Column:
    return hash_.bitwiseAND(F.lit(N_SLOTS - 1).cast("long")).cast("int")


def _with_limits(references: DataFrame) -> DataFrame:
    """Adds the places of the listed words that hold a letter, their shares with the rest's, the language's limit (null: none), which slots listed words have, and the place of the only one in a slot (null: none or several)."""
    places = F.filter(F.transform("common", lambda w, i: F.when(F.regexp_like(w, F.lit(r"\p{L}")), i)), lambda i: i.isNotNull())
    of_words = F.transform("places", lambda i: F.get("word_shares", i))
    covered = F.aggregate("of_words", F.lit(0.0), lambda a, x: a + x)
    with_shares = references.withColumn("places", places).withColumn("of_words", of_words).withColumn("covered", covered)
    none = F.concat(F.transform("of_words", lambda x: F.lit(0.0)), F.array(F.lit(1.0)))
    listed = with_shares.withColumn("letter_shares", F.concat("of_words", F.array(1 - F.col("covered"))))
    limit = F.when(F.col("language").isNotNull(), LACKING_SHARE * js_distance(none, F.col("letter_shares")))
    own = listed.withColumn("word_limit", limit).withColumn("own", F.transform("common", lambda w: _slot(F.xxhash64(w))))
    every = F.sequence(F.lit(0), F.lit(N_SLOTS - 1))
    n_own = lambda k: F.size(F.filter("own", lambda x: x == k))
    alone = F.transform(every, lambda k: F.when(n_own(k) == 1, (F.array_position("own", k) - 1).cast("tinyint")))
    return own.withColumn("slots", F.transform(every, lambda k: F.array_contains("own", k))).withColumn("alone", alone).drop("of_words", "own")


def _repeat_words(frame: DataFrame, text: Column) -> DataFrame:
    """Turns ``hashes`` into n_repeat_words: a hash for each three-word window of the text, equal where the windows are."""

    def beside(name: str, same) -> Column:
        return F.filter(name, lambda x, i: same(x, F.get(name, i - 1)) | same(x, F.get(name, i + 1)))

    # Where a hash repeats: the words, and the hashes with their positions instead of their lower 31 bits, sorted.
    high, low = F.lit(-(2**31)).cast("long"), F.lit(2**31 - 1).cast("long")
    packed = F.sort_array(F.transform("hashes", lambda h, i: h.bitwiseAND(high).bitwiseOR(i.cast("long"))))
    one = frame.withColumn("repeats", F.size(F.array_distinct("hashes")) < F.size("hashes")).select(
        *[c for c in frame.columns if c != "hashes"],
        F.when(F.col("repeats"), packed).otherwise(F.array().cast("array<long>")).alias("packed"),
        F.when(F.col("repeats"), split_words(text)).otherwise(F.array().cast("array<string>")).alias("w"),
    )
    # The last hash has none after it, whose comparison is null.
    again = F.zip_with("packed", F.slice("packed", 2, F.greatest(F.size("packed"), F.lit(1))), lambda a, b: F.shiftright(a.bitwiseXOR(b), 31) == 0)
    marked = one.withColumn("again", again)
    likely = F.transform(F.filter("packed", lambda x, i: F.get("again", i) | F.get("again", i - 1)), lambda x: x.bitwiseAND(low).cast("int"))
    window = lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))
    two = marked.withColumn("windows", F.array_sort(F.transform(likely, lambda i: F.struct(window(i).alias("text"), i.alias("i"))))).drop("packed", "again", "w")
    three = two.withColumn("starts", F.sort_array(F.transform(beside("windows", lambda a, b: a["text"] == b["text"]), lambda x: x["i"]))).drop("windows")
    steps = F.transform("starts", lambda s, k: F.least(F.lit(3), F.coalesce(F.get("starts", k + 1) - s, F.lit(3))))
    total = F.aggregate(steps, F.lit(0), lambda a, s: a + s).cast("long")
    return three.withColumn("n_repeat_words", total).drop("starts")


def judge_quality(
    docs: DataFrame,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    references: DataFrame | None = None,
) -> DataFrame:
    """``docs`` (text, lang, ...) with the counts of OUTPUT, both distances (null where a text is too short or has no reference) and ``kept``."""
    names = names_without(docs, OUTPUT)
    references = written(_with_limits(references if references is not None else language_references(docs)), "quality-references")
    compared = ["common", "word_shares", "class_shares", "places", "covered", "letter_shares", "word_limit"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("lang").alias("of"))
    known = rows.join(references, F.col("of").eqNullSafe(F.col("language")), "left")
    text = F.coalesce(F.col("row").getField("text"), F.lit(""))
    pieces = known.withColumn("few", uncommon(text)).withColumn("pieces", F.split(F.lower(spaced_by_few(text)), SPACE[0], -1))
    split = pieces.select(
        "row", *compared, "slots", "alone", "few",
        F.array_remove("pieces", "").alias("w"), (F.size("pieces") - 1).alias("n_space"), F.length(text).alias("n_chars"),
    ).withColumn("n", F.size("w"))
    # Each word is hashed once, and a window by its words' hashes.
    each = with_class_counts(split).withColumn("n_symbols", count_class(F.col("few"), SYMBOLS)).drop("few").withColumn("each", F.transform("w", lambda x: F.xxhash64(x)))
    pairs = F.zip_with("each", F.slice("each", 2, F.greatest(F.col("n"), F.lit(1))), lambda a, b: a.bitwiseXOR(F.shiftleft(b, 1)))
    triples = F.zip_with(pairs, F.slice("each", 3, F.greatest(F.col("n"), F.lit(1))), lambda a, b: a.bitwiseXOR(F.shiftleft(b, 2)))
    # A text's common words, each as the character of its place in the list. Only words whose slot some listed one has are looked up,
    # in the list only where that slot has several.
    listed = F.array(*[F.lit(c) for c in PLACES])

    def place(w: Column, h: Column) -> Column:
        only = F.get("alone", _slot(h))
        same = F.get("common", only) == w
        found = F.when(same, F.get(listed, only)).when(~same, None).otherwise(F.get(listed, F.array_position("common", w).cast("int") - 1))
        return F.when(F.get("slots", _slot(h)), found)

    coded = F.when(F.col("n") >= MIN_COMMON_WORDS, F.array_join(F.zip_with("w", "each", place), ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    hashed = each.select(
        "row", *compared, "n", "n_chars", "n_symbols", *COUNTED, lines.alias("lines"),
        F.coalesce(coded, F.lit("")).alias("hits"), F.slice(triples, 1, F.greatest(F.col("n") - 2, F.lit(0))).alias("hashes"),
    )
    counted = hashed.withColumn("n_hits", F.length("hits")).withColumn("n_dup_lines", F.size("lines") - F.size(F.array_distinct("lines"))).drop("lines")
    failed = (F.col("n") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n"))
    based = _repeat_words(counted, text).withColumn("base_failed", failed)
    found = F.transform("common", lambda _, i: F.col("n_hits") - F.length(F.replace(F.col("hits"), F.substring(F.lit(PLACES), i + 1, F.lit(1)), F.lit(""))))
    word_counts = F.transform(F.concat(found, F.array(F.col("n") - F.col("n_hits"))), lambda c: c.cast("long"))
    of_letters = F.transform("places", lambda i: F.get("word_counts", i))
    others = F.col("n") - F.aggregate("of_letters", F.lit(0).cast("long"), lambda a, c: a + c)
    lettered = based.withColumn("word_counts", word_counts).withColumn("of_letters", of_letters)
    tested = (F.col("n") >= MIN_COMMON_WORDS) & (F.col("n") * F.col("covered") >= MIN_EXPECTED) & F.col("word_limit").isNotNull() & ~F.col("base_failed")
    lacking = F.when(tested, js_distance(shares(F.concat("of_letters", F.array(others)), F.col("n")), F.col("letter_shares")) > F.col("word_limit"))
    has_reference = F.col("common").isNotNull()
    classes = F.array(*[F.col(c).cast("long") for c in COUNTED])
    # Each distance stands in the result and in the verdict: the fence keeps it from being computed for both.
    distances = fenced(
        lettered,
        [
            "row", "n", (F.col("n_chars") - F.col("n_space")).alias("word_chars"), "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            F.coalesce(lacking, F.lit(False)).alias("lacking"),
            F.when(has_reference & (F.col("n_chars") >= MIN_CLASS_CHARS), js_distance(shares(classes, F.col("n_chars")), F.col("class_shares"))).alias("class_distance"),
            F.when(has_reference & (F.col("n") >= MIN_COMMON_WORDS), js_distance(shares(F.col("word_counts"), F.col("n")), F.col("word_shares"))).alias("word_distance"),
        ],
    )
    far = (F.coalesce(F.col("class_distance"), F.lit(0.0)) > max_class_distance) | (F.coalesce(F.col("word_distance"), F.lit(0.0)) > max_word_distance) | F.col("lacking")
    columns = [
        *[F.col("row").getField(c).alias(c) for c in names],
        F.col("n").cast("long").alias("n_words"),
        *[F.col(c).cast("long").alias(c) for c in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        "class_distance",
        "word_distance",
        (~F.col("base_failed") & ~far).alias("kept"),
    ]
    return distances.select(*columns)


def op4_sql() -> str:
    """DuckDB SQL for the query's rows. A key of NULL stands for the whole corpus."""
    space = r"[\x20\x09-\x0D]"
    strip = f"regexp_replace(t, '^{space}+|{space}+$', '', 'g')"
    only = lambda members: f"length(regexp_replace(t, '[^{members}]+', '', 'g'))"
    classes = [only(c) for c in CLASSES.values()]
    names = [*CLASSES, "space", "rest"]
    jsd = lambda p, q: (
        f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda z: ((CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END) + (CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END)) / 2))))"
    )
    shares = lambda c: f"list_transform({c}, lambda x: coalesce(x / nullif(list_sum({c}), 0), 0)::DOUBLE)"
    lettered = lambda k: f"list_transform(ref_places, lambda i: {k}[i])"
    with_rest = lambda k, total: f"({lettered(k)} || [{total} - coalesce(list_sum({lettered(k)}), 0)])"
    ref_letters, doc_letters = with_rest("ref_words", "list_sum(ref_words)"), with_rest("hits", "n")
    none = "(list_transform(ref_places, lambda i: 0) || [1])"
    covered = f"coalesce(list_sum({lettered('ref_words')}), 0) / list_sum(ref_words)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang AS language, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, CASE WHEN {strip} = '' THEN [] ELSE string_split_regex({strip}, '{space}+') END AS w FROM d),
    c AS (SELECT *, list_transform(w, lambda x: lower(x)) AS lw, length(t) AS n_chars, {", ".join(f"{x} AS {n}" for x, n in zip(classes, names, strict=False))}, length(t) - {only(space[1:-1])} AS in_words, {only(SYMBOLS)} AS n_symbols FROM w),
    classed AS (SELECT *, len(w) AS n, {only(space[1:-1])} AS space, in_words - {" - ".join(CLASSES)} AS rest FROM c),
    win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
    again AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS k FROM win) WHERE k > 1),
    covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY rid),
    line AS (SELECT rid, count(*) - count(DISTINCT x) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
    own AS (SELECT language FROM classed WHERE language IS NOT NULL GROUP BY language HAVING sum(n) >= {MIN_REFERENCE_WORDS} UNION ALL SELECT NULL),
    seen AS (SELECT * FROM classed WHERE language IS NOT NULL UNION ALL SELECT * REPLACE (NULL AS language) FROM classed),
    ref_class AS (SELECT language AS ref, [{", ".join(f"sum({n})" for n in names)}] AS k FROM seen GROUP BY language),
    counts AS (SELECT language AS ref, word, count(*) AS n FROM (SELECT language, unnest(lw) AS word FROM seen) GROUP BY ALL),
    top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY n DESC, word) AS place FROM counts) WHERE place <= {N_COMMON}),
    ref_word AS (SELECT ref, list(word ORDER BY place) AS common, list(n ORDER BY place) || [(SELECT sum(n) FROM counts x WHERE x.ref IS NOT DISTINCT FROM top.ref) - sum(n)] AS k,
                        coalesce(list(place ORDER BY place) FILTER (WHERE regexp_matches(word, '\\p{{L}}')), []) AS places FROM top GROUP BY ref),
    doc AS (
      SELECT c.*, coalesce(v.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_dup_lines, [{", ".join(f"c.{n}" for n in names)}] AS classes, rc.k AS ref_classes, rw.k AS ref_words, rw.places AS ref_places,
             list_transform(rw.common, lambda x: len(list_filter(c.lw, lambda y: y = x))) AS hits
      FROM classed c LEFT JOIN own ON own.language IS NOT DISTINCT FROM c.language
      LEFT JOIN ref_class rc ON rc.ref IS NOT DISTINCT FROM c.language AND c.language IS NOT DISTINCT FROM own.language
      LEFT JOIN ref_word rw ON rw.ref IS NOT DISTINCT FROM c.language AND c.language IS NOT DISTINCT FROM own.language
      LEFT JOIN covered v USING (rid) LEFT JOIN line l USING (rid)
    ), judged AS (
      SELECT *, n < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n AS base_failed,
             CASE WHEN n_chars >= {MIN_CLASS_CHARS} THEN {jsd(shares("classes"), shares("ref_classes"))} END AS class_distance,
             CASE WHEN n >= {MIN_COMMON_WORDS} THEN {jsd(shares("(hits || [n - list_sum(hits)])"), shares("ref_words"))} END AS word_distance,
             CASE WHEN language IS NOT NULL AND n >= {MIN_COMMON_WORDS} AND n * {covered} >= {MIN_EXPECTED}
                  THEN {jsd(shares(doc_letters), shares(ref_letters))} > {LACKING_SHARE} * {jsd(none, shares(ref_letters))} END AS lacking FROM doc
    )
    SELECT doc_id, n::BIGINT AS n_words, in_words::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT base_failed AND coalesce(class_distance, 0) <= {MAX_CLASS_DISTANCE} AND coalesce(word_distance, 0) <= {MAX_WORD_DISTANCE} AND NOT coalesce(lacking, FALSE) AS kept,
           round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance FROM judged"""

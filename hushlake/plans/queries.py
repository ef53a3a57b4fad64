"""The queries that the driver checks, on its tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import masking, spans, tokens
from ..functions import text as texts
from ..functions.patterns import AFTER_NAMES, CATALOGUE, FULL_NAME, MOST_NAME_WORDS, NOT_NAMES, NUMERALS, PRIORITY, RECOGNISERS, SCREEN, TOKEN_RULES, Pattern
from ..operators import annotation_qa, datasets, ensemble, evaluation, generation
from ..operators.detectors import PatternDetector, RecogniserDetector, TokenRuleDetector, decode_bio
from ..scratch import new_folder, written
from ..sources import dialogs as dialog_files
from ..sources.metrics import append_absent
from . import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL for spans: candidates by splitting, resolution by a recursive fold over each document's candidates.


def candidates_sql(patterns: list[Pattern], source: str = "SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL", unicode: bool = False) -> str:
    r"""CTEs that end in ``cand``. ``unicode``: word boundaries at a pattern's ends are tests of the characters beside a match, as the SQL engine's are ASCII."""

    def regex(p: Pattern) -> str:
        return p.re2.replace(r"\b", "") if unicode else p.re2

    def bound(p: Pattern) -> str:
        word, tests = r"[\p{L}\p{N}_]", []
        if p.regex.startswith(r"\b"):
            tests.append(f"regexp_matches(substr(t, s, 1), '{word}') <> regexp_matches(text, '^{word}')")
        if p.regex.endswith(r"\b"):
            tests.append(f"regexp_matches(text, '{word}$') <> regexp_matches(substr(t, s + length(text) + 1, 1), '{word}')")
        return f"WHEN {p.order} THEN {' AND '.join(tests)}" if tests else ""

    parts = " UNION ALL ".join(
        f"SELECT doc_id, t, {p.order} AS ord, {PRIORITY.get(p.type, 1)} AS prio, '{p.type}' AS type, regexp_extract_all(t, '{regex(p)}') AS m, string_split_regex(t, '{regex(p)}') AS g FROM src WHERE regexp_matches(t, '{regex(p)}')"
        for p in patterns
    )
    ends = " ".join(filter(None, map(bound, patterns))) if unicode else ""
    return f"""src AS ({source}), hit AS ({parts}),
    every AS (
      SELECT doc_id, t, ord, prio, type, m[i] AS text,
             (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT AS s
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hit)
    ), cand AS (SELECT doc_id, ord, prio, type, text, s FROM every WHERE {f"CASE ord {ends} ELSE TRUE END" if ends else "TRUE"})"""


def resolved_sql(patterns: list[Pattern], source: str | None = None, by_length: bool = False, unicode: bool = False, where: str = "TRUE", cand: str = "") -> str:
    """CTEs that end in ``kept`` (doc_id, s, e, type, text); ``where`` chooses among the candidates ``c``, which CTEs of one's own may make."""
    cand = cand or (candidates_sql(patterns, source, unicode) if source else candidates_sql(patterns))
    order, wins = ("s, -length(text), ord", "FALSE") if by_length else ("s, s + length(text), ord", "r.prio > f.prio")
    take = f"(r.s >= f.e OR {wins})"
    return f"""WITH RECURSIVE {cand},
    ranked AS (SELECT *, s + length(text) AS e, row_number() OVER (PARTITION BY doc_id ORDER BY {order}) AS rn FROM cand c WHERE {where}),
    fold(doc_id, rn, island, s, e, prio, type, text) AS (
      SELECT doc_id, rn, 1, s, e, prio, type, text FROM ranked WHERE rn = 1
      UNION ALL
      SELECT r.doc_id, r.rn, CASE WHEN r.s >= f.e THEN f.island + 1 ELSE f.island END, CASE WHEN {take} THEN r.s ELSE f.s END, CASE WHEN {take} THEN r.e ELSE f.e END,
             CASE WHEN {take} THEN r.prio ELSE f.prio END, CASE WHEN {take} THEN r.type ELSE f.type END, CASE WHEN {take} THEN r.text ELSE f.text END
      FROM fold f JOIN ranked r ON r.doc_id = f.doc_id AND r.rn = f.rn + 1
    ),
    kept AS (SELECT doc_id, s, e, type, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, island ORDER BY rn DESC) AS last FROM fold) WHERE last = 1)"""


#: Full names need Cyrillic letters, which these tables do not have: the SQL leaves that one pattern out here; ``planted_spans`` has it.
ALL_SQL = resolved_sql(CATALOGUE)
ONE = {"email_spans": 6, "phone_spans": 5, "card_spans": 16, "ip_spans": 22}
SPAN_COLUMNS = "doc_id, s AS span_start, s + length(text) AS span_end, text AS span_text"


def exploded(df: DataFrame, key: str = "doc_id", column: str = "spans") -> DataFrame:
    rows = df.select(key, F.explode(F.col(column)).alias("s"))
    return rows.select(key, F.col("s.start").cast("long").alias("span_start"), F.col("s.end").cast("long").alias("span_end"), F.col("s.type").alias("span_type"), F.col("s.text").alias("span_text"))


def found(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return PatternDetector(**options).detect(table(spark, sf_dir, "documents"))


def _single(name: str, number: int) -> None:
    p = CATALOGUE[number]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = table(spark, sf_dir, "documents").select("doc_id", spans.find(F.col("text"), p.java, p.type).alias("spans"))
        return exploded(docs).drop("span_type")

    QUERIES[name] = run
    ORACLES[name] = f"WITH {candidates_sql([p])} SELECT {SPAN_COLUMNS} FROM cand"


for _name, _number in ONE.items():
    _single(_name, _number)


@query(f"SELECT doc_id, coalesce({' OR '.join(f"regexp_matches(text, '{r}')" for r in SCREEN)}, FALSE) AS suspicious FROM documents")
def pd_screen(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.may_hold_personal_data(F.col("text")).alias("suspicious"))


@query(f"WITH {candidates_sql([CATALOGUE[23]], 'SELECT page_id AS doc_id, url AS t FROM pages WHERE url IS NOT NULL')} SELECT {SPAN_COLUMNS.replace('doc_id,', 'doc_id AS page_id,')} FROM cand")
def url_spans(spark, sf_dir):
    p = CATALOGUE[23]
    return exploded(table(spark, sf_dir, "pages").select("page_id", spans.find(F.col("url"), p.java, p.type).alias("spans")), "page_id").drop("span_type")


@query(ALL_SQL + " SELECT doc_id, s AS span_start, e AS span_end, type AS span_type, text AS span_text FROM kept")
def resolved_spans(spark, sf_dir):
    return exploded(found(spark, sf_dir))


_PAGES = "SELECT page_id AS doc_id, html AS t FROM pages WHERE html IS NOT NULL"


@query(resolved_sql(CATALOGUE, _PAGES) + " SELECT doc_id AS page_id, s AS span_start, e AS span_end, type AS span_type, md5(text) AS span_md5 FROM kept")
def page_spans(spark, sf_dir):
    rows = exploded(PatternDetector().detect(table(spark, sf_dir, "pages").select("page_id", "html"), "html"), "page_id")
    return rows.select("page_id", "span_start", "span_end", "span_type", F.md5("span_text").alias("span_md5"))


def _masked_sql(types: str) -> str:
    return (
        ALL_SQL
        + f""", chosen AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev FROM kept WHERE {types}),
    piece AS (
      SELECT c.doc_id, string_agg(substr(d.text, c.prev + 1, c.s - c.prev) || '<' || c.type || '>', '' ORDER BY c.s) AS front, max(c.e) AS at
      FROM chosen c JOIN documents d ON d.doc_id = c.doc_id GROUP BY c.doc_id
    )
    SELECT d.doc_id, md5(coalesce(p.front || substr(d.text, p.at + 1), d.text)) AS masked_md5 FROM documents d LEFT JOIN piece p ON p.doc_id = d.doc_id"""
    )


@query(_masked_sql("TRUE"))
def mask_all(spark, sf_dir):
    return jobs.mask_texts(table(spark, sf_dir, "documents")).select("doc_id", F.md5("masked").alias("masked_md5"))


@query(_masked_sql("type NOT IN ('PERSON', 'PHONE', 'EMAIL', 'PASSPORT', 'SNILS', 'INN')"))
def mask_low_aggressiveness(spark, sf_dir):
    docs = jobs.mask_texts(table(spark, sf_dir, "documents"), PatternDetector(0.8), aggressiveness=0.3)
    return docs.select("doc_id", F.md5("masked").alias("masked_md5"))


def _one_mask(name: str, number: int) -> None:
    p = CATALOGUE[number]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        masked = jobs.mask_texts(table(spark, sf_dir, "documents"), PatternDetector(patterns=[p]))
        return masked.select("doc_id", F.md5("masked").alias("masked_md5"))

    QUERIES[name] = run
    ORACLES[name] = f"SELECT doc_id, md5(regexp_replace(text, '{p.re2}', '<{p.type}>', 'g')) AS masked_md5 FROM documents"


_one_mask("mask_email", 6)
_one_mask("mask_ip", 22)


def _number_sql(salt: int, low: int, high: int) -> str:
    return f"(CAST('0x' || substr(md5('7:' || c.doc_id || ':' || c.s || ':{salt}'), 1, 13) AS BIGINT) % {high - low + 1} + {low})"


_PSEUDONYM_SQL = f"""CASE c.type WHEN 'EMAIL' THEN 'user' || {_number_sql(1, 100, 99_999)} || '@example.org'
    WHEN 'IP_ADDRESS' THEN {_number_sql(1, 1, 223)} || '.' || {_number_sql(2, 0, 255)} || '.' || {_number_sql(3, 0, 255)} || '.' || {_number_sql(4, 1, 254)}
    WHEN 'PHONE' THEN '+7 ' || {_number_sql(1, 900, 999)} || ' ' || lpad({_number_sql(2, 0, 999)}::VARCHAR, 3, '0') || '-' || lpad({_number_sql(3, 0, 99)}::VARCHAR, 2, '0') || '-' || lpad({_number_sql(4, 0, 99)}::VARCHAR, 2, '0')
    WHEN 'URL' THEN 'https://example.org/' || {_number_sql(1, 1000, 99_999)}
    WHEN 'INN' THEN lpad({_number_sql(1, 0, 10**12 - 1)}::VARCHAR, 12, '0')
    ELSE '<' || c.type || '>' END"""


@query(_masked_sql("TRUE").replace("'<' || c.type || '>'", f"({_PSEUDONYM_SQL})"))
def mask_pseudonyms(spark, sf_dir):
    docs = jobs.mask_texts(table(spark, sf_dir, "documents"), policy=masking.pseudonym(7), key="doc_id")
    return docs.select("doc_id", F.md5("masked").alias("masked_md5"))


@query(
    f"""WITH {candidates_sql(CATALOGUE)},
    m AS (SELECT *, s + length(text) AS e, max(s + length(text)) OVER (PARTITION BY doc_id ORDER BY s, s + length(text), ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cand),
    i AS (SELECT *, sum(CASE WHEN s < reach THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s, e, ord ROWS UNBOUNDED PRECEDING) AS island FROM m)
    SELECT doc_id, min(s) AS span_start, max(e) AS span_end, first(type ORDER BY prio DESC, s, e, ord) AS span_type FROM i GROUP BY doc_id, island"""
)
def mask_extent(spark, sf_dir):
    """Spans merged to their common extent, so that masking leaves no part of an overlapped one visible."""
    return exploded(found(spark, sf_dir, keep_extent=True)).drop("span_text")


@query(
    ALL_SQL
    + " SELECT doc_id, s AS span_start, e AS span_end, type AS span_type, e - s AS span_length, type NOT IN ('PERSON', 'PHONE', 'EMAIL', 'PASSPORT', 'SNILS', 'INN') AS will_mask FROM kept"
)
def span_report(spark, sf_dir):
    rows = found(spark, sf_dir).select("doc_id", F.explode(masking.report(F.col("spans"), 0.2)).alias("r"))
    long = lambda c, n: F.col(f"r.{c}").cast("long").alias(n)
    return rows.select("doc_id", long("start", "span_start"), long("end", "span_end"), F.col("r.type").alias("span_type"), long("length", "span_length"), F.col("r.will_anonymize").alias("will_mask"))


@query(ALL_SQL + " SELECT type AS span_type, count(*) AS n FROM kept GROUP BY type")
def type_histogram(spark, sf_dir):
    return exploded(found(spark, sf_dir)).groupBy("span_type").agg(F.count(F.lit(1)).alias("n"))


@query(ALL_SQL + " SELECT d.lang, k.type AS span_type, count(*) AS n, count(DISTINCT k.doc_id) AS n_docs FROM kept k JOIN documents d ON d.doc_id = k.doc_id GROUP BY d.lang, k.type")
def type_by_language(spark, sf_dir):
    rows = found(spark, sf_dir).select("lang", "doc_id", F.explode("spans").alias("s"))
    return rows.groupBy("lang", F.col("s.type").alias("span_type")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def dialogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dialogs, what the patterns find as their entities."""
    docs = found(spark, sf_dir)
    return docs.select(F.col("doc_id").alias("id"), "text", "lang", F.col("spans").cast(f"array<{datasets.ENTITY}>").alias("entities"), (F.size("spans") > 0).alias("has_pd"))


_STATS = """SELECT count(*) AS total_dialogs, count(*) FILTER (WHERE n > 0) AS dialogs_with_pd, count(*) FILTER (WHERE n = 0) AS dialogs_without_pd,
    round(100.0 * count(*) FILTER (WHERE n > 0) / count(*), 6) AS pd_percentage, sum(n)::BIGINT AS total_entities"""
_COUNTED = ALL_SQL + ", c AS (SELECT d.doc_id, d.lang, d.text, (SELECT count(*) FROM kept k WHERE k.doc_id = d.doc_id) AS n FROM documents d) "


_TYPES = "(SELECT string_agg(type || ':' || n, ',' ORDER BY type) FROM (SELECT type, count(*) AS n FROM kept GROUP BY type)) AS entity_types"


@query(_COUNTED + _STATS + f", {_TYPES} FROM c")
def dataset_stats(spark, sf_dir):
    stats = datasets.dataset_stats(dialogs(spark, sf_dir)).withColumn("pd_percentage", F.round("pd_percentage", 6))
    types = F.transform(F.array_sort(F.map_entries("entity_types")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return stats.withColumn("entity_types", F.array_join(types, ","))


@query(_COUNTED + "SELECT round(avg(length(text)), 4) AS avg_text_length, min(length(text)) AS min_text_length, max(length(text)) AS max_text_length, round(avg(n), 6) AS avg_entities, max(n) AS max_entities FROM c")
def length_stats(spark, sf_dir):
    stats = datasets.length_stats(dialogs(spark, sf_dir))
    return stats.withColumn("avg_text_length", F.round("avg_text_length", 4)).withColumn("avg_entities", F.round("avg_entities", 6))


@query(
    _COUNTED
    + f""", s AS (SELECT lang = 'en' AS en, * FROM ({_STATS}, lang = 'en' AS lang FROM c GROUP BY lang = 'en'))
    SELECT b.total_dialogs - a.total_dialogs AS total_dialogs_difference, round(b.pd_percentage - a.pd_percentage, 4) AS pd_percentage_difference, b.total_entities - a.total_entities AS total_entities_difference
    FROM s a JOIN s b ON a.lang AND NOT b.lang""".replace("lang = 'en' AS en, ", "")
)
def compare_datasets(spark, sf_dir):
    every = dialogs(spark, sf_dir)
    out = datasets.compare_datasets(every.where("lang = 'en'"), every.where("lang <> 'en'"))
    return out.withColumn("pd_percentage_difference", F.round("pd_percentage_difference", 4))


VOTERS = {"first": ["EMAIL", "IP_ADDRESS"], "second": ["IP_ADDRESS", "BANK_CARD"], "third": ["EMAIL", "URL"]}
VOTER_WEIGHTS = {"first": 1.0, "second": 1.25, "third": 0.75}


def voters() -> list[PatternDetector]:
    return [PatternDetector(types=types, name=name) for name, types in VOTERS.items()]


_VOTES = resolved_sql([p for p in CATALOGUE if p.type in {"EMAIL", "IP_ADDRESS", "BANK_CARD", "URL"}]) + ", votes AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS source, {VOTER_WEIGHTS[name]}::DOUBLE AS weight, * FROM kept WHERE type IN ({', '.join(repr(t) for t in types)})" for name, types in VOTERS.items()
) + ")"


@query(_VOTES + " SELECT doc_id, s AS span_start, e AS span_end, type AS span_type, text AS span_text FROM votes GROUP BY ALL HAVING sum(weight) / 3.0 >= 0.5".replace("GROUP BY ALL", "GROUP BY doc_id, s, e, type, text"))
def consensus_spans(spark, sf_dir):
    return exploded(ensemble.consensus(table(spark, sf_dir, "documents"), voters(), VOTER_WEIGHTS, 0.5))


@query(_VOTES + " SELECT DISTINCT doc_id, s AS span_start, e AS span_end, type AS span_type, text AS span_text FROM votes")
def union_spans(spark, sf_dir):
    return exploded(ensemble.union(table(spark, sf_dir, "documents"), voters()))


@query(
    _VOTES
    + """ SELECT source, (SELECT count(*) FROM documents) AS n_texts, count(*) AS n_spans, count(DISTINCT type) AS n_types, 0::BIGINT AS errors, round(count(*) / (SELECT count(*) FROM documents)::DOUBLE, 6) AS spans_per_text, 1.0::DOUBLE AS success_rate FROM votes GROUP BY source"""
)
def detector_comparison(spark, sf_dir):
    return ensemble.compare_detectors(table(spark, sf_dir, "documents"), voters()).withColumn("spans_per_text", F.round("spans_per_text", 6))


@query(
    _VOTES
    + f""", name(source) AS (VALUES {", ".join(f"('{n}')" for n in VOTERS)})
    SELECT d.doc_id, name.source, count(v.type) AS n_spans, coalesce(string_agg(DISTINCT v.type, ',' ORDER BY v.type), '') AS types
    FROM documents d CROSS JOIN name LEFT JOIN votes v ON v.doc_id = d.doc_id AND v.source = name.source GROUP BY d.doc_id, name.source"""
)
def text_analysis(spark, sf_dir):
    """What each detector finds in each text, also nothing."""
    rows = ensemble.analyse_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), voters())
    return rows.select("doc_id", "source", "n_spans", F.array_join("types", ",").alias("types"))


def _moved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold spans, and the same moved by none, one or two characters after the document's number. Detection runs once."""
    spans_ = exploded(found(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("scope"), F.col("span_start").alias("start"), F.col("span_end").alias("end"), F.col("span_type").alias("type"))
    rows = written(spans_, "spans")
    return rows, rows.withColumn("start", F.col("start") + F.pmod(F.col("scope").cast("long"), F.lit(3)))


def _metrics_sql(hit: str) -> str:
    rates = "round(coalesce({a} / nullif({b}, 0), 0), 6)"
    p, r = "tp::DOUBLE / nullif(n, 0)", "tp::DOUBLE / nullif(n, 0)"
    return (
        ALL_SQL
        + f""", t AS (SELECT type AS entity_type, count(*) AS n, count(*) FILTER (WHERE {hit}) AS tp FROM kept GROUP BY type),
    m AS (SELECT *, coalesce({p}, 0) AS pr FROM t)
    SELECT entity_type, round(pr, 6) AS precision, round(pr, 6) AS recall, round(pr, 6) AS f1, tp, n - tp AS fp, n - tp AS fn, n AS total_true, n AS total_pred, round(n::DOUBLE / (SELECT sum(n) FROM t), 6) AS class_proportion FROM m
    UNION ALL SELECT 'ALL_MICRO', {rates.format(a="sum(tp)::DOUBLE", b="sum(n)")}, {rates.format(a="sum(tp)::DOUBLE", b="sum(n)")}, {rates.format(a="sum(tp)::DOUBLE", b="sum(n)")}, sum(tp)::BIGINT, sum(n - tp)::BIGINT, sum(n - tp)::BIGINT, sum(n)::BIGINT, sum(n)::BIGINT, 1.0 FROM m
    UNION ALL SELECT 'ALL_MACRO', round(avg(pr), 6), round(avg(pr), 6), round(avg(pr), 6), sum(tp)::BIGINT, sum(n - tp)::BIGINT, sum(n - tp)::BIGINT, sum(n)::BIGINT, sum(n)::BIGINT, 1.0 FROM m"""
    )


def _rounded(df: DataFrame) -> DataFrame:
    for c in ("precision", "recall", "f1", "class_proportion"):
        df = df.withColumn(c, F.round(c, 6))
    return df


@query(_metrics_sql("doc_id % 3 < 2"))
def metrics_by_type(spark, sf_dir):
    return _rounded(evaluation.metrics_by_type(*_moved(spark, sf_dir)))


@query(_metrics_sql("(e - s - doc_id % 3)::DOUBLE / (e - s) >= 0.9"))
def metrics_by_overlap(spark, sf_dir):
    return _rounded(evaluation.metrics_by_type(*_moved(spark, sf_dir), 0.9))


_CAPITALS = Pattern("PERSON", "[A-Z][a-z]+")


def _chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold: from each capitalised word to eight characters into the third after it, so that spans overlap in long chains. Predicted: each from two to four
    characters later, twice of the same start for some, so that they compete and tie."""
    words = F.transform(spans.find(F.col("text"), _CAPITALS.java, "PERSON"), lambda s: s["start"])
    third = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", F.posexplode(F.arrays_zip(F.col("w").alias("a"), F.slice("w", 3, F.greatest(F.size("w") - 2, F.lit(1))).alias("b"))).alias("k", "s"))
    at = third.where("s.b IS NOT NULL").select(F.col("doc_id").cast("string").alias("scope"), F.col("k").cast("long").alias("k"), F.col("s.a").cast("long").alias("start"), (F.col("s.b") + 8).cast("long").alias("end"), F.lit("PERSON").alias("type"))
    rows = written(at, "spans")
    shifts = F.array(F.lit(2), F.when(F.col("k") % 3 == 0, F.lit(4)), F.when(F.col("k") % 5 == 0, F.lit(-2)))
    moved = rows.withColumn("by", F.explode(F.array_compact(shifts))).select("scope", (F.col("start") + F.col("by")).alias("start"), (F.col("end") + F.abs("by") - 2).alias("end"), "type")
    return rows.drop("k"), moved


@query(
    f"""WITH RECURSIVE {candidates_sql([_CAPITALS])},
    w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS k, s, lead(s, 2) OVER (PARTITION BY doc_id ORDER BY s) + 8 AS e FROM cand),
    g AS (SELECT doc_id, k + 1 AS i, s, e FROM w WHERE e IS NOT NULL),
    p AS (SELECT doc_id, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s, e) AS j FROM (
      SELECT DISTINCT doc_id, s + b AS s, e + abs(b) - 2 AS e FROM (SELECT doc_id, s, e, unnest([2, CASE WHEN k % 3 = 0 THEN 4 END, CASE WHEN k % 5 = 0 THEN -2 END]) AS b FROM w WHERE e IS NOT NULL) WHERE b IS NOT NULL)),
    c AS (SELECT * FROM (SELECT g.doc_id, g.i, p.j, (least(g.e, p.e) - greatest(g.s, p.s))::DOUBLE / (g.e - g.s + p.e - p.s - (least(g.e, p.e) - greatest(g.s, p.s))) AS score
          FROM g JOIN p ON p.doc_id = g.doc_id AND p.s < g.e AND g.s < p.e) WHERE score >= 0.4),
    o AS (SELECT doc_id, i, list(j ORDER BY score DESC, j) AS js, min(j) AS least FROM c GROUP BY doc_id, i),
    q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM o),
    f(doc_id, n, used, hit) AS (
      SELECT doc_id, 0::BIGINT, []::BIGINT[], NULL::BIGINT FROM (SELECT DISTINCT doc_id FROM q)
      UNION ALL
      SELECT doc_id, n, CASE WHEN hit IS NULL THEN used ELSE list_append(used, hit) END, hit
      FROM (SELECT q.doc_id, q.n, list_filter(f.used, lambda x: x >= q.least - 60) AS used, list_filter(q.js, lambda x: NOT list_contains(f.used, x))[1] AS hit FROM f JOIN q ON q.doc_id = f.doc_id AND q.n = f.n + 1)
    ),
    t AS (SELECT (SELECT count(*) FROM f WHERE hit IS NOT NULL) AS tp, (SELECT count(*) FROM (SELECT DISTINCT doc_id, s, e FROM g)) AS gold, (SELECT count(*) FROM p) AS predicted)
    SELECT tp, predicted - tp AS fp, gold - tp AS fn, round(tp / predicted, 6) AS precision, round(tp / gold, 6) AS recall, round(2.0 * tp / (predicted + gold), 6) AS f1 FROM t"""
)
def metrics_of_chains(spark, sf_dir):
    """Spans that wait for each other in chains as long as a text, with ties, matched by overlap."""
    return evaluation.overall_metrics(*_chain(spark, sf_dir), 0.4).select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    f"""WITH {candidates_sql([_CAPITALS])},
    d AS (SELECT DISTINCT s, s + length(text) AS e FROM cand), n AS (SELECT s, s + length(text) AS e, count(*) AS n FROM cand GROUP BY ALL),
    m AS (SELECT *, CASE WHEN s <= lag(e) OVER (ORDER BY s, e) + 3 THEN 0 ELSE 1 END AS fresh FROM n),
    i AS (SELECT *, sum(fresh) OVER (ORDER BY s, e) AS island FROM m)
    SELECT min(s) AS span_start, arg_max(e, (s, e)) AS span_end, sum(n)::BIGINT AS members FROM i GROUP BY island""".replace("d AS (SELECT DISTINCT s, s + length(text) AS e FROM cand), ", "")
)
def pooled_name_islands(spark, sf_dir):
    """Names of all documents in one scope."""
    docs = table(spark, sf_dir, "documents").select("doc_id", spans.find(F.col("text"), _CAPITALS.java, "PERSON").alias("spans"))
    merged = evaluation.name_islands(evaluation.span_rows(docs, pooled=True))
    return merged.select(F.col("start").alias("span_start"), F.col("end").alias("span_end"), "members")


@query(
    f"""WITH {candidates_sql([_CAPITALS])},
    m AS (SELECT *, s + length(text) AS e, CASE WHEN s <= lag(s + length(text)) OVER (PARTITION BY doc_id ORDER BY s) + 3 THEN 0 ELSE 1 END AS fresh FROM cand),
    i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM m)
    SELECT doc_id::VARCHAR AS scope, min(s) AS span_start, max(e) AS span_end, count(*) AS members FROM i GROUP BY doc_id, island"""
)
def name_islands(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", spans.find(F.col("text"), _CAPITALS.java, "PERSON").alias("spans"))
    merged = evaluation.name_islands(evaluation.span_rows(docs))
    return merged.select("scope", F.col("start").alias("span_start"), F.col("end").alias("span_end"), "members")


_CARRIED = "md5(text) AS text_md5, n AS n_entities"


def _carried() -> list[Column]:
    """What shows that a dialog's text and entities went along."""
    return [F.md5("text").alias("text_md5"), F.coalesce(F.size("entities"), F.lit(0)).cast("long").alias("n_entities")]


@query(_COUNTED + f"SELECT doc_id AS original_id, (lang <> 'en')::INTEGER AS part, row_number() OVER (ORDER BY lang <> 'en', doc_id) AS id, {_CARRIED} FROM c")
def merge_reid(spark, sf_dir):
    every = written(dialogs(spark, sf_dir), "dialogs")
    return datasets.merge_datasets([every.where("lang = 'en'"), every.where("lang <> 'en'")]).select("original_id", "part", "id", *_carried())


@query(
    _COUNTED
    + f""", p AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS place, floor(0.7 * (SELECT count(*) FROM documents))::BIGINT AS cut FROM c)
    SELECT doc_id AS original_id, CASE WHEN place <= cut THEN 'train' ELSE 'val' END AS part, CASE WHEN place <= cut THEN place ELSE place - cut END AS id, {_CARRIED} FROM p"""
)
def train_val_split(spark, sf_dir):
    train, val = datasets.split_dataset(dialogs(spark, sf_dir))
    both = train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))
    return both.select("original_id", "part", "id", *_carried())


@query(
    _COUNTED
    + f""", p AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS place, (SELECT count(*) FROM documents) AS total FROM c), s AS (SELECT *, (place - 1) // 50 + 1 AS shard FROM p)
    SELECT doc_id AS id, place, shard, ((shard - 1) * 50 + 1) || '-' || least(shard * 50, total) AS dialog_range, {_CARRIED} FROM s"""
)
def shards_of_50(spark, sf_dir):
    return datasets.shards(dialogs(spark, sf_dir)).select("id", "place", "shard", "dialog_range", *_carried())


@query(
    ALL_SQL
    + """, a AS (
      SELECT d.doc_id, d.text AS o_text, CASE WHEN d.doc_id % 7 = 0 THEN d.text || ' .' ELSE d.text END AS text, l.toxic = 1 AS o_pd, (SELECT count(*) FROM kept k WHERE k.doc_id = d.doc_id) AS n
      FROM documents d JOIN labels l ON l.doc_id = d.doc_id
    ), n AS (SELECT count(*) AS total, count(*) FILTER (WHERE n > 0) AS annotated, count(*) FILTER (WHERE text <> o_text) AS text_changes,
      count(*) FILTER (WHERE NOT o_pd AND n > 0) AS false_to_true, count(*) FILTER (WHERE o_pd AND n = 0) AS true_to_false FROM a),
    e AS (SELECT count(*) FILTER (WHERE doc_id % 5 = 0) AS position_errors, count(*) FILTER (WHERE doc_id % 5 <> 0) AS valid_entities FROM kept WHERE doc_id IN (SELECT doc_id FROM a))
    SELECT n.*, e.*, round(100.0 * annotated / total, 6) AS percentage,
      CASE WHEN text_changes + position_errors = 0 THEN 'ОТЛИЧНОЕ' WHEN text_changes + position_errors < 5 THEN 'ХОРОШЕЕ' WHEN text_changes + position_errors < 20 THEN 'СРЕДНЕЕ' ELSE 'ПЛОХОЕ' END AS quality FROM n, e"""
)
def annotation_quality(spark, sf_dir):
    """Documents with labels as originals; annotated with some texts longer and some spans off."""
    rows = dialogs(spark, sf_dir).join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "toxic"), "id")
    original = rows.select("id", "text", (F.col("toxic") == 1).alias("has_pd"))
    off = F.transform("entities", lambda e: F.struct((e["start"] + F.when(F.col("id") % 5 == 0, 1).otherwise(0)).alias("start"), e["end"].alias("end"), e["type"].alias("type"), e["text"].alias("text")))
    longer = F.when(F.col("id") % 7 == 0, F.concat("text", F.lit(" ."))).otherwise(F.col("text"))
    annotated = rows.select("id", longer.alias("text"), off.alias("entities"), "has_pd")
    return annotation_qa.annotation_quality(original, annotated).withColumn("percentage", F.round("percentage", 6))


@query(
    ALL_SQL
    + """ SELECT d.doc_id AS id, count(k.s) FILTER (WHERE d.doc_id % 4 < 3) AS n_entities, count(k.s) FILTER (WHERE d.doc_id % 4 < 3) > 0 AS has_pd
    FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id"""
)
def normalised_dialogs(spark, sf_dir):
    """Entities whose text has white space around it are repaired, those with a wrong place go."""
    rows = dialogs(spark, sf_dir).withColumn("description", F.lit(None).cast("string"))

    def broken(e: Column) -> Column:
        text = F.when(F.col("id") % 4 == 1, F.concat(F.lit(" \n"), e["text"], F.lit(" "))).otherwise(e["text"])
        shift = F.when(F.col("id") % 4 == 3, 1_000_000).otherwise(0)
        return F.struct((e["start"] + shift).alias("start"), (e["end"] + shift).alias("end"), e["type"].alias("type"), text.alias("text"))

    out = datasets.normalise_dialogs(rows.withColumn("entities", F.transform("entities", broken)))
    return out.select("id", F.size("entities").cast("long").alias("n_entities"), "has_pd")


@query("SELECT conv_id, count(*) AS n_turns, md5(string_agg(role || ': ' || coalesce(text, ''), chr(10) ORDER BY turn)) AS dialog_md5 FROM conversations GROUP BY conv_id")
def dialog_assembly(spark, sf_dir):
    turn = F.struct("turn", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
    grouped = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select("conv_id", "n_turns", F.md5(F.array_join("turns.line", "\n")).alias("dialog_md5"))


@query("SELECT source || '/' || lang AS method, lang AS entity_type, count(*) AS tp FROM documents WHERE lang IN ('en', 'fr') GROUP BY source, lang UNION ALL SELECT source || '/' || lang, lang, -1 FROM documents WHERE lang = 'de' GROUP BY source, lang")
def append_absent_methods(spark, sf_dir):
    """A table of methods, and others appended whose methods it lacks."""
    counts = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("tp"))
    rows = counts.select(F.concat_ws("/", "source", "lang").alias("method"), F.col("lang").alias("entity_type"), "tp")
    more = rows.where("entity_type IN ('de', 'fr')").withColumn("tp", F.lit(-1).cast("long"))
    return append_absent(rows.where("entity_type IN ('en', 'fr')"), more)


def _choice_sql(u: str, weights: dict[str, float]) -> str:
    at, parts = 0.0, []
    for value, weight in weights.items():
        at += weight
        parts.append(f"WHEN {u} * {sum(weights.values())!r}::DOUBLE < {at!r}::DOUBLE THEN '{value}'")
    return f"CASE {' '.join(parts)} ELSE '{list(weights)[-1]}' END"


def _u_sql(salt: str) -> str:
    return f"(CAST('0x' || substr(md5('42:{salt}:' || batch), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0)"


#: Sources of the documents, each with as many dialogs to plan as it has documents.
_PLAN_SQL = f"""WITH t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
    b AS (SELECT source, total, unnest(range(0, -(-total // {min(generation.BATCH_SIZES)}))) AS number FROM t), n AS (SELECT *, coalesce(source, '') || ':' || number AS batch FROM b), c AS (
      SELECT source, total, number, batch, {_choice_sql(_u_sql("sphere"), generation.SPHERES)} AS business_sphere, {_choice_sql(_u_sql("region"), generation.REGIONS)} AS regional_focus,
        {_choice_sql(_u_sql("quality"), generation.QUALITIES)} AS transcription_quality, {_choice_sql(_u_sql("style"), generation.STYLES)} AS communication_style,
        (floor({_u_sql("pd")} * 11) + 70)::INTEGER AS pd_percentage, (floor({_u_sql("fp")} * 6) + 10)::INTEGER AS false_positive_percentage,
        list_extract([25, 30, 35, 40, 50], floor({_u_sql("size")} * 5)::INTEGER + 1)::INTEGER AS size FROM n
    ), p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c),
    plan AS (SELECT source, number, batch, business_sphere, regional_focus, transcription_quality, communication_style, pd_percentage, false_positive_percentage, least(size, total - before)::INTEGER AS batch_size FROM p WHERE before < total)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    return generation.plan_batches_by(totals, "source", "total")


@query(_PLAN_SQL + " SELECT * FROM plan")
def batch_plan(spark, sf_dir):
    return _plan(spark, sf_dir)


@query(_PLAN_SQL + " SELECT business_sphere, sum(batch_size)::BIGINT AS dialogs FROM plan GROUP BY business_sphere")
def sphere_distribution(spark, sf_dir):
    return generation.sphere_distribution(_plan(spark, sf_dir))


DETAILS = {"sphere": {"медицина": "Полисы и врачи."}, "region": {"Москва": "Метро.", "Казань": "Кремль."}}


def _prompt_sql() -> str:
    pd = "floor(batch_size * pd_percentage / 100.0)::INTEGER"
    values = {
        "total_dialogs": "batch_size", "pd_count": pd, "no_pd_count": f"batch_size - {pd}", "no_pd_percentage": "100 - pd_percentage",
        "sphere_details": "CASE business_sphere WHEN 'медицина' THEN 'Полисы и врачи.' ELSE '' END", "region_details": "CASE regional_focus WHEN 'Казань' THEN 'Кремль.' ELSE 'Метро.' END",
        "quality_details": "''", "style_details": "''", **{c: c for c in generation.CONFIG if c != "batch_size"},
    }
    prompt = "'" + generation.TEMPLATE.replace("\n", "' || chr(10) || '") + "'"
    for name, value in values.items():
        prompt = f"replace({prompt}, '{{{name}}}', ({value})::VARCHAR)"
    return _PLAN_SQL + f" SELECT batch, batch_size, {prompt} AS prompt FROM plan"


@query(_prompt_sql())
def prompts(spark, sf_dir):
    return generation.render_prompts(_plan(spark, sf_dir), DETAILS).select("batch", "batch_size", "prompt")


# ---- Texts in Cyrillic, which the tables lack: sentences chosen and numbered by each document's id, the same in both engines.

SENTENCES = [
    "Клиент Смирнов А.В. назвал паспорт: 45 #2 10#4 и СНИЛС 112-233-4#2 95.", "Встреча с Еленой Крыловой #2.0#1.2001, ей 3#1 лет.",
    "Мне 2#1 лет, почта u#4@mail.example и телефон +7 (912) 34#1-#2-67.", "Машина А1#2ВС77 стоит у дома, инн: 770#45#1.",
    "родился #2 марта 1980, ИНН 50#4123456, карта 4276 #4 1234 5678.", "Адрес сети 10.0.#1.#2, сайт https://пример.рф/#4 и www.site#1.ru/#2.",
    "Позвоните 8 (916) 12#1-45-#2 или 8916#45#2#1, спросите: Пётр Ильич Орлов.", "Серия 45#2 10#4, карта 4276 **** **** #4, возраст мне 4#1 лет.",
    "Погода хорошая, ничего личного.", "СНИЛС: 112-233-#2#1 95 и email: a#4@b.example",
]
RULED = [
    "Ему 3#1 лет.", "Мне 4#1 лет, живу в Омске.", "Возраст: #2 и рост", "Звоните + 7912#4", "тел: #4, добавочный", "Я выпускник МГТУ", "Она студент МФТИ", "Он окончил школу",
    "Работаю инженером", "должность : директор", "Профессия: врач", "живу на даче", "адрес: Тверь", "улица Садовая, дом #2", "Меня зовут Анна Белова, 8-912-34#1-#2-67", "Иванов П. С. и a#4@b.example", "Друг сказал: Олег Павлович Громов",
    "Студент МГТУ2 и студент МГТУ-2, окончил «Школу», окончил (вуз)", "Детям 1,5 лет, 10/12 лет, 7-8 лет и 3#1лет", "тел.: #4, тел :#4, тел:+#4", "Мне двадцать лет, улица Ново-Садовая", "возраст-: #2, возраст: #2-й, адрес:Тверь",
]


def planted(spark: SparkSession, sf_dir: str, sentences: list[str], whole: bool = False) -> DataFrame:
    """A sentence for each document; ``whole``: at the end of its text."""
    chosen = F.get(F.array(*[F.lit(x) for x in sentences]), F.pmod("doc_id", F.lit(len(sentences))).cast("int"))
    for n in (4, 2, 1):
        chosen = F.replace(chosen, F.lit(f"#{n}"), F.lpad(F.pmod("doc_id", F.lit(10**n)).cast("string"), n, "0"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), chosen) if whole else chosen
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))


def _planted_sql(sentences: list[str], whole: bool = False) -> str:
    listed = ", ".join(f"'{x}'" for x in sentences)
    chosen = f"list_extract([{listed}], (doc_id % {len(sentences)} + 1)::INTEGER)"
    for n in (4, 2, 1):
        chosen = f"replace({chosen}, '#{n}', lpad((doc_id % {10**n})::VARCHAR, {n}, '0'))"
    return f"SELECT doc_id, {"coalesce(text, '') || chr(10) || " if whole else ""}{chosen} AS t FROM documents"


_NO_NAME_OVERLAP = f"""ord <> {FULL_NAME.order} OR NOT EXISTS (SELECT 1 FROM cand b WHERE b.doc_id = c.doc_id AND b.ord <> {FULL_NAME.order} AND b.type NOT IN ({", ".join(repr(t) for t in AFTER_NAMES)})
      AND b.s < c.s + length(c.text) AND c.s < b.s + length(b.text))"""


@query(resolved_sql([*CATALOGUE, FULL_NAME], _planted_sql(SENTENCES), unicode=True, where=_NO_NAME_OVERLAP) + " SELECT doc_id, s AS span_start, e AS span_end, type AS span_type, text AS span_text FROM kept")
def planted_spans(spark, sf_dir):
    """The whole catalogue, full names too, over sentences in Cyrillic."""
    return exploded(PatternDetector().detect(planted(spark, sf_dir, SENTENCES)))


def rule_candidates_sql(source: str) -> str:
    """CTEs that end in ``cand``: the token rules over each document's tokens by row numbers."""
    tests = {
        "lower": lambda c, v: f"lower({c}) IN ({', '.join(repr(x) for x in v)})",
        "text": lambda c, v: f"{c} IN ({', '.join(repr(x) for x in v)})",
        "number": lambda c, _: f"(regexp_matches({c}, '{tokens.NUMBER}') OR lower({c}) IN ({', '.join(repr(x) for x in NUMERALS)}))",
        "letters": lambda c, _: f"regexp_matches({c}, '{tokens.LETTERS}')",
    }
    regex, longest = tokens.TOKEN.replace("'", "''"), max(len(row) for _, row in TOKEN_RULES)
    rules = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS ord, 1 AS prio, '{type_}' AS type, substr(t, s + 1, e{len(row) - 1} - s) AS text, s FROM tok WHERE {' AND '.join(tests[kind](f't{k}', v) for k, (kind, v) in enumerate(row))}" for n, (type_, row) in enumerate(TOKEN_RULES)
    )
    lead = lambda c, k: f"{c} AS {{}}0" if k == 0 else f"lead({c}, {k}) OVER w AS {{}}{k}"
    ahead = ", ".join(lead("token", k).format("t") + ", " + lead("s + length(token)", k).format("e") for k in range(longest))
    return f"""src AS ({source}),
    cut AS (SELECT doc_id, t, regexp_extract_all(t, '{regex}') AS m, string_split_regex(t, '{regex}') AS g FROM src WHERE t IS NOT NULL),
    one AS (SELECT doc_id, t, i, m[i] AS token, length(g[i]) AS gap FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM cut)),
    pos AS (SELECT doc_id, t, i, token, (sum(gap + length(token)) OVER (PARTITION BY doc_id ORDER BY i) - length(token))::BIGINT AS s FROM one),
    tok AS (SELECT doc_id, t, s, {ahead} FROM pos WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    cand AS ({rules})"""


_RULE_SPANS = " SELECT doc_id, s AS span_start, e AS span_end, type AS span_type, text AS span_text FROM kept"


@query(resolved_sql([], by_length=True, cand=rule_candidates_sql(_planted_sql(RULED, whole=True))) + _RULE_SPANS)
def planted_token_rules(spark, sf_dir):
    """All token rules over the documents' tokens, a sentence in Cyrillic at the end of each."""
    return exploded(TokenRuleDetector().detect(planted(spark, sf_dir, RULED, whole=True)))


_RECOGNISED = [Pattern(t, r, False, n) for n, (t, r) in enumerate((t, r) for t, _, rs in RECOGNISERS for r in rs)]
_LIKELY = f"type <> 'PERSON' OR (text NOT IN ({', '.join(repr(t) for t in NOT_NAMES)}) AND len(string_split_regex(trim(text), '\\s+')) <= {MOST_NAME_WORDS})"


@query(
    resolved_sql(_RECOGNISED, _planted_sql(RULED), by_length=True, unicode=True, where=_LIKELY)
    + " SELECT doc_id, s AS span_start, e AS span_end, type AS span_type, text AS span_text, CASE type WHEN 'PERSON' THEN 0.85 WHEN 'PHONE_NUMBER' THEN 0.9 ELSE 0.95 END::DOUBLE AS score FROM kept"
)
def planted_recognisers(spark, sf_dir):
    """All recognisers, of names too, over sentences in Cyrillic."""
    return scored(RecogniserDetector().detect(planted(spark, sf_dir, RULED)))


def scored(df: DataFrame) -> DataFrame:
    rows = df.select("doc_id", F.explode("spans").alias("s"))
    return rows.select("doc_id", F.col("s.start").cast("long").alias("span_start"), F.col("s.end").cast("long").alias("span_end"), F.col("s.type").alias("span_type"), F.col("s.text").alias("span_text"), "s.score")


@query(
    resolved_sql([p for p in _RECOGNISED if p.type != "PERSON"], by_length=True)
    + " SELECT doc_id, s AS span_start, e AS span_end, type AS span_type, text AS span_text, CASE type WHEN 'PHONE_NUMBER' THEN 0.9 ELSE 0.95 END::DOUBLE AS score FROM kept"
)
def recogniser_spans(spark, sf_dir):
    return scored(RecogniserDetector().detect(table(spark, sf_dir, "documents")))


@query(resolved_sql([], by_length=True, cand=rule_candidates_sql("SELECT doc_id, text AS t FROM documents")) + _RULE_SPANS)
def token_rule_spans(spark, sf_dir):
    return exploded(TokenRuleDetector().detect(table(spark, sf_dir, "documents")))


@query(
    "SELECT doc_id, md5("
    + "replace(" * 6
    + r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
    + "".join(f", '{m * 2}', '{m}')" for m in texts.DOUBLES)
    + ") AS normal_md5 FROM documents"
)
def normalised_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(texts.normalise(F.col("text"))).alias("normal_md5"))


@query(
    """WITH RECURSIVE src AS (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark),
    tok AS (SELECT item_id, text, i, len(w) AS n, w[i] AS token, CASE WHEN regexp_matches(w[i], '^[A-Z]') THEN 'B' WHEN i > 1 AND regexp_matches(w[i - 1], '^[A-Z]') THEN 'I' ELSE 'O' END AS tag
            FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM src)),
    fold(item_id, i, used, os, oe, cs, ce) AS (
      SELECT item_id, 0::BIGINT, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM src
      UNION ALL
      SELECT item_id, i, CASE WHEN hit THEN e ELSE used END, CASE WHEN hit AND tag = 'B' THEN p WHEN tag = 'I' THEN os END, CASE WHEN hit THEN e WHEN tag = 'I' THEN oe END,
             CASE WHEN tag <> 'I' THEN os END, CASE WHEN tag <> 'I' THEN oe END
      FROM (SELECT *, p + length(token) AS e, length(token) > 0 AND p >= 0 AND (tag = 'B' OR (tag = 'I' AND os IS NOT NULL)) AS hit
            FROM (SELECT f.item_id, k.i, f.used, f.os, f.oe, k.tag, k.token, CASE WHEN strpos(substr(k.text, f.used + 1), k.token) > 0 THEN f.used + strpos(substr(k.text, f.used + 1), k.token) - 1 ELSE -1 END AS p
                  FROM fold f JOIN tok k ON k.item_id = f.item_id AND k.i = f.i + 1))
    ), done AS (
      SELECT item_id, cs AS s, ce AS e FROM fold WHERE cs IS NOT NULL
      UNION ALL SELECT f.item_id, f.os, f.oe FROM fold f JOIN src ON src.item_id = f.item_id AND f.i = len(src.w) WHERE f.os IS NOT NULL
    )
    SELECT item_id, s AS span_start, e AS span_end, 'PERSON' AS span_type, substr(src.text, s + 1, e - s) AS span_text FROM done JOIN src USING (item_id)"""
)
def bio_spans(spark, sf_dir):
    """Words tagged by their capitals, decoded to spans."""
    words = table(spark, sf_dir, "benchmark").select("item_id", "text", F.split("text", " ").alias("tokens"))
    tags = F.transform("tokens", lambda w, i: F.when(F.regexp_like(w, F.lit("^[A-Z]")), "B-PER").when(F.get("tokens", i - 1).rlike("^[A-Z]"), "I-PER").otherwise("O"))
    tagged = words.withColumn("tags", tags).withColumn("spans", decode_bio(F.col("text"), F.col("tokens"), F.col("tags")))
    return exploded(tagged, "item_id")


HINTED = " меня зовут Анна Ким работаю в ООО Рога потом живу у реки Омь"


def _hint_sql(hints: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(before), '{h}')" for h in hints) + ")"


@query(
    f"""WITH t AS (SELECT conv_id, turn, regexp_replace(coalesce(text, '') || CASE WHEN conv_id % 5 = 0 THEN '{HINTED}' ELSE '' END, '^\\s+|\\s+$', '', 'g') AS t FROM conversations),
    w AS (SELECT conv_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, string_split_regex(t, '\\s+') AS w FROM t)),
    b AS (SELECT conv_id, w[i] AS word, array_to_string(w[greatest(1, i - 3):i - 1], ' ') AS before FROM w)
    SELECT conv_id, count(*) FILTER (WHERE regexp_matches(word, '^\\p{{Lu}}') AND length(word) >= 2 AND {_hint_sql(texts.NAME_HINTS)}) AS name,
           count(*) FILTER (WHERE lower(word) IN ({", ".join(repr(f) for f in texts.ORGANISATION_FORMS)}) OR {_hint_sql(texts.ORGANISATION_HINTS)}) AS organisation,
           count(*) FILTER (WHERE {_hint_sql(texts.PLACE_HINTS)}) AS place, count(*) AS words FROM b GROUP BY conv_id"""
)
def context_hints(spark, sf_dir):
    """Words with a context, a phrase with hints planted in every fifth conversation."""
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("conv_id") % 5 == 0, HINTED).otherwise(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(texts.hints(text)).alias("h"))
    return rows.groupBy("conv_id").agg(*[F.count_if(f"h.{k}").alias(k) for k in ("name", "organisation", "place")], F.count(F.lit(1)).alias("words"))


@query(
    _COUNTED
    + """, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE n > 0) AS pd, sum(n)::BIGINT AS e, avg(length(text)) AS mean, min(length(text)) AS low, max(length(text)) AS high FROM c)
    SELECT 0 AS line_no, printf('dialogs: %d', n) AS line FROM s UNION ALL SELECT 1, printf('with personal data: %d (%.1f%%)', pd, 100.0::DOUBLE * pd / n) FROM s
    UNION ALL SELECT 2, printf('entities: %d', e) FROM s UNION ALL SELECT 3, printf('entities a dialog: %.1f', e::DOUBLE / n) FROM s
    UNION ALL SELECT 4, printf('characters a dialog: %.0f, %d to %d', mean, low, high) FROM s
    UNION ALL SELECT (4 + row_number() OVER (ORDER BY type))::INTEGER, printf('  %s: %d (%.1f%%)', type, n, 100.0::DOUBLE * n / (SELECT e FROM s)) FROM (SELECT type, count(*) AS n FROM kept GROUP BY type)"""
)
def dataset_report(spark, sf_dir):
    return datasets.report_lines(dialogs(spark, sf_dir))


@query(
    """WITH p AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS place, count(*) OVER () AS n FROM documents)
    SELECT (place - 1) // 50 + 1 AS shard, 'documents.' || ((place - 1) // 50 + 1) AS name, count(*) AS total_dialogs,
           min(place) || '-' || max(place) AS dialog_range, md5(string_agg(doc_id || ':' || coalesce(text, ''), chr(10) ORDER BY place)) AS dialogs_md5
    FROM p GROUP BY (place - 1) // 50"""
)
def shard_documents(spark, sf_dir):
    """Documents of 50 dialogs each with their metadata, read back from their text."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.array().cast(f"array<{datasets.ENTITY}>").alias("entities"), F.lit(False).alias("has_pd"), F.lit("").alias("description"))
    made = dialog_files.shard_documents(datasets.shards(rows), "documents")
    shape = "struct<metadata:struct<total_dialogs:long,dialog_range:string>,dialogs:array<struct<id:long,text:string>>>"
    read = made.select("shard", "name", F.from_json("document", shape).alias("d"))
    line = F.transform("d.dialogs", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), F.coalesce(x["text"], F.lit(""))))
    return read.select("shard", "name", "d.metadata.total_dialogs", "d.metadata.dialog_range", F.md5(F.array_join(line, "\n")).alias("dialogs_md5"))


@query(
    ALL_SQL
    + """, e AS (SELECT doc_id, string_agg(s || '-' || e || ' ' || type || ' ' || text, '|' ORDER BY s) AS listed FROM kept GROUP BY doc_id)
    SELECT row_number() OVER (ORDER BY d.doc_id) - 1 AS pos, d.doc_id AS id, md5(coalesce(d.text, '')) AS text_md5, coalesce(e.listed, '') AS entities, e.listed IS NOT NULL AS has_pd, coalesce(d.lang, '') AS description
    FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id"""
)
def dialog_file(spark, sf_dir):
    """All documents with their entities as one dialog document, which many tasks write and read back."""
    rows = dialogs(spark, sf_dir).withColumn("description", F.coalesce("lang", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    path = new_folder(spark, "dialog-file")
    dialog_files.write_document(rows, {"model_used": "none"}, path)
    listed = F.transform("entities", lambda e: F.concat(e["start"].cast("string"), F.lit("-"), e["end"].cast("string"), F.lit(" "), e["type"], F.lit(" "), e["text"]))
    read = dialog_files.read_large_dialogs(spark, path, in_parts=True)
    return read.select(F.col("pos").cast("long").alias("pos"), "id", F.md5("text").alias("text_md5"), F.array_join(listed, "|").alias("entities"), "has_pd", "description")

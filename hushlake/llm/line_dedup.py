"""Operator 8: drop lines that many documents hold.

Lines are normalised, hashed and exploded; each hash counts its documents; the positions of frequent
lines are gathered for each document, and the other lines are joined again by position. Only
hashes and positions are exploded, so a text is shuffled once. DataFrame functions only.

Defined results: a null or empty text is one empty line; every row is a document of its own, also where
rows share a doc_id or a text; a key shorter than ``min_chars`` is never dropped; an empty table stays
empty; input columns that bear an output's name are replaced, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import names_without
from .text import SPACE, ascii_lower

OUTPUT = ["n_lines", "n_dropped", "kept_text"]


def _keys(text: Column, min_chars: int) -> Column:
    """The hash of each line's key, in order; null for keys that are too short."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1)

    def key(line: Column) -> Column:
        bare = F.btrim(line, F.lit(SPACE))
        return F.when(F.length(bare) >= min_chars, F.md5(bare))

    return F.transform(lines, key)


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` (doc_id, text, ...) with n_lines, n_dropped and kept_text.

    A line goes, in every document, if its key is found in ``min_docs`` documents or more. Rows are
    known by their doc_id and a hash of their text: equal rows have equal results.
    """
    known = docs.select(F.col("doc_id").alias("k1"), F.xxhash64("text").alias("k2"), F.col("text").alias("t"))
    keys = known.select("k1", "k2", _keys(F.col("t"), min_chars).alias("keys"))
    frequent = (
        keys.select(F.explode(F.array_distinct("keys")).alias("key"))
        .where("key IS NOT NULL")
        .groupBy("key")
        .count()
        .where(F.col("count") >= min_docs)
        .select("key")
    )
    dropped = (
        keys.select("k1", "k2", F.posexplode("keys").alias("pos", "key"))
        .where("key IS NOT NULL")
        .join(frequent, "key", "left_semi")
        .groupBy("k1", "k2")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("k1"), F.xxhash64("text").alias("k2")
    )
    same = F.col("a.k1").eqNullSafe(F.col("b.k1")) & (F.col("a.k2") == F.col("b.k2"))
    joined = rows.alias("a").join(dropped.alias("b"), same, "left")
    text = F.coalesce(F.col("row.text"), F.lit(""))
    lines = joined.select("row", "dropped", F.split(text, "\n", -1).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    out = lines.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")).alias("kept_text"),
    )
    stay = [F.col("row").getField(c).alias(c) for c in names_without(docs, OUTPUT)]
    return out.select(*stay, *OUTPUT)


def op8_sql(min_docs: int = 10, min_chars: int = 1) -> str:
    """DuckDB SQL for the query's rows."""
    return f"""
    WITH line AS (
      SELECT d.rid, u.pos, u.line, trim(translate(u.line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
      FROM (SELECT row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents) d,
           LATERAL (SELECT unnest(string_split(d.t, chr(10))) AS line, generate_subscripts(string_split(d.t, chr(10)), 1) AS pos) u
    ), frequent AS (
      SELECT k FROM line WHERE length(k) >= {min_chars} GROUP BY k HAVING count(DISTINCT rid) >= {min_docs}
    ), judged AS (
      SELECT line.*, frequent.k IS NOT NULL AS gone FROM line LEFT JOIN frequent ON line.k = frequent.k
    ), kept AS (
      SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
             sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
      FROM judged GROUP BY rid
    )
    SELECT d.doc_id, kept.n_lines, kept.n_dropped, kept.kept_sha256
    FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) d JOIN kept USING (rid)"""

"""Operator 5: mix sources to target weights by Poisson replication.

A source's rate is the mean number of copies of each of its documents with which it has its share of
the mixture. Each document draws its count by inverting the Poisson distribution at a hash of the
seed, its id and its text, is exploded to that many copies, and all copies are dealt out by another hash: a global
shuffle that any run repeats. DataFrame functions only.

A rate above ``STEP`` is drawn as a sum of independent draws of at most ``STEP``, so no rate is too large.

Defined results: a null source is a source of its own; a source without a weight, or with weight 0, has no
copies; rows that share a doc_id (or have none) and a text have the same number of copies; a null text counts as an empty one; an empty table
stays empty; input columns that bear an output's name are replaced, others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import names_without, written

OUTPUT = ["rate", "n_copies", "copy", "shuffle_key"]
#: Largest rate of one draw, and the counts that one draw can have: beyond, less than 2^-52 is left.
STEP, MOST = 16.0, 90


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from an MD5 hash of the parts: 52 bits, so that a double holds it exactly."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _thresholds(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ...: a draw u has as many copies as there are thresholds at or below it."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        total = acc["sum"] + p
        return F.struct(p.alias("p"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), start, add, lambda acc: acc["all"])


def source_rates(docs: DataFrame, weights: dict[str | None, float] | None, total: int | None) -> DataFrame:
    """Of each source: its rate, the number of draws, and one draw's thresholds. A row for each source.

    ``weights`` None: every source the same. ``total`` None: as many copies as there are documents.
    """
    # A row for each source, and their two sums.
    counts = written(docs.groupBy(F.col("source").alias("mix_source")).agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    if weights is None:
        weighed = counts.withColumn("weight", F.lit(1.0))
    else:
        named = docs.sparkSession.createDataFrame(list(weights.items()), "name string, weight double")
        weighed = counts.join(named, counts.mix_source.eqNullSafe(named.name), "left").drop("name").fillna({"weight": 0.0})
    n, of_weights = weighed.agg(F.sum("n"), F.sum("weight")).first()
    size = float(total if total is not None else n or 0)
    rate = F.coalesce(F.try_divide(F.col("weight") * F.lit(size), F.lit(of_weights or 0.0) * F.col("n")), F.lit(0.0))
    rated = weighed.select("mix_source", rate.alias("mix_rate"))
    draws = F.greatest(F.lit(1), F.ceil(F.col("mix_rate") / STEP)).cast("int")
    drawn = rated.withColumn("draws", draws)
    return drawn.withColumn("thresholds", _thresholds(F.col("mix_rate") / F.col("draws")))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, seed: int = 42) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) once for each copy, with rate, n_copies, copy (from 0) and shuffle_key, in random order.

    Rows are in ascending shuffle_key within each partition, and a key's partition is random too.
    """
    # A written table has a known size, so Spark broadcasts the rates if they are few and shuffles by source otherwise.
    rates = written(source_rates(docs, weights, total), "mix-rates")
    names = names_without(docs, OUTPUT)
    who = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit(""))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("source").alias("s"), who.alias("who"))
    joined = rows.join(rates, F.col("s").eqNullSafe(F.col("mix_source")), "left")

    def draw(acc: Column, k: Column) -> Column:
        u = uniform(F.lit(seed), F.col("who"), k)
        return acc + F.size(F.filter(F.col("thresholds"), lambda t: t <= u))

    count = F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), draw)
    counted = joined.select("row", "who", F.col("mix_rate").alias("rate"), count.alias("n_copies")).where("n_copies > 0")
    copies = counted.select("row", "who", "rate", "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    keyed = copies.withColumn("shuffle_key", uniform(F.lit(seed + 1), F.col("who"), F.col("copy")))
    dealt = keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in names], *OUTPUT)


def op5_sql(seed: int = 42) -> str:
    """DuckDB SQL for the query's rows: equal weights, as many copies as documents."""
    u = "CAST(CAST('0x' || substr(md5({}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
    who = "coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, '')) || '|'"
    one = u.format(f"'{seed}|' || {who} || k.k")
    two = u.format(f"'{seed + 1}|' || {who} || copy")
    return f"""
    WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    rate AS (
      SELECT source, n, 1.0::DOUBLE * (SELECT sum(n) FROM n)::DOUBLE / ((SELECT count(*) FROM n)::DOUBLE * n) AS rate FROM n
    ), steps AS (
      SELECT source, rate, greatest(1, ceil(rate / {STEP}))::INTEGER AS draws FROM rate
    ), cdf(source, rate, draws, k, p, total) AS (
      SELECT source, rate, draws, 0, exp(-(rate / draws)), exp(-(rate / draws)) FROM steps
      UNION ALL
      SELECT source, rate, draws, k + 1, p * (rate / draws) / (k + 1), total + p * (rate / draws) / (k + 1) FROM cdf WHERE k < {MOST}
    ), draw AS (
      SELECT d.rid, d.doc_id, d.source, s.rate, d.text, {one} AS u
      FROM (SELECT row_number() OVER () AS rid, * FROM documents) d
      JOIN steps s ON s.source IS NOT DISTINCT FROM d.source, LATERAL (SELECT unnest(range(1, s.draws + 1)) AS k) k
    ), counted AS (
      SELECT w.rid, any_value(w.doc_id) AS doc_id, any_value(w.source) AS source, any_value(w.rate) AS rate, any_value(w.text) AS text,
             count(*) FILTER (WHERE c.total <= w.u)::INTEGER AS n_copies
      FROM draw w JOIN cdf c ON c.source IS NOT DISTINCT FROM w.source GROUP BY w.rid
    ), copies AS (
      SELECT *, unnest(range(0, n_copies))::INTEGER AS copy FROM counted
    )
    SELECT doc_id, source, round(rate, 6) AS rate, n_copies, copy, {two} AS shuffle_key, md5(coalesce(text, '')) AS text_md5 FROM copies"""

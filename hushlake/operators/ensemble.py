"""Several detectors on the same rows: weighted consensus, union, and comparison.

All detectors add their spans to the row that holds the text: one scan, no shuffle, and texts need no key. Comparing detectors
then aggregates these rows once.

Defined results: a detector votes once for a span however often it finds it; a null text has no spans (null); rows are independent, so
repeated rows and keys do not matter; an empty table stays empty; all columns of the input stay, but for one named like the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans
from ..functions.rows import packed, unpacked
from .detectors import Detector

#: Weights of the detectors, in their order, and the share of all weights that a span needs.
WEIGHTS = {"natasha": 1.0, "spacy": 1.1, "bert": 1.3, "regexp": 0.7}
THRESHOLD = 0.4

VOTE = "struct<start:int,end:int,type:string,source_order:int,source:string,text:string>"
FOUND = f"array<struct<source:string,source_order:int,spans:array<{spans.SPAN}>,error:string>>"


def _by_detector(df: DataFrame, detectors: list[Detector], text: str) -> DataFrame:
    """The input's columns as ``row``, the text as ``t``, and ``found``: an array of each detector's source, source_order, spans and error."""
    rows = packed(df, t=F.col(f"`{text}`").cast("string"))
    for k, d in enumerate(detectors):
        rows = d.detect(rows, "t", f"spans{k}", f"error{k}")
    each = [F.struct(F.lit(d.name).alias("source"), F.lit(k).alias("source_order"), _plain(F.col(f"spans{k}")).alias("spans"), F.col(f"error{k}").alias("error")) for k, d in enumerate(detectors)]
    return rows.select("row", "t", F.array(*each).cast(FOUND).alias("found"))


def _plain(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(*[s[f].alias(f) for f in ("start", "end", "type", "text")]))


def votes(df: DataFrame, detectors: list[Detector], text: str = "text", out: str = "votes") -> DataFrame:
    """Adds every detector's spans in one array of start, end, type, source_order, source, text, in this order; each only once."""
    made = _by_detector(df, detectors, text)
    listed = F.transform(
        "found",
        lambda d: F.transform(
            F.coalesce(d["spans"], F.array().cast(f"array<{spans.SPAN}>")),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), d["source_order"].alias("source_order"), d["source"].alias("source"), s["text"].alias("text")),
        ),
    )
    return unpacked(made, df.columns, {out: F.when(F.col("t").isNotNull(), F.array_sort(F.array_distinct(F.flatten(listed))).cast(f"array<{VOTE}>"))})


def agreed(all_votes: Column, weights: dict[str, float], threshold: float = THRESHOLD) -> Column:
    """Candidates whose voters hold the threshold's share of all registered weights; the heaviest voter's text is taken, the first one's if there are several.

    ``all_votes`` are sorted, so equal spans stand side by side, one detector's too; a source without a weight has weight 1.
    """
    total = sum(weights.values())
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    open_ = "struct<start:int,end:int,type:string,first:int,last:int,weight:double,heaviest:double,text:string>"
    start = F.struct(spans.none().alias("done"), F.lit(None).cast(open_).alias("now"))

    def closed(acc: Column) -> Column:
        now = acc["now"]
        one = F.struct(now["start"].alias("start"), now["end"].alias("end"), now["first"].alias("order"), F.lit(1).alias("priority"), now["type"].alias("type"), now["text"].alias("text"))
        return F.when(now.isNotNull() & (now["weight"] / F.lit(total) >= threshold), F.concat(acc["done"], F.array(one.cast(spans.CANDIDATE)))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        now, weight = acc["now"], F.coalesce(F.try_element_at(table, x["source"]), F.lit(1.0)).cast("double")
        same = F.coalesce((now["start"] == x["start"]) & (now["end"] == x["end"]) & (now["type"] == x["type"]), F.lit(False))
        again = same & (now["last"] == x["source_order"])
        new = F.struct(
            x["start"].alias("start"), x["end"].alias("end"), x["type"].alias("type"), F.when(same, now["first"]).otherwise(x["source_order"]).alias("first"), x["source_order"].alias("last"),
            F.when(same, now["weight"] + weight).otherwise(weight).alias("weight"),
            F.when(same, F.greatest(now["heaviest"], weight)).otherwise(weight).alias("heaviest"),
            F.when(same & (now["heaviest"] >= weight), now["text"]).otherwise(x["text"]).alias("text"),
        )
        return F.struct(F.when(same, acc["done"]).otherwise(closed(acc)).alias("done"), F.when(again, now).otherwise(new.cast(open_)).alias("now"))

    return F.aggregate(all_votes, start, step, closed)


def consensus(df: DataFrame, detectors: list[Detector], weights: dict[str, float] | None = None, threshold: float = THRESHOLD, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds the spans on which detectors agree by weight, leftmost-longest. ``weights`` None: WEIGHTS of the detectors that are there, else 1."""
    known = weights if weights is not None else {d.name: WEIGHTS.get(d.name, 1.0) for d in detectors}
    rows = packed(df, t=F.col(f"`{text}`").cast("string"))
    made = votes(rows, detectors, "t", "votes").withColumn("agreed", agreed(F.col("votes"), known, threshold))
    return unpacked(made, df.columns, {out: spans.plain(spans.resolve_by_length(F.col("agreed")))})


def union(df: DataFrame, detectors: list[Detector], text: str = "text", out: str = "spans") -> DataFrame:
    """Adds all detectors' spans, leftmost-longest, ties to the first detector."""
    rows = packed(df, t=F.col(f"`{text}`").cast("string"))
    each = lambda v: F.struct(v["start"].alias("start"), v["end"].alias("end"), v["source_order"].alias("order"), F.lit(1).alias("priority"), v["type"].alias("type"), v["text"].alias("text"))
    made = votes(rows, detectors, "t", "votes").withColumn("every", F.transform("votes", each).cast(f"array<{spans.CANDIDATE}>"))
    return unpacked(made, df.columns, {out: spans.plain(spans.resolve_by_length(F.col("every")))})


def analyse_texts(df: DataFrame, detectors: list[Detector], text: str = "text") -> DataFrame:
    """A row for each text and detector, also where nothing is found: the input's columns, source, n_spans, types (distinct, in order), error.

    Columns of these names are replaced.
    """
    made = _by_detector(df, detectors, text).select("row", F.explode("found").alias("d"))
    found = F.coalesce(F.col("d.spans"), F.array().cast(f"array<{spans.SPAN}>"))
    types = F.array_sort(F.array_distinct(F.transform(found, lambda s: s["type"])))
    return unpacked(made, df.columns, {"source": F.col("d.source"), "n_spans": F.size(found).cast("long"), "types": types, "error": F.col("d.error")})


def compare_detectors(df: DataFrame, detectors: list[Detector], text: str = "text") -> DataFrame:
    """For each detector: source, n_texts, n_spans, n_types, errors, spans_per_text, success_rate (0 for an empty table)."""
    listed = analyse_texts(df.select(F.col(f"`{text}`").alias("text")), detectors)
    counts = listed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum("n_spans").alias("n_spans"),
        F.size(F.array_distinct(F.flatten(F.collect_set("types")))).cast("long").alias("n_types"),  # as many sets as kinds of texts
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    names = df.sparkSession.createDataFrame([(d.name,) for d in detectors], "source string")
    out = names.join(counts, "source", "left").fillna(0, ["n_texts", "n_spans", "n_types", "errors"])
    share = lambda c: F.coalesce(F.try_divide(c, F.col("n_texts")), F.lit(0.0))
    return out.withColumn("spans_per_text", share(F.col("n_spans"))).withColumn("success_rate", share(F.col("n_texts") - F.col("errors")))


def described(detectors: list[Detector], weights: dict[str, float] | None = None, threshold: float | None = THRESHOLD) -> dict:
    """What an ensemble is made of: the number and names of its detectors, their weights, and whether and at what share they must agree."""
    known = weights if weights is not None else {d.name: WEIGHTS.get(d.name, 1.0) for d in detectors}
    return {"total_detectors": len(detectors), "available_detectors": [d.name for d in detectors], "weights": known, "consensus_enabled": threshold is not None, "consensus_threshold": threshold}

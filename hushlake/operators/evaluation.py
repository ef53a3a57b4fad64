"""Scoring predicted spans against annotated ones: exact, one character off, or by overlap; per type, micro and macro.

Spans are rows of scope, start, end, type. The scope is a document, or one constant for all of them ("pooled",
where equal spans of different texts collapse). Matching is one-to-one and greedy: gold spans in order of start and end take the best
prediction that is left. It is one ordered sweep: the spans of a scope and type are folded once in order of start, with only those spans in
memory that later ones can still reach. Where a scope has more spans than one task should read, they are first cut into islands where none
reaches into the next, and each island is folded. The number of jobs does not depend on how many spans wait for each other.

Defined results: repeated spans count once; spans without a scope, start, end or type match nothing, but count; rates of an empty side are 0.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spans
from ..scratch import ship, written
from . import ordered

KEYS = ["scope", "start", "end", "type"]
#: Fixed value: most characters between persons' spans that are one person.
NAME_GAP = 3
#: Spans of a scope and type that one task may read in order; more are cut into islands first.
MOST_IN_ORDER = 1_000_000


def span_rows(df: DataFrame, column: str = "spans", key: str = "doc_id", pooled: bool = False) -> DataFrame:
    """A row for each span of an array column."""
    scope = F.lit("*") if pooled else F.col(key).cast("string")
    return df.select(scope.alias("scope"), F.explode(column).alias("s")).select("scope", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "s.type")


def overlap_score(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over union of two spans of one type."""
    both = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return F.coalesce(F.try_divide(both.cast("double"), (a_end - a_start + b_end - b_start - both).cast("double")), F.lit(0.0))


def near(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """At most one character apart, counting both ends."""
    return F.abs(a_start - b_start) + F.abs(a_end - b_end) <= 1


MATCH = "scope string, type string, start long, end long, p_start long, p_end long"


def overlap(gold: tuple[int, int], predicted: tuple[int, int]) -> float:
    """``overlap_score`` of two spans that share a character; below 0 for others."""
    both = min(gold[1], predicted[1]) - max(gold[0], predicted[0])
    return both / (gold[1] - gold[0] + predicted[1] - predicted[0] - both) if both > 0 else -1.0


def nearness(gold: tuple[int, int], predicted: tuple[int, int]) -> float:
    """0 for spans that are ``near``; below 0 for others."""
    return 0.0 if abs(gold[0] - predicted[0]) + abs(gold[1] - predicted[1]) <= 1 else -1.0


class Sweep:
    """Greedy matches of one island's spans, which come in order of start and end.

    A gold span waits until no later span can be its match, and until those before it are settled. A prediction is forgotten once it lies
    behind all gold spans to come.
    """

    def __init__(self, threshold: float):
        self.score, self.least = (overlap, threshold) if threshold < 1.0 else (nearness, 0.0)
        self.reach = (lambda s: s[1]) if threshold < 1.0 else (lambda s: s[0] + 2)
        self.waiting: deque[tuple[int, int]] = deque()
        self.free: list[tuple[int, int]] = []
        self.most = 4

    def add(self, span: tuple[int, int], gold: bool, predicted: bool) -> Iterator[tuple[int, int, int, int]]:
        """Takes the next span in; gives the matches that are settled before it."""
        yield from self.settle(span[0])
        if gold:
            self.waiting.append(span)
        if predicted:
            self.free.append(span)

    def settle(self, at: float = math.inf) -> Iterator[tuple[int, int, int, int]]:
        """Matches of all gold spans that spans from ``at`` on cannot reach."""
        while self.waiting and self.reach(self.waiting[0]) <= at:
            gold = self.waiting.popleft()
            best, found = self.least, None
            for p in self.free:  # in order, so that the first of equal scores stays
                score = self.score(gold, p)
                if score > best or score == best and found is None:
                    best, found = score, p
            if found is not None:
                self.free.remove(found)
                yield (*gold, *found)
        if len(self.free) > self.most:  # what lies behind matches nothing: it is dropped when the list has doubled
            behind = min(at, self.waiting[0][0]) if self.waiting else at
            self.free = [p for p in self.free if self.reach(p) > behind]
            self.most = 2 * len(self.free) + 4


def _swept(spans_: DataFrame, threshold: float) -> DataFrame:
    """One-to-one matches of distinct spans (KEYS, gold, predicted): each gold span in order takes its best free prediction, then the first."""
    ship(spans_.sparkSession)
    reach = F.col("end") if threshold < 1.0 else F.col("start") + 2
    whole = spans_.where(" AND ".join(f"`{k}` IS NOT NULL" for k in KEYS))
    # At most a row for each MOST_IN_ORDER spans, and mostly none.
    large = whole.groupBy("scope", "type").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_IN_ORDER).select("scope", "type").collect()
    found = _folded(whole, [], threshold)
    if large:
        known = F.broadcast(whole.sparkSession.createDataFrame(large, "scope string, type string"))
        rows = ordered.islands(whole.join(known, ["scope", "type"], "left_semi").withColumn("reach", reach), ["scope", "type"], ["start", "end"], "reach")
        cut = _folded(rows.select(F.col("island.part").alias("a"), F.col("island.number").alias("b"), *KEYS, "gold", "predicted"), ["a", "b"], threshold)
        found = _folded(whole.join(known, ["scope", "type"], "left_anti"), [], threshold).unionByName(cut)
    return found


def _folded(rows: DataFrame, island: list[str], threshold: float) -> DataFrame:
    """The matches of each island, or of each scope and type, by one sweep in order."""
    group = island or ["scope", "type"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, sweep, scope, type_ = None, Sweep(threshold), None, None
        for batch in batches:
            found, columns = [], {c: batch[c].tolist() for c in batch.columns}
            keys = zip(*[columns[c] for c in group], strict=True)
            for key, new_scope, start, end, new_type, side in zip(keys, *[columns[c] for c in (*KEYS, "side")], strict=True):
                if key != of:
                    found += [(scope, type_, *m) for m in sweep.settle()]
                    of, sweep, scope, type_ = key, Sweep(threshold), new_scope, new_type
                found += [(scope, type_, *m) for m in sweep.add((start, end), side & 1 == 1, side & 2 == 2)]
            yield pd.DataFrame(found, columns=["scope", "type", "start", "end", "p_start", "p_end"])
        yield pd.DataFrame([(scope, type_, *m) for m in sweep.settle()], columns=["scope", "type", "start", "end", "p_start", "p_end"])

    sides = rows.select(*island, *KEYS, (F.col("gold") + 2 * F.col("predicted")).cast("int").alias("side"))
    return sides.repartition(*group).sortWithinPartitions(*group, "start", "end").mapInPandas(fold, MATCH)


def _labelled(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Each distinct span with whether it is in gold and in predicted, as a written table: what makes the spans runs once."""
    sides = gold.select(*KEYS, F.lit(1).alias("gold"), F.lit(0).alias("predicted")).unionByName(predicted.select(*KEYS, F.lit(0).alias("gold"), F.lit(1).alias("predicted")))
    return written(sides.groupBy(KEYS).agg(F.max("gold").alias("gold"), F.max("predicted").alias("predicted")), "labelled")


def _not_exact(both: DataFrame, threshold: float) -> DataFrame:
    """Greedy matches: of spans without an exact partner at threshold 1, and of all spans below."""
    return _swept(both if threshold < 1.0 else both.where("gold <> predicted"), threshold)


def match_spans(gold: DataFrame, predicted: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Matched spans: scope, type, start, end of the gold span, p_start, p_end. At threshold 1: exact ones, then near ones; below: by overlap.
    """
    both = _labelled(gold, predicted)
    found = _not_exact(both, threshold)
    if threshold < 1.0:
        return found
    exact = both.where("gold = 1 AND predicted = 1").select("scope", "type", "start", "end", F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    return exact.unionByName(found)


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    with_pr = df.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    return with_pr.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


RATES, COUNTS = ["precision", "recall", "f1"], ["tp", "fp", "fn", "total_true", "total_pred"]
METRICS = ["entity_type", *RATES, *COUNTS, "class_proportion"]


def metrics_by_type(gold: DataFrame, predicted: DataFrame, threshold: float = 1.0) -> DataFrame:
    """A row for each type in either, then ALL_MICRO and ALL_MACRO. Macro rates are means over types with gold spans."""
    both = _labelled(gold, predicted)
    exact = F.sum(F.col("gold") * F.col("predicted")) if threshold >= 1.0 else F.lit(0).cast("long")
    totals = both.groupBy("type").agg(F.sum("gold").alias("total_true"), F.sum("predicted").alias("total_pred"), exact.alias("exact"))
    matched = _not_exact(both, threshold).groupBy("type").agg(F.count(F.lit(1)).alias("more"))
    joined = totals.join(matched, "type", "left").fillna(0).withColumn("tp", F.col("exact") + F.col("more"))
    counts = joined.select(F.col("type").alias("entity_type"), "tp", (F.col("total_pred") - F.col("tp")).alias("fp"), (F.col("total_true") - F.col("tp")).alias("fn"), "total_true", "total_pred")
    # One plan for all rows: each type counts for itself and for the whole, and a row of zeros keeps the whole there when nothing was found.
    zeros = counts.sparkSession.range(1).select(F.lit(None).cast("string").alias("entity_type"), *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    types = _rates(counts.select("entity_type", *COUNTS).unionByName(zeros))
    grains = F.when(F.col("entity_type").isNull(), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))
    spread = types.withColumn("whole", F.explode(grains)).withColumn("grain", F.when(~F.col("whole"), F.col("entity_type")))
    means = [F.coalesce(F.avg(F.when(F.col("total_true") > 0, F.col(c))), F.lit(0.0)).alias(f"mean_{c}") for c in RATES]
    summed = _rates(spread.groupBy("whole", "grain").agg(*[F.sum(c).alias(c) for c in COUNTS], *means))
    all_true = F.max(F.when(F.col("whole"), F.col("total_true"))).over(Window.partitionBy(F.lit(0)))  # a row for each type
    share = F.coalesce(F.try_divide(F.col("total_true").cast("double"), all_true.cast("double")), F.lit(0.0))

    def row(name: Column, prefix: str, proportion: Column) -> Column:
        return F.struct(name.alias("entity_type"), *[F.col(prefix + c).alias(c) for c in RATES], *[F.col(c) for c in COUNTS], proportion.alias("class_proportion"))

    one = F.array(row(F.col("grain"), "", F.col("share")))
    both_means = F.array(row(F.lit("ALL_MICRO"), "", F.lit(1.0)), row(F.lit("ALL_MACRO"), "mean_", F.lit(1.0)))
    return summed.withColumn("share", share).select(F.inline(F.when(F.col("whole"), both_means).otherwise(one))).select(METRICS)


def overall_metrics(gold: DataFrame, predicted: DataFrame, threshold: float = 1.0) -> DataFrame:
    """One row of precision, recall, f1, tp, fp, fn."""
    return metrics_by_type(gold, predicted, threshold).where("entity_type = 'ALL_MICRO'").select("precision", "recall", "f1", "tp", "fp", "fn")


def merge_names(found: Column) -> Column:
    """PERSON spans that follow each other with a gap of at most three characters become one; values are joined unless one ends with the next."""
    shape = spans.SPAN
    start = F.struct(F.array().cast(f"array<{shape}>").alias("done"), F.lit(None).cast(shape).alias("last"))
    ordered = F.array_sort(F.transform(found, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["end"].alias("end"), s["type"].alias("type"), s["text"].alias("text"))))

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        joins = (x["type"] == "PERSON") & (last["type"] == "PERSON") & (x["start"] <= last["end"] + NAME_GAP)
        value = F.when(F.endswith(last["text"], x["text"]), last["text"]).otherwise(F.concat_ws(" ", last["text"], x["text"]))
        both = F.struct(last["start"].alias("start"), x["end"].alias("end"), F.lit("PERSON").alias("type"), F.trim(value).alias("text"))
        alone = F.struct(*[x[f].alias(f) for f in ("start", "end", "type", "text")])
        joins = F.coalesce(joins, F.lit(False))
        done = F.when(last.isNotNull() & ~joins, F.concat(acc["done"], F.array(last))).otherwise(acc["done"])
        return F.struct(done.alias("done"), F.when(joins, both).otherwise(alone).cast(shape).alias("last"))

    return F.aggregate(ordered, start, step, lambda acc: F.when(acc["last"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["last"]))))


def trim_ages(found: Column, text: Column) -> Column:
    """AGE spans cut down to the number and its unit, at the first place from the span's start on."""

    def one(s: Column) -> Column:
        age = F.regexp_extract(s["text"], r"(?U)\d+\s*лет", 0)
        at = F.call_function("locate", age, text, s["start"] + 1) - 1
        cut = F.struct(at.alias("start"), (at + F.length(age)).alias("end"), s["type"].alias("type"), age.alias("text"))
        plain = F.struct(*[s[f].alias(f) for f in ("start", "end", "type", "text")])
        return F.when((s["type"] == "AGE") & (age != "") & (at >= 0), cut).otherwise(plain)

    return F.transform(found, one)


def name_islands(rows: DataFrame) -> DataFrame:
    """``merge_names`` for span rows (scope, start, end, type, ...) as gaps and islands: scope, type, start, end, members.

    Equal spans are counted first, and no window runs over a scope: a scope may hold any number of spans.
    """
    counted = rows.groupBy("scope", "start", "end", "type").agg(F.count(F.lit(1)).alias("n"))
    is_name = F.col("type") == "PERSON"
    reach = F.when(is_name, F.col("end") + NAME_GAP)
    found = ordered.islands(counted.withColumn("reach", reach), ["scope"], ["start", "end", "type"], "reach", is_name & (F.col("start") <= F.col("reached")), furthest=False)
    # Equal spans that do not join each other are islands of their own.
    apart = F.when(F.coalesce(is_name & (F.col("start") <= F.col("end") + NAME_GAP), F.lit(False)), F.lit(1)).otherwise(F.col("n"))
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), apart.cast("long")))).withColumn("n", F.when(apart == 1, F.col("n")).otherwise(1))
    grouped = each.groupBy("scope", ordered.ISLAND, "copy")
    return grouped.agg(F.first("type").alias("type"), F.min("start").alias("start"), F.max_by("end", F.struct(ordered.PART, ordered.PLACE)).alias("end"), F.sum("n").alias("members")).drop(ordered.ISLAND, "copy")


def ranking(metrics: DataFrame) -> DataFrame:
    """Methods by micro F1, best first; ``metrics`` has a ``method`` column."""
    return metrics.where("entity_type = 'ALL_MICRO'").orderBy(F.desc("f1"), "method")

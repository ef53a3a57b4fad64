"""Detectors: each adds a column of resolved spans to a DataFrame.

Rule detectors are Spark expressions. Model detectors take any Python callable over a list of texts; it is made
once in each Python worker and called with the texts of an Arrow batch at a time.

Defined results: the spans of a null text are null, those of an empty text are none; rows are independent, so repeated rows and keys
do not matter; an empty table stays empty. All columns of the input stay, but for one named like an output, which is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels, spans, tokens
from ..functions.patterns import AFTER_NAMES, CATALOGUE, FULL_NAME, FULL_NAME_ABOVE, GUARDS, PRIORITY, RECOGNISERS, TOKEN_RULES, Pattern
from ..functions.rows import packed, unpacked
from ..functions.text import first_place, likely_name, normalise
from ..scratch import ship

PREDICTION = "array<struct<start:int,end:int,label:string,score:double,text:string>>"
Predict = Callable[[list[str]], list[list[dict]]]


class Detector:
    """``detect`` adds ``out``, an array of spans in order and apart, and ``error`` if it is named: why the detector failed on the text, or null."""

    name = "detector"

    def found(self, rows: DataFrame) -> tuple[DataFrame, Column, Column]:
        """From rows with a text ``t`` the rows with more columns, and the spans and the error as expressions over them."""
        raise NotImplementedError

    def detect(self, df: DataFrame, text: str = "text", out: str = "spans", error: str | None = None) -> DataFrame:
        made, value, failed = self.found(packed(df, t=F.col(f"`{text}`").cast("string")))
        return unpacked(made, df.columns, {out: value} | ({error: failed} if error else {}))


def _no_error() -> Column:
    return F.lit(None).cast("string")


def _guarded(rows: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Adds ``has_<guard>`` for the guards that patterns need, and ``w``, the windows of ``t`` (``spans.windows``) where one of them but the Cyrillic letters' holds.

    One scan shows which texts can have any of them at all. Patterns without Cyrillic letters are looked for in the windows only.
    """
    guards = [g for g in dict.fromkeys(p.guard for p in patterns) if g]
    in_windows = [g for g in guards if g != "cyrillic"]
    if in_windows:
        rows = rows.withColumn("live", spans.may_match(F.col("t")))
    for name in guards:
        string, regex = GUARDS[name]
        test = F.contains("t", F.lit(string)) if string else F.regexp_like("t", F.lit(regex))
        rows = rows.withColumn(f"has_{name}", F.col("live") & test if name in in_windows else test)
    if in_windows:
        found = F.col(f"has_{in_windows[0]}")
        for name in in_windows[1:]:
            found = found | F.col(f"has_{name}")
        rows = rows.withColumn("w", F.when(found, spans.windows(F.col("t"))))
    return rows


def _find(p: Pattern, priority: int = 1) -> Column:
    if not p.guard:
        return spans.find(F.col("t"), p.java, p.type, p.order, priority)
    hits = spans.find(F.col("t"), p.java, p.type, p.order, priority) if p.guard == "cyrillic" else spans.find_in(F.col("w"), p.java, p.type, p.order, priority)
    return F.when(~F.col(f"has_{p.guard}"), spans.none()).otherwise(hits)


@dataclass
class PatternDetector(Detector):
    """The pattern catalogue with overlaps resolved by the types' priority.

    ``keep_extent``: overlapping spans are merged instead, so that masking leaves no part of the weaker one visible.
    """

    aggressiveness: float = 0.8
    patterns: list[Pattern] = field(default_factory=lambda: CATALOGUE)
    types: list[str] | None = None
    keep_extent: bool = False
    name: str = "regexp"

    def found(self, rows: DataFrame) -> tuple[DataFrame, Column, Column]:
        chosen = [p for p in self.patterns if self.types is None or p.type in self.types]
        full = max(0.0, min(1.0, self.aggressiveness)) > FULL_NAME_ABOVE and (self.types is None or FULL_NAME.type in self.types)
        rows = _guarded(rows, [*chosen, *([FULL_NAME] if full else [])])
        hits = lambda ps: F.concat(spans.none(), *[_find(p, PRIORITY.get(p.type, 1)) for p in ps])
        before = rows.withColumn("before", hits([p for p in chosen if p.type not in AFTER_NAMES]))
        names = _find(FULL_NAME, PRIORITY[FULL_NAME.type]) if full else spans.none()
        both = before.withColumn("names", names).withColumn("after", hits([p for p in chosen if p.type in AFTER_NAMES]))
        apart = F.filter("names", lambda n: ~F.exists("before", lambda b: spans.overlaps(n, b)))
        resolve = spans.union_of_overlaps if self.keep_extent else spans.resolve_by_priority
        every = both.withColumn("every", F.concat("before", apart, "after"))
        value = F.when(F.size("every") == 0, spans.none(spans.SPAN)).otherwise(spans.plain(resolve(F.col("every"))))
        return every, F.when(F.col("t").isNotNull(), value), _no_error()


@dataclass
class RecogniserDetector(Detector):
    """Scored recognisers; ``out`` has a score too. Overlaps go to the longest of the leftmost.

    ``recognisers``: (type, score, regular expressions), tried in this order; PERSON matches must be likely names.
    """

    types: list[str] | None = None
    recognisers: list[tuple[str, float, list[str]]] = field(default_factory=lambda: RECOGNISERS)
    name: str = "recognisers"

    def found(self, rows: DataFrame) -> tuple[DataFrame, Column, Column]:
        patterns, scores = [], {}
        for type_, score, regexes in self.recognisers:
            if self.types is None or type_ in self.types:
                scores[type_] = score
                patterns += [Pattern(type_, regex, False, len(patterns) + n) for n, regex in enumerate(regexes)]
        rows = _guarded(rows, patterns)
        hits = [F.filter(_find(p), lambda h: likely_name(h["text"])) if p.type == "PERSON" else _find(p) for p in patterns]
        table = F.create_map(*[F.lit(x) for pair in (scores or {"": 0.0}).items() for x in pair])
        every = rows.withColumn("every", F.concat(spans.none(), *hits))
        kept = F.transform(
            spans.resolve_by_length(F.col("every")),
            lambda s: F.struct(*[s[f].alias(f) for f in ("start", "end", "type", "text")], F.try_element_at(table, s["type"]).alias("score")),
        )
        return every, F.when(F.col("t").isNotNull(), kept), _no_error()


@dataclass
class TokenRuleDetector(Detector):
    """The token rules, leftmost-longest, ties to the first rule. Tokens are those of ``functions.tokens``."""

    rules: list[tokens.Rule] = field(default_factory=lambda: TOKEN_RULES)
    name: str = "spacy_rules"

    def candidates(self, rows: DataFrame) -> tuple[DataFrame, Column]:
        whole = F.struct(F.col("t").alias("text"), F.array(F.lit(0)).alias("shifts"))
        read = tokens.windows(F.col("t"), self.rules) if self.rules and tokens.anchors(self.rules) else whole
        rows = rows.withColumn("read", read)
        return rows, F.when(F.col("t").isNotNull(), tokens.find_rules(F.col("read"), self.rules))

    def found(self, rows: DataFrame) -> tuple[DataFrame, Column, Column]:
        rows, hits = self.candidates(rows)
        every = rows.withColumn("every", hits)
        return every, F.when(F.col("t").isNotNull(), spans.plain(spans.resolve_by_length(F.col("every")))), _no_error()


def _asked(model: Callable[[list[str]], list], texts: list[str], none) -> list[tuple[object, str | None]]:
    """A model's answer for each text. If it fails on all together, it is asked one by one; a text on which it fails has ``none`` and the error."""
    try:
        answers = list(model(texts)) if texts else []
        if len(answers) == len(texts):
            return [(a, None) for a in answers]
    except Exception:  # noqa: BLE001 - asked again below, where each failure is kept as the text's error
        pass
    out = []
    for t in texts:
        try:
            out.append((model([t])[0], None))
        except Exception as e:  # noqa: BLE001 - one text must not end the job: its error is a result
            out.append((none, f"{type(e).__name__}: {e}"))
    return out


def predictions(make: Callable[[], Predict], text: Column, batch: int = 64) -> Column:
    """A model's predictions for each text, as a struct of ``found`` and ``error``.

    ``make`` is called once in a worker, the model with ``batch`` texts at a time; null and empty texts are not sent.
    """

    ship(SparkSession.active())

    @F.pandas_udf(f"struct<found:{PREDICTION},error:string>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for series in batches:
            texts = series.tolist()
            sent, found, errors = [i for i, t in enumerate(texts) if t], [[] for _ in texts], [None] * len(texts)
            for k in range(0, len(sent), batch):
                part = sent[k : k + batch]
                for i, (rows, error) in zip(part, _asked(model, [texts[i] for i in part], []), strict=True):
                    t, errors[i] = texts[i], error
                    found[i] = [
                        {"start": int(r["start"]), "end": int(r["end"]), "label": r["label"], "score": float(r.get("score", 1.0)), "text": r.get("text", t[int(r["start"]) : int(r["end"])])}
                        for r in rows
                    ]
            yield pd.DataFrame({"found": found, "error": errors})

    return predict(text)


def _candidates(found: Column, mapper: Callable[[Column], Column], least_score: float | None, order: int = 0) -> Column:
    """Predictions whose label has a type and whose score is above the least, as candidates."""
    typed = F.transform(found, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(order).alias("order"), F.lit(1).alias("priority"), mapper(p["label"]).alias("type"), p["text"].alias("text"), p["score"].alias("score")))
    good = F.filter(typed, lambda c: c["type"].isNotNull() & (F.lit(True) if least_score is None else c["score"] > least_score))
    return F.transform(good, lambda c: F.struct(*[c[f].alias(f) for f in ("start", "end", "order", "priority", "type", "text")])).cast(f"array<{spans.CANDIDATE}>")


def _longest(rows: DataFrame, found: list[Column], errors: list[Column]) -> tuple[DataFrame, Column, Column]:
    """Leftmost-longest over several arrays of candidates; the errors that there are, joined."""
    every = rows.withColumn("every", F.concat(spans.none(), *found).cast(f"array<{spans.CANDIDATE}>"))
    failed = F.nullif(F.concat_ws("; ", *errors), F.lit("")) if errors else _no_error()
    return every, F.when(F.col("t").isNotNull(), spans.plain(spans.resolve_by_length(F.col("every")))), failed


@dataclass
class ModelDetector(Detector):
    """One model, or several whose spans are united: of equal spans the first model's wins.

    ``fallback`` makes the model of a worker in which a maker fails; without it, the maker's error ends the job.
    """

    makers: list[Callable[[], Predict]]
    labels: str = "bert"
    least_score: float | None = 0.5
    name: str = "bert"
    fallback: Callable[[], Predict] | None = None

    def found(self, rows: DataFrame) -> tuple[DataFrame, Column, Column]:
        for k, make in enumerate(self.makers):
            rows = rows.withColumn(f"model{k}", predictions(with_fallback(make, self.fallback), F.col("t")))
        every = range(len(self.makers))
        return _longest(rows, [_candidates(F.col(f"model{k}.found"), labels.MAPPERS[self.labels], self.least_score, k) for k in every], [F.col(f"model{k}.error") for k in every])


def with_fallback(make: Callable[[], Predict], fallback: Callable[[], Predict] | None) -> Callable[[], Predict]:
    """A maker that makes the fallback's model where ``make`` fails, as a blank model stands in for one that is not installed."""
    if fallback is None:
        return make

    def either() -> Predict:
        try:
            return make()
        except Exception:  # noqa: BLE001 - the caller has named what to use instead
            return fallback()

    return either


def blank_model() -> Predict:
    """A model that finds nothing."""
    return lambda texts: [[] for _ in texts]


@dataclass
class RulesAndModelDetector(Detector):
    """The token rules and a model's entities in one: leftmost-longest over both, ties to the model."""

    make: Callable[[], Predict]
    labels: str = "spacy"
    rules: list[tokens.Rule] = field(default_factory=lambda: TOKEN_RULES)
    name: str = "spacy"
    fallback: Callable[[], Predict] | None = field(default=lambda: blank_model())

    def found(self, rows: DataFrame) -> tuple[DataFrame, Column, Column]:
        rows = rows.withColumn("model", predictions(with_fallback(self.make, self.fallback), F.col("t")))
        rows, hits = TokenRuleDetector(self.rules).candidates(rows)
        return _longest(rows, [_candidates(F.col("model.found"), labels.MAPPERS[self.labels], None, -1), hits], [F.col("model.error")])


@dataclass
class StagedDetector(Detector):
    """Stages of one detector, each a model on the normalised or on the original text; a failing stage adds nothing but its error.

    Spans on the normalised text are moved to the first place where their text stands in the original.
    """

    stages: list[tuple[Callable[[], Predict], bool]]
    labels: str = "natasha"
    name: str = "natasha"

    def found(self, rows: DataFrame) -> tuple[DataFrame, Column, Column]:
        rows, found, text = rows.withColumn("normal", normalise(F.col("t"))), [], F.col("t")
        for k, (make, on_normalised) in enumerate(self.stages):
            rows = rows.withColumn(f"stage{k}", predictions(make, F.col("normal" if on_normalised else "t")))
            stage = _candidates(F.col(f"stage{k}.found"), labels.MAPPERS[self.labels], None, k)
            if on_normalised:
                placed = F.transform(stage, lambda c: F.struct(c.alias("c"), first_place(text, F.col("normal"), c["start"], c["end"]).alias("p")))
                stage = F.transform(
                    F.filter(placed, lambda x: x["p"].isNotNull()),
                    lambda x: F.struct(x["p"]["start"].alias("start"), x["p"]["end"].alias("end"), x["c"]["order"].alias("order"), x["c"]["priority"].alias("priority"), x["c"]["type"].alias("type"), F.substring(text, x["p"]["start"] + 1, x["p"]["end"] - x["p"]["start"]).alias("text")),
                )
            found.append(stage)
        return _longest(rows, found, [F.col(f"stage{k}.error") for k in range(len(self.stages))])


def decode_bio(text: Column, tokens: Column, tags: Column, mapper: Callable[[Column], Column] = labels.deeppavlov) -> Column:
    """Tokens with B-, I- and O tags as candidates, found in the text from left to right.

    A ``B-`` whose label has no type leaves the open span open; an ``I-`` of another type changes nothing; a token that
    is not found ahead is skipped.
    """
    open_ = "struct<start:int,end:int,type:string>"
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(open_).alias("open"), spans.none(open_).alias("done"))

    def step(acc: Column, pair: Column) -> Column:
        tag, token = pair["tag"], pair["token"]
        begins, inside = F.startswith(tag, F.lit("B-")), F.startswith(tag, F.lit("I-"))
        type_ = mapper(F.substring(tag, F.lit(3), F.length(tag)))
        place = F.call_function("locate", token, text, acc["at"] + 1) - 1
        found = (place >= 0) & (F.length(token) > 0)
        grows = inside & acc["open"].isNotNull() & (type_ == acc["open"]["type"]) & found
        opens = begins & type_.isNotNull() & found
        closes = (begins & type_.isNotNull()) | ~(begins | inside)
        end = place + F.length(token)
        new = F.struct(place.alias("start"), end.alias("end"), type_.alias("type")).cast(open_)
        longer = F.struct(acc["open"]["start"].alias("start"), end.alias("end"), acc["open"]["type"].alias("type")).cast(open_)
        return F.struct(
            F.when(opens | grows, end).otherwise(acc["at"]).alias("at"),
            F.when(opens, new).when(F.coalesce(grows, F.lit(False)), longer).when(closes, F.lit(None).cast(open_)).otherwise(acc["open"]).alias("open"),
            F.when(closes & acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    spans_ = F.aggregate(F.arrays_zip(tokens.alias("token"), tags.alias("tag")), start, step, finish)
    return F.transform(
        spans_,
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(0).alias("order"), F.lit(1).alias("priority"), s["type"].alias("type"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text")),
    ).cast(f"array<{spans.CANDIDATE}>")


@dataclass
class TaggerDetector(Detector):
    """Taggers that give tokens and BIO tags of each text; several are united."""

    makers: list[Callable[[], Callable[[list[str]], tuple[list, list]]]]
    name: str = "deeppavlov"

    def found(self, rows: DataFrame) -> tuple[DataFrame, Column, Column]:
        for k, make in enumerate(self.makers):
            rows = rows.withColumn(f"tags{k}", _tagged(make, F.col("t")))
        every = range(len(self.makers))
        return _longest(rows, [decode_bio(F.col("t"), F.col(f"tags{k}.tokens"), F.col(f"tags{k}.tags")) for k in every], [F.col(f"tags{k}.error") for k in every])


def _tagged(make, text: Column, batch: int = 64) -> Column:
    """A tagger's tokens and tags of each text, called and with errors as ``predictions``."""

    ship(SparkSession.active())

    @F.pandas_udf("struct<tokens:array<string>,tags:array<string>,error:string>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = make()
        pairs = lambda texts: list(zip(*tagger(texts), strict=True))
        for series in batches:
            texts = series.tolist()
            sent, rows = [i for i, t in enumerate(texts) if t], [([], [], None) for _ in texts]
            for k in range(0, len(sent), batch):
                part = sent[k : k + batch]
                for i, ((tokens, tags), error) in zip(part, _asked(pairs, [texts[i] for i in part], ([], [])), strict=True):
                    rows[i] = (list(tokens), list(tags), error)
            yield pd.DataFrame(rows, columns=["tokens", "tags", "error"])

    return tag(text)


#: Detectors that need no model, by name.
REGISTRY: dict[str, Callable[[], Detector]] = {"regexp": PatternDetector, "recognisers": RecogniserDetector, "spacy_rules": TokenRuleDetector}


def register(name: str, make: Callable[[], Detector]) -> None:
    """Add a detector of one's own by name."""
    REGISTRY[name] = make

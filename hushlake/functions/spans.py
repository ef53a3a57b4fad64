"""Spans of a text as arrays of structs, found and resolved without leaving the projection.

Offsets count code points from 0; the end is exclusive. A candidate is ordered by its first fields: start, end, order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CANDIDATE = "struct<start:int,end:int,order:int,priority:int,type:string,text:string>"
SPAN = "struct<start:int,end:int,type:string,text:string>"


def none(shape: str = CANDIDATE) -> Column:
    return F.array().cast(f"array<{shape}>")


#: Between windows: a mark that no pattern matches, with white space at both sides as in the text.
MARK = "\x01"
BETWEEN = f"\n{MARK}\n"
#: Characters that no match needs but in words with others: Latin letters and marks but for ``@ * + / .``. Classes of such characters are fast.
_PLAIN = r"!-),\-:-?A-~\x{A1}-\x{FF}"
#: A word (what stands between ASCII white space) that may hold a part of a match: it has any other character, or a dot before its end.
_LIVE = rf"[{_PLAIN}]*+(?:[^{_PLAIN}\s.]|\.(?=\S))\S*+"
#: What every match in a window has one of, besides a digit.
SOME_LIVE = ("@", "****", "http", "www.")
#: Live words that follow each other, with words of hyphens and brackets only between them, and a word that ends with the label of an address.
WINDOW = rf"(?<!\S)(?:{_LIVE}|(?:[^\s:]*+:)+?(?<=email:)(?=\s))(?:\s++(?:{_LIVE}|[-()]++(?!\S)))*+"


def may_match(text: Column) -> Column:
    """Whether a text can have a match in its windows: most texts lack digits and all of SOME_LIVE."""
    out = F.regexp_like(text, F.lit(r"\p{Nd}"))
    for string in SOME_LIVE:
        out = F.contains(text, F.lit(string)) | out
    return out


def windows(text: Column) -> Column:
    """The stretches of a text that can hold a match of a pattern of digits, addresses or stars: struct of ``text``, the stretches with MARK between
    them, and ``shifts``, for each stretch how far its characters stand from their places in the text. Null text: null.

    A text that holds MARK itself is one stretch.
    """
    pairs = F.arrays_zip(F.split(text, WINDOW, -1).alias("gap"), F.regexp_extract_all(text, F.lit(WINDOW), F.lit(0)).alias("hit"))

    def step(acc: Column, pair: Column) -> Column:
        shift = acc["shift"] + F.length(pair["gap"])
        shifts = F.when(pair["hit"].isNotNull(), F.concat(acc["shifts"], F.array(shift))).otherwise(acc["shifts"])
        return F.struct((shift - len(BETWEEN)).alias("shift"), shifts.alias("shifts"), F.when(pair["hit"].isNotNull(), F.concat(acc["hits"], F.array(pair["hit"]))).otherwise(acc["hits"]).alias("hits"))

    start = F.struct(F.lit(0).alias("shift"), F.array().cast("array<int>").alias("shifts"), F.array().cast("array<string>").alias("hits"))
    cut = F.aggregate(pairs, start, step, lambda acc: F.struct(F.array_join(acc["hits"], BETWEEN).alias("text"), acc["shifts"].alias("shifts")))
    whole = F.struct(text.alias("text"), F.array(F.lit(0)).alias("shifts"))
    return F.when(text.isNull(), F.lit(None)).when(F.contains(text, F.lit(MARK)), whole).when(may_match(text), cut).otherwise(no_stretches())


def no_stretches() -> Column:
    return F.struct(F.lit("").alias("text"), F.array().cast("array<int>").alias("shifts"))


def find_in(windows_: Column, regex: str, type_: str, order: int = 0, priority: int = 1) -> Column:
    """``find`` for a pattern whose matches lie in the windows of a text; places are those in the text."""
    text, shifts = windows_["text"], windows_["shifts"]
    pairs = F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hit"))
    one_stretch = F.size(shifts) == 1

    def step(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.length(pair["gap"])
        stretch = F.when(one_stretch, 0).otherwise(acc["stretch"] + F.length(pair["gap"]) - F.length(F.replace(pair["gap"], F.lit(MARK), F.lit(""))))
        start = at + F.get(shifts, stretch)
        one = F.struct(start.alias("start"), (start + F.length(pair["hit"])).alias("end"), F.lit(order).alias("order"), F.lit(priority).alias("priority"), F.lit(type_).alias("type"), pair["hit"].alias("text"))
        found = F.when(pair["hit"].isNotNull(), F.concat(acc["found"], F.array(one).cast(f"array<{CANDIDATE}>"))).otherwise(acc["found"])
        return F.struct((at + F.coalesce(F.length(pair["hit"]), F.lit(0))).alias("at"), stretch.alias("stretch"), found.alias("found"))

    fold = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.lit(0).alias("stretch"), none().alias("found")), step, lambda acc: acc["found"])
    return F.when(text.isNull(), F.lit(None)).when(F.regexp_like(text, F.lit(regex)), fold).otherwise(none())


def find(text: Column, regex: str, type_: str, order: int = 0, priority: int = 1) -> Column:
    """All leftmost matches of a pattern, as candidates. Null text: null.

    Splitting by the pattern gives the gaps between its matches; one fold adds up gaps and matches.
    """
    pairs = F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hit"))

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.coalesce(F.length(pair["hit"]), F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(order).alias("order"), F.lit(priority).alias("priority"), F.lit(type_).alias("type"), pair["hit"].alias("text"))
        found = F.when(pair["hit"].isNotNull(), F.concat(acc["found"], F.array(one).cast(f"array<{CANDIDATE}>"))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    fold = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none().alias("found")), step, lambda acc: acc["found"])
    return F.when(text.isNull(), F.lit(None)).when(F.regexp_like(text, F.lit(regex)), fold).otherwise(none())


def overlaps(a: Column, b: Column) -> Column:
    """Whether two half-open spans share a character."""
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _resolved(sorted_: Column, wins) -> Column:
    """Left fold that keeps spans apart: only the last kept one can overlap the next; ``wins(new, last)`` replaces it."""
    start = F.struct(none().alias("kept"), F.lit(None).cast(CANDIDATE).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        clash = acc["last"].isNotNull() & overlaps(x, acc["last"])
        kept = F.when(~clash & acc["last"].isNotNull(), F.concat(acc["kept"], F.array(acc["last"]))).otherwise(acc["kept"])
        last = F.when(clash & ~wins(x, acc["last"]), acc["last"]).otherwise(x)
        return F.struct(kept.alias("kept"), last.cast(CANDIDATE).alias("last"))

    return F.aggregate(sorted_, start, step, lambda acc: F.when(acc["last"].isNull(), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(acc["last"]))))


def resolve_by_priority(candidates: Column) -> Column:
    """By start, end and order; a span of strictly higher priority replaces the one it overlaps, any other overlap is dropped."""
    return _resolved(F.array_sort(candidates), lambda x, last: x["priority"] > last["priority"])


def resolve_by_length(candidates: Column) -> Column:
    """Leftmost-longest, ties by order: what overlaps a kept span is dropped."""
    keyed = F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), (c["start"] - c["end"]).alias("minus"), c["order"].alias("order"), c.alias("c")))
    return _resolved(F.transform(F.array_sort(keyed), lambda k: k["c"]), lambda x, last: F.lit(False))


def union_of_overlaps(candidates: Column) -> Column:
    """Merge overlapping spans into their common extent, typed by the highest priority: nothing that any span covers stays visible."""
    start = F.struct(none().alias("kept"), F.lit(None).cast(CANDIDATE).alias("last"))

    def step(acc: Column, x: Column) -> Column:
        last = acc["last"]
        clash = last.isNotNull() & overlaps(x, last)
        best = F.when(x["priority"] > last["priority"], x).otherwise(last)
        merged = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), best["order"].alias("order"),
            best["priority"].alias("priority"), best["type"].alias("type"), best["text"].alias("text"),
        )
        kept = F.when(~clash & last.isNotNull(), F.concat(acc["kept"], F.array(last))).otherwise(acc["kept"])
        return F.struct(kept.alias("kept"), F.when(clash, merged).otherwise(x).cast(CANDIDATE).alias("last"))

    return F.aggregate(F.array_sort(candidates), start, step, lambda acc: F.when(acc["last"].isNull(), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(acc["last"]))))


def plain(candidates: Column) -> Column:
    """Candidates as spans of start, end, type, text."""
    return F.transform(candidates, lambda c: F.struct(*[c[f].alias(f) for f in ("start", "end", "type", "text")]))

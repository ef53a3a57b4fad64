"""Tokens of a text with their places, and rules over tokens as one automaton.

A token is a number with its inner marks (``1,5``, ``10/12``), a run of letters, digits and underscores with inner apostrophes, or one other
character: hyphens, brackets and the dots of abbreviations are tokens of their own. A rule is a row of elements, each true or false of a
token. The elements of all rules are bits of one number, and a fold over the tokens keeps the bits of the elements reached so far, so a text
is read once whatever the number of rules. Where every rule needs a word with a Cyrillic letter or a plus sign, only the words around those
are cut into tokens: regular expressions leave the rest of a text out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import spans
from .patterns import NUMERALS, Element

_WORD = r"[\p{L}\p{M}\p{N}_]"
#: For Java and for RE2.
TOKEN = rf"\p{{Nd}}+(?:[.,/]\p{{Nd}}+)+|{_WORD}+(?:['’]{_WORD}+)*|[^\s\p{{Z}}]"
NUMBER, LETTERS = r"^\p{Nd}+(?:[.,]\p{Nd}+)*(?:/\p{Nd}+)?$", r"^\p{L}+$"
#: Bits of a group of rules that are folded together.
MOST_BITS = 62
#: Characters between anchors (``anchors``) up to which nothing is left out there.
NEAR = 40

Rule = tuple[str, list[Element]]


def is_cyrillic(element: Element) -> bool:
    """Whether only words with a Cyrillic letter fit an element."""
    kind, values = element
    return kind == "lower" and all(re.search("[А-Яа-яЁё]", v) for v in values)


def needs(rule: Rule) -> str:
    """What a text must hold for a rule to fit: ``cyrillic`` letters, or else a stretch of ``windows``; empty if neither is sure."""
    if any(map(is_cyrillic, rule[1])):
        return "cyrillic"
    plus_and_numbers = all(e[0] == "number" or e[0] == "text" and e[1] == ["+"] for e in rule[1])
    return "window" if plus_and_numbers and rule[1][0] == ("text", ["+"]) else ""


def anchors(rules: list[Rule]) -> str:
    """Characters of which every match holds one, as members of a class; empty if some rule needs none."""
    kinds = {needs(r) for r in rules}
    return "" if "" in kinds else ("А-Яа-яЁё" if "cyrillic" in kinds else "") + ("+" if "window" in kinds else "")


def windows(text: Column, rules: list[Rule]) -> Column:
    """The stretches of a text (``spans.windows``) that can hold a match of rules with ``anchors``: anchors, and as many words at both sides as a match can have besides.

    Words are what stands between the characters that no token holds, so each has a token, and none is cut.
    """
    marks, beside = anchors(rules), max(len(row) for _, row in rules) - 1
    space = r"\s\p{Z}"
    near = rf"[{marks}]++(?:[^{marks}]{{1,{NEAR}}}+[{marks}]++)*+"
    # The rest of an anchor's word and the words beside it.
    edge = rf"^[^{space}]*+(?:[{space}]++[^{space}]++){{0,{beside}}}+"
    pairs = F.arrays_zip(F.split(text, near, -1).alias("gap"), F.regexp_extract_all(text, F.lit(near), F.lit(0)).alias("hit"))
    ends = F.transform(
        pairs,
        lambda p, i: F.struct(
            p["gap"].alias("gap"), F.coalesce(p["hit"], F.lit("")).alias("hit"), (i == 0).alias("first"), p["hit"].isNull().alias("last"),
            F.when(i == 0, "").otherwise(F.regexp_extract(p["gap"], edge, 0)).alias("head"),
            F.when(p["hit"].isNull(), "").otherwise(F.reverse(F.regexp_extract(F.reverse(p["gap"]), edge, 0))).alias("tail"),
            F.length(p["gap"]).alias("n"),
        ),
    )
    left_out = lambda x: x["n"] - F.length(x["head"]) - F.length(x["tail"])
    cut = lambda x: x["first"] | (~x["last"] & (left_out(x) > 0))
    parts = F.transform(
        ends,
        lambda x: F.when(x["first"], F.concat(x["tail"], x["hit"])).when(x["last"], x["head"]).when(cut(x), F.concat(x["head"], F.lit(spans.BETWEEN), x["tail"], x["hit"])).otherwise(F.concat(x["gap"], x["hit"])),
    )

    def step(shifts: Column, x: Column) -> Column:
        before = F.when(x["first"], 0).otherwise(F.element_at(shifts, -1) - len(spans.BETWEEN))
        return F.concat(shifts, F.array(before + left_out(x)))

    shifts = F.aggregate(F.filter(ends, cut), F.array().cast("array<int>"), step)
    found = F.struct(F.array_join(parts, "").alias("text"), shifts.alias("shifts"))
    whole = F.struct(text.alias("text"), F.array(F.lit(0)).alias("shifts"))
    some = F.when(F.contains(text, F.lit(spans.MARK)), whole).otherwise(found)
    return F.when(F.regexp_like(text, F.lit(f"[{marks}]")), some).otherwise(spans.no_stretches())


def _either(masks: list[Column]) -> Column:
    out = F.lit(0).cast("long")
    for m in masks:
        out = out.bitwiseOR(m)
    return out


def _mask(token: Column, elements: list[Element]) -> Column:
    """The bits of the elements that are true of a token."""
    by_kind: dict[str, dict[str, int]] = {"lower": {}, "text": {}}
    numbers = letters = 0
    for bit, (kind, values) in enumerate(elements):
        for v in values:
            by_kind[kind][v] = by_kind[kind].get(v, 0) | 1 << bit
        numbers |= (kind == "number") << bit
        letters |= (kind == "letters") << bit
    of = lambda table, key: F.coalesce(F.try_element_at(F.create_map(*[x for k, m in table.items() for x in (F.lit(k), F.lit(m).cast("long"))]), key), F.lit(0).cast("long"))
    when = lambda test, m: F.when(test, F.lit(m).cast("long")).otherwise(F.lit(0).cast("long"))
    masks = [of(table, key) for table, key in ((by_kind["lower"], F.lower(token)), (by_kind["text"], token)) if table]
    if numbers:
        masks.append(when(F.regexp_like(token, F.lit(NUMBER)) | F.lower(token).isin(*NUMERALS), numbers))
    if letters:
        masks.append(when(F.regexp_like(token, F.lit(LETTERS)), letters))
    return _either(masks)


def _groups(rules: list[Rule]) -> list[list[tuple[int, Rule]]]:
    """Rules with their numbers, in groups whose elements fit in one number."""
    groups: list[list[tuple[int, Rule]]] = [[]]
    for n, rule in enumerate(rules):
        if sum(len(r[1]) for _, r in groups[-1]) + len(rule[1]) > MOST_BITS:
            groups.append([])
        groups[-1].append((n, rule))
    return groups


def find_rules(windows_: Column, rules: list[Rule], priority: int = 1) -> Column:
    """All matches of the rules in a text with its shifts (``spans.windows``), as candidates. Null text: null."""
    found = [_fold(windows_, group, priority) for group in _groups(rules) if group]
    return F.concat(spans.none(), *found)


def _fold(windows_: Column, rules: list[tuple[int, Rule]], priority: int) -> Column:
    text, shifts = windows_["text"], windows_["shifts"]
    elements = [e for _, (_, row) in rules for e in row]
    longest = max(len(row) for _, (_, row) in rules)
    first = last = at = 0
    ends = []
    for order, (type_, row) in rules:
        first, at = first | 1 << at, at + len(row)
        last |= 1 << (at - 1)
        ends.append(F.struct(F.lit(1 << (at - 1)).cast("long").alias("bit"), F.lit(len(row)).alias("n"), F.lit(order).alias("order"), F.lit(type_).alias("type")))
    pairs = F.arrays_zip(F.split(text, TOKEN, -1).alias("gap"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("token"))
    whole = F.size(shifts) == 1
    marked = F.transform(
        F.filter(pairs, lambda p: p["token"].isNotNull()),
        lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["token"]).alias("n"), (~whole & (p["token"] == spans.MARK)).alias("cut"), _mask(p["token"], elements).alias("mask")),
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["n"]
        # Each element that was reached makes the next one possible, and every rule's first always is.
        bits = F.shiftleft(acc["bits"], 1).bitwiseOR(F.lit(first).cast("long")).bitwiseAND(x["mask"])
        starts = F.slice(F.concat(F.array(start), acc["starts"]), 1, longest)
        stretch = F.when(x["cut"], acc["stretch"] + 1).otherwise(acc["stretch"])
        shift = F.get(shifts, stretch)
        done = F.transform(
            F.filter(F.array(*ends), lambda r: bits.bitwiseAND(r["bit"]) != 0),
            lambda r: F.struct(
                (F.get(starts, r["n"] - 1) + shift).alias("start"), (end + shift).alias("end"), r["order"].alias("order"), F.lit(priority).alias("priority"), r["type"].alias("type"),
                F.substring(text, F.get(starts, r["n"] - 1) + 1, end - F.get(starts, r["n"] - 1)).alias("text"),
            ),
        )
        hits = F.when(bits.bitwiseAND(F.lit(last).cast("long")) != 0, F.concat(acc["found"], done.cast(f"array<{spans.CANDIDATE}>"))).otherwise(acc["found"])
        return F.struct(end.alias("at"), stretch.alias("stretch"), bits.alias("bits"), starts.alias("starts"), hits.alias("found"))

    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("stretch"), F.lit(0).cast("long").alias("bits"), F.array().cast("array<int>").alias("starts"), spans.none().alias("found"))
    return F.when(text.isNotNull(), F.aggregate(marked, zero, step, lambda acc: acc["found"]))

"""Small text expressions: normalisation, back-mapping, screens and context heuristics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import MOST_NAME_WORDS, NOT_NAMES, SCREEN

#: Fixed value: marks whose doubles are made single, one after another in this order.
DOUBLES = "!,.:;?"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: an expression that stands in a lambda is else computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalise(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; doubled marks as one."""
    out = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    for mark in DOUBLES:
        out = F.replace(out, F.lit(mark * 2), F.lit(mark))
    return out


def first_place(original: Column, normalised: Column, start: Column, end: Column) -> Column:
    """Where a span of the normalised text first stands in the original, whatever its case: struct of start and end, or null."""
    at = F.instr(F.lower(original), F.lower(F.substring(normalised, start + 1, end - start)))
    return F.when((at > 0) & (end > start), F.struct((at - 1).alias("start"), (at - 1 + end - start).alias("end")))


def place_of(text: Column, value: Column, hint: Column | int = 0) -> Column:
    """Where a value stands in a text from a place on: as it is, else, where texts agree without their white space's form, without white space at its ends.

    Struct of start and end, or null.
    """
    at = F.lit(hint) if isinstance(hint, int) else hint
    exact = F.call_function("locate", value, text, at + 1) - 1
    single = lambda c: strip(F.regexp_replace(c, r"(?U)\s+", " "))
    bare = strip(value)
    loose = F.when(F.call_function("locate", single(value), single(text), at + 1) > 0, F.call_function("locate", bare, text, at + 1) - 1).otherwise(-1)
    span = lambda start, v: F.struct(start.alias("start"), (start + F.length(v)).alias("end"))
    return F.when(exact >= 0, span(exact, value)).when(loose >= 0, span(loose, bare))


def may_hold_personal_data(text: Column) -> Column:
    """The quick screen: any of a few loose patterns. Null text: false."""
    out = F.lit(False)
    for regex in SCREEN:
        out = out | F.regexp_like(text, F.lit("(?U)" + regex))
    return F.coalesce(out, F.lit(False))


def likely_name(text: Column) -> Column:
    """Not one of the usual phrases, and of three words at most."""
    return ~text.isin(*NOT_NAMES) & (F.size(F.split(strip(text), r"(?U)\s+")) <= MOST_NAME_WORDS)


# Words that hint at a name, an organisation or a place in the three words before.
NAME_HINTS = ["зовут", "меня", "имя", "фамилия"]
ORGANISATION_FORMS = ["ооо", "зао", "оао", "ип", "ltd", "inc"]
ORGANISATION_HINTS = ["работаю", "компания", "фирма", "предприятие"]
PLACE_HINTS = ["живу", "город", "село", "деревня", "улица", "проспект"]


def _hinted(words: Column, i: Column, hints: list[str]) -> Column:
    before = F.lower(F.array_join(F.slice(words, F.greatest(F.lit(1), i - 2), F.least(F.lit(3), i)), " "))
    return F.exists(F.array(*[F.lit(h) for h in hints]), lambda h: F.contains(before, h))


def hints(text: Column) -> Column:
    """Each word with what its context hints at: structs of word, name, organisation, place."""
    def one(words: Column, w: Column, i: Column) -> Column:
        capital = F.regexp_like(w, F.lit(r"(?U)^\p{Lu}")) & (F.length(w) >= 2)
        form = F.lower(w).isin(*ORGANISATION_FORMS)
        return F.struct(
            w.alias("word"), (capital & _hinted(words, i, NAME_HINTS)).alias("name"),
            (form | _hinted(words, i, ORGANISATION_HINTS)).alias("organisation"), _hinted(words, i, PLACE_HINTS).alias("place"),
        )

    return bound(F.split(strip(text), r"(?U)\s+"), lambda words: F.transform(words, lambda w, i: one(words, w, i)))

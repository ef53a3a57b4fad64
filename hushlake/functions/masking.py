"""Replacing spans in a text: placeholders, fixed names by type, or repeatable pseudonyms."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

#: Types that are masked only above the second threshold; all others above the first.
SENSITIVE = ("PERSON", "PHONE", "EMAIL", "PASSPORT", "SNILS", "INN")
GATE, SENSITIVE_GATE = 0.1, 0.3
#: Names by type of the command-line tool.
NAMES = {"PERSON": "<ИМЯ>", "PHONE_NUMBER": "<ТЕЛЕФОН>", "EMAIL_ADDRESS": "<EMAIL>", "DEFAULT": "<ДАННЫЕ>"}
HIDDEN = {"DEFAULT": "<СКРЫТО>"}

Policy = Callable[[Column, Column], Column]


def will_mask(type_: Column, aggressiveness: float) -> Column:
    """Whether spans of a type are masked at an aggressiveness, which is held between 0 and 1."""
    a = max(0.0, min(1.0, aggressiveness))
    return F.when(type_.isin(*SENSITIVE), F.lit(a > SENSITIVE_GATE)).otherwise(F.lit(a > GATE))


def placeholder(span: Column, seed: Column) -> Column:
    """``<TYPE>``."""
    return F.concat(F.lit("<"), span["type"], F.lit(">"))


def by_type(names: dict[str, str]) -> Policy:
    """A fixed replacement for each type, and ``DEFAULT`` for others (else ``<СКРЫТО>``)."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    rest = F.lit(names.get("DEFAULT", HIDDEN["DEFAULT"]))
    return lambda span, seed: F.coalesce(F.try_element_at(table, span["type"]), rest)


def custom(replace: Callable[[str, str], str]) -> Callable[[Column], Column]:
    """A user's function of (type, text), for ``mask_with``: called on Arrow batches of the chosen spans, once for each."""

    @F.pandas_udf("array<string>")
    def replaced(types: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [replace(a, b) for a, b in zip(t, x, strict=True)] for t, x in zip(types, texts, strict=True)])

    return lambda chosen: replaced(F.transform(chosen, lambda s: s["type"]), F.transform(chosen, lambda s: s["text"]))


_FIRST = ["Анна", "Борис", "Вера", "Глеб", "Дарья", "Егор", "Жанна", "Захар", "Инна", "Кирилл", "Лидия", "Максим"]
_LAST = ["Алейник", "Бойко", "Вдовиченко", "Гайдар", "Дубко", "Живаго", "Зима", "Корж", "Лещенко", "Мороз", "Нога", "Остап"]
_CITIES = ["Тверь", "Омск", "Пермь", "Тула", "Рязань", "Псков", "Курск", "Орёл"]
_STREETS = ["Садовая", "Лесная", "Полевая", "Речная", "Школьная", "Новая"]
_FIRMS = ["ООО Заря", "АО Вектор", "ООО Берег", "АО Сигма", "ООО Исток"]
#: Choices of the pseudonym generators, and the letters of car numbers.
EDUCATION = ["МГУ", "СПбГУ", "МФТИ", "ВШЭ", "МГТУ"]
POSITION = ["менеджер", "специалист", "директор", "инженер"]
FAMILY = ["супруг", "супруга", "сын", "дочь", "родитель"]
CAR_LETTERS = "АВЕКМНОРСТУХ"


def pseudonym(seed: int = 0) -> Policy:
    """A made-up value of the same type, the same in every run for the same row and place; unknown types get a placeholder."""

    def policy(span: Column, row: Column) -> Column:
        def number(salt: int, low: int, high: int) -> Column:
            key = F.concat_ws(":", F.lit(str(seed)), row.cast("string"), span["start"].cast("string"), F.lit(str(salt)))
            return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") % (high - low + 1) + low

        def text(salt: int, low: int, high: int) -> Column:
            return number(salt, low, high).cast("string")

        def one_of(salt: int, values) -> Column:
            return F.get(F.array(*[F.lit(v) for v in values]), number(salt, 0, len(values) - 1).cast("int"))

        def latin(salt: int) -> Column:
            return F.concat(F.lit("user"), text(salt, 100, 99_999))

        def digits(salt: int, n: int) -> Column:
            return F.lpad(text(salt, 0, 10**n - 1), n, "0")

        join = F.concat
        day = F.date_format(F.date_add(F.to_date(F.lit("1945-01-01")), number(1, 0, 22_000).cast("int")), "dd.MM.yyyy")
        made = {
            "PERSON": join(one_of(1, _FIRST), F.lit(" "), one_of(2, _LAST)),
            "EMAIL": join(latin(1), F.lit("@example.org")),
            "PHONE": join(F.lit("+7 "), text(1, 900, 999), F.lit(" "), digits(2, 3), F.lit("-"), digits(3, 2), F.lit("-"), digits(4, 2)),
            "ADDRESS": join(F.lit("г. "), one_of(1, _CITIES), F.lit(", ул. "), one_of(2, _STREETS), F.lit(", д. "), text(3, 1, 150)),
            "ORGANIZATION": one_of(1, _FIRMS),
            "PASSPORT": join(text(1, 10, 99), F.lit(" "), text(2, 10, 99), F.lit(" "), text(3, 100_000, 999_999)),
            "SNILS": join(text(1, 100, 999), F.lit("-"), text(2, 100, 999), F.lit("-"), text(3, 100, 999), F.lit(" "), text(4, 10, 99)),
            "INN": digits(1, 12),
            "CARD": join(text(1, 1000, 9999), F.lit(" **** **** "), text(2, 1000, 9999)),
            "BIRTHDAY": day,
            "AGE": text(1, 18, 80),
            "LOCATION": one_of(1, _CITIES),
            "EDUCATION": one_of(1, EDUCATION),
            "POSITION": one_of(1, POSITION),
            "FAMILY": one_of(1, FAMILY),
            "IP_ADDRESS": join(text(1, 1, 223), F.lit("."), text(2, 0, 255), F.lit("."), text(3, 0, 255), F.lit("."), text(4, 1, 254)),
            "URL": join(F.lit("https://example.org/"), text(1, 1000, 99_999)),
            "USERNAME": latin(1),
            # With a region, unlike the usual generator, so that a pseudonym is a car number again.
            "CAR_NUMBER": join(one_of(1, CAR_LETTERS), text(2, 100, 999), one_of(3, CAR_LETTERS), one_of(4, CAR_LETTERS), text(5, 10, 199)),
        }
        out = placeholder(span, row)
        for type_, value in made.items():
            out = F.when(span["type"] == type_, value).otherwise(out)
        return out

    return policy


def mask(text: Column, spans: Column, policy: Policy = placeholder, aggressiveness: float = 0.8, row: Column | None = None) -> Column:
    """The text with its spans replaced. Spans must be in order and apart; ``row`` seeds pseudonyms. Null text: null.

    Each span contributes the text since the last one and its replacement, so the work is linear in the text.
    """
    row = row if row is not None else F.lit(0)

    def masked(chosen: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(chosen, i - 1)["end"], F.lit(0))
            return F.concat(F.substring(text, before + 1, s["start"] - before), policy(s, row))

        end = F.coalesce(F.try_element_at(chosen, F.lit(-1))["end"], F.lit(0))
        return F.concat(F.array_join(F.transform(chosen, piece), ""), F.substring(text, end + 1, F.length(text)))

    chosen = F.filter(spans, lambda s: will_mask(s["type"], aggressiveness))
    return F.when(F.size(spans) == 0, text).otherwise(bound(chosen, masked))


def mask_with(text: Column, spans: Column, replacements: Column) -> Column:
    """The text with its spans replaced by an array of as many strings."""
    def piece(s: Column, i: Column) -> Column:
        before = F.coalesce(F.get(spans, i - 1)["end"], F.lit(0))
        return F.concat(F.substring(text, before + 1, s["start"] - before), F.coalesce(F.get(replacements, i), F.lit("")))

    end = F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0))
    return F.concat(F.array_join(F.transform(spans, piece), ""), F.substring(text, end + 1, F.length(text)))


def report(spans: Column, aggressiveness: float = 0.8) -> Column:
    """Spans with their length and whether they are masked."""
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["text"].alias("text"),
            (s["end"] - s["start"]).alias("length"), will_mask(s["type"], aggressiveness).alias("will_anonymize"),
        ),
    )

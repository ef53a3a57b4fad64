r"""The pattern catalogue, and how it is written for Java's regular expressions.

``\d``, ``\s``, ``\b`` and letter cases are Unicode here, so every pattern is compiled with ``(?U)``,
and ``(?iU)`` where case does not matter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: What a text must hold, each tested once for all patterns that need it: a string, or else a regular expression.
GUARDS = {
    "cyrillic": (None, "[А-Яа-яЁё]"),
    "digits": (None, r"(?U)\d(?:[-\s()]*+\d){9}"),
    "dots": (None, r"(?U)\d[./]\d"),
    "stars": ("****", None),
    "at": ("@", None),
    "web": (None, r"https?://|www\."),
}
#: The guards of types whose patterns have no Cyrillic letter.
GUARD_OF = {
    "PHONE": "digits", "PASSPORT": "digits", "SNILS": "digits", "INN": "digits", "BANK_CARD": "digits", "PHONE_NUMBER": "digits",
    "EMAIL": "at", "EMAIL_ADDRESS": "at", "BIRTHDAY": "dots", "IP_ADDRESS": "dots", "URL": "web",
}


@dataclass(frozen=True)
class Pattern:
    """A typed pattern; ``order`` breaks ties between spans of one place."""

    type: str
    regex: str
    ignore_case: bool = False
    order: int = 0

    @property
    def java(self) -> str:
        return ("(?iU)" if self.ignore_case else "(?U)") + self.regex

    @property
    def guard(self) -> str:
        """The name in GUARDS of what a text must hold to be worth a scan; empty for patterns that are not of this module."""
        if self.regex not in _OWN:
            return ""
        return "cyrillic" if re.search("[А-Яа-яЁё]", self.regex) else "stars" if "*{4}" in self.regex else GUARD_OF.get(self.type, "")

    @property
    def re2(self) -> str:
        """The same for SQL engines whose character classes are ASCII."""
        return ("(?i)" if self.ignore_case else "") + self.regex


# The patterns, in the order in which they are tried.
_CATALOGUE = [
    ("PHONE", r"\+7\s*\(\d{3}\)\s*\d{3}[-\s]*\d{2}[-\s]*\d{2}", False),
    ("PHONE", r"\+7\s*\d{3}\s*\d{3}[-\s]*\d{2}[-\s]*\d{2}", False),
    ("PHONE", r"8\s*\(\d{3}\)\s*\d{3}[-\s]*\d{2}[-\s]*\d{2}", False),
    ("PHONE", r"8\s*\d{3}\s*\d{3}[-\s]*\d{2}[-\s]*\d{2}", False),
    ("PHONE", r"\+7\d{10}", False),
    ("PHONE", r"8\d{10}", False),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", False),
    ("EMAIL", r"email:\s*[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}", False),
    ("PASSPORT", r"\b\d{2}\s+\d{2}\s+\d{6}\b", False),
    ("PASSPORT", r"\b\d{4}\s+\d{6}\b", False),
    ("PASSPORT", r"паспорт[:\s]*\d{2}\s+\d{2}\s+\d{6}", True),
    ("SNILS", r"\b\d{3}[-\s]*\d{3}[-\s]*\d{3}[-\s]*\d{2}\b", False),
    ("SNILS", r"снилс[:\s]*\d{3}[-\s]*\d{3}[-\s]*\d{3}[-\s]*\d{2}", True),
    ("INN", r"\b\d{10}\b", False),
    ("INN", r"\b\d{12}\b", False),
    ("INN", r"инн[:\s]*\d{10,12}", True),
    ("BANK_CARD", r"\b\d{4}[\s-]*\d{4}[\s-]*\d{4}[\s-]*\d{4}\b", False),
    ("BANK_CARD", r"\b\d{4}[\s*]*\*{4}[\s*]*\*{4}[\s*]*\d{4}\b", False),
    ("BIRTHDAY", r"\b\d{1,2}\.\d{1,2}\.\d{4}\b", False),
    ("BIRTHDAY", r"\b\d{1,2}/\d{1,2}/\d{4}\b", False),
    ("BIRTHDAY", r"\b\d{1,2}\s+(?:января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря)\s+\d{4}", True),
    ("BIRTHDAY", r"родил[ас]ь[:\s]*\d{1,2}\.\d{1,2}\.\d{4}", True),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", False),
    ("URL", r"https?://[^\s]+", False),
    ("URL", r"www\.[^\s]+", False),
    ("PERSON", r"\b[А-ЯЁ][а-яё]+\s+[А-ЯЁ]\.(?:\s*[А-ЯЁ]\.)?", True),
    ("PERSON", r"\b[А-ЯЁ][а-яё]+\s+[А-ЯЁ]\.\s*[А-ЯЁ]\.", True),
    ("CAR_NUMBER", r"\b[АВЕКМНОРСТУХ]\d{3}[АВЕКМНОРСТУХ]{2}\d{2,3}\b", False),
    ("AGE", r"мне\s+\d{1,2}\s+лет", True),
    ("AGE", r"\b\d{1,2}\s+лет\b", True),
]
#: Fixed value: full names count only above this aggressiveness, and only where nothing found before them overlaps.
FULL_NAME = Pattern("PERSON", r"\b[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+)?\b", False, 1000)
FULL_NAME_ABOVE = 0.6
#: Fixed value: types that are looked for after full names.
AFTER_NAMES = ("CAR_NUMBER", "AGE")

#: Which type wins where spans overlap.
PRIORITY = {
    "PHONE": 10, "EMAIL": 10, "PASSPORT": 9, "SNILS": 9, "INN": 8, "BANK_CARD": 8,
    "BIRTHDAY": 7, "PERSON": 7, "IP_ADDRESS": 5, "URL": 5, "CAR_NUMBER": 4, "AGE": 3,
}

CATALOGUE = [Pattern(t, r, i, n if t not in AFTER_NAMES else 2000 + n) for n, (t, r, i) in enumerate(_CATALOGUE)]

#: The quick screen for any personal data.
SCREEN = [
    r"(?:\+7|8)?\s?\(?\d{3}\)?[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}",
    r"[a-zA-Z0-9._%+-]+@[\w.-]+\.[a-zA-Z]{2,}",
    r"\b\d{4}\s?\d{6}\b",
    r"\b\d{4}\s\d{4}\s\d{4}\s\d{4}\b",
]

#: The scored recognisers (type, score, patterns).
RECOGNISERS = [
    ("PERSON", 0.85, [
        r"\b[А-ЯЁ][а-яё]{2,15}\s+[А-ЯЁ][а-яё]{2,20}\b",
        r"\b[А-ЯЁ][а-яё]{2,15}\s+[А-ЯЁ][а-яё]{2,15}\s+[А-ЯЁ][а-яё]{2,20}\b",
        r"\b[А-ЯЁ][а-яё]{2,20}\s+[А-ЯЁ]\.\s*[А-ЯЁ]\.\b",
        r"\b[А-ЯЁ]\.\s*[А-ЯЁ]\.\s+[А-ЯЁ][а-яё]{2,20}\b",
    ]),
    ("PHONE_NUMBER", 0.90, [
        r"\+7\s*\d{3}\s*\d{3}\s*\d{2}\s*\d{2}",
        r"8[-\s]*\d{3}[-\s]*\d{3}[-\s]*\d{2}[-\s]*\d{2}",
        r"8\s*\(\d{3}\)\s*\d{3}[-\s]*\d{2}[-\s]*\d{2}",
        r"\+7\(\d{3}\)\d{3}[-\s]*\d{2}[-\s]*\d{2}",
    ]),
    ("EMAIL_ADDRESS", 0.95, [r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"]),
]
#: Phrases that are not names, and the most words of a name.
NOT_NAMES = ["Меня зовут", "Его зовут", "Её зовут", "Их зовут", "Мой друг", "Моя подруга", "Наш коллега", "Наша коллега"]
MOST_NAME_WORDS = 3

#: What a token must be: one of some words in lower case, one of some strings as they are, a number, or letters only.
Element = tuple[str, list[str]]


def _word(*words: str) -> Element:
    return "lower", list(words)


_NUMBER, _LETTERS, _COLON, _PLUS = ("number", []), ("letters", []), ("text", [":"]), ("text", ["+"])
#: Token rules, as types and their elements.
TOKEN_RULES: list[tuple[str, list[Element]]] = [
    ("AGE", [_NUMBER, _word("лет")]),
    ("AGE", [_word("мне"), _NUMBER, _word("лет")]),
    ("AGE", [_word("возраст"), _COLON, _NUMBER]),
    ("PHONE", [_PLUS, _NUMBER]),
    ("PHONE", [_word("тел"), _COLON, _NUMBER]),
    ("EDUCATION", [_word("выпускник"), _LETTERS]),
    ("EDUCATION", [_word("студент"), _LETTERS]),
    ("EDUCATION", [_word("окончил"), _LETTERS]),
    ("POSITION", [_word("работаю"), _LETTERS]),
    ("POSITION", [_word("должность"), _COLON, _LETTERS]),
    ("POSITION", [_word("профессия"), _COLON, _LETTERS]),
    ("ADDRESS", [_word("живу"), _word("в", "на"), _LETTERS]),
    ("ADDRESS", [_word("адрес"), _COLON, _LETTERS]),
    ("ADDRESS", [_word("улица"), _LETTERS]),
]
#: Numerals that are numbers too.
NUMERALS = [
    "ноль", "один", "два", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять", "десять", "одиннадцать", "двенадцать", "тринадцать", "четырнадцать", "пятнадцать", "шестнадцать",
    "семнадцать", "восемнадцать", "девятнадцать", "двадцать", "тридцать", "сорок", "пятьдесят", "шестьдесят", "семьдесят", "восемьдесят", "девяносто", "сто", "двести", "триста", "тысяча", "миллион",
]

#: The patterns above, for which the guards hold.
_OWN = {r for _, r, _ in _CATALOGUE} | {FULL_NAME.regex} | {r for _, _, rs in RECOGNISERS for r in rs}

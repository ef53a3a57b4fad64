"""Labels of models, translated to the types used here; null for labels that have none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label tables.
SPACY = {
    "PERSON": "PERSON", "PER": "PERSON", "ORG": "ORGANIZATION", "GPE": "LOCATION", "LOC": "LOCATION", "DATE": "DATE", "TIME": "TIME",
    "PERCENT": "PERCENT", "PHONE": "PHONE", "EMAIL": "EMAIL", "AGE": "AGE", "EDUCATION": "EDUCATION", "FAMILY": "FAMILY",
    "WORK": "POSITION", "ADDRESS": "ADDRESS", "MEDICAL": "MEDICAL", "PASSPORT": "PASSPORT", "SNILS": "SNILS", "INN": "INN",
}
BERT = {
    "PER": "PERSON", "PERSON": "PERSON", "ORG": "ORGANIZATION", "ORGANIZATION": "ORGANIZATION", "LOC": "LOCATION", "LOCATION": "LOCATION",
    "MISC": "MISC", "GPE": "LOCATION", "DATE": "DATE", "TIME": "TIME", "PERCENT": "PERCENT", "FIRST_NAME": "PERSON", "LAST_NAME": "PERSON",
    "MIDDLE_NAME": "PERSON", "CITY": "LOCATION", "COUNTRY": "LOCATION", "NATIONALITY": "PERSON", "JOB": "POSITION", "AGE": "AGE",
    "ORG_NAME": "ORGANIZATION", "FACILITY": "LOCATION", "STREET": "ADDRESS", "HOUSE": "ADDRESS", "PHONE": "PHONE", "EMAIL": "EMAIL",
}
DEEPPAVLOV = {
    "PERSON": "PERSON", "PER": "PERSON", "ORG": "ORGANIZATION", "ORGANIZATION": "ORGANIZATION", "LOC": "LOCATION",
    "LOCATION": "LOCATION", "GPE": "LOCATION", "MISC": "MISC", "DATE": "BIRTHDAY",
}
NATASHA = {"PER": "PERSON", "ORG": "ORGANIZATION", "LOC": "LOCATION", "DATE": "DATE", "TIME": "TIME"}


def _looked_up(table: dict[str, str], label: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), label)


def spacy(label: Column) -> Column:
    return _looked_up(SPACY, label)


def bert(label: Column) -> Column:
    """``B-`` and ``I-`` go wherever they stand; letter case does not matter."""
    bare = F.replace(F.replace(label, F.lit("B-"), F.lit("")), F.lit("I-"), F.lit(""))
    return _looked_up(BERT, F.upper(bare))


def deeppavlov(label: Column) -> Column:
    return _looked_up(DEEPPAVLOV, F.upper(label))


def natasha(label: Column) -> Column:
    return _looked_up(NATASHA, label)


MAPPERS = {"spacy": spacy, "bert": bert, "deeppavlov": deeppavlov, "natasha": natasha}

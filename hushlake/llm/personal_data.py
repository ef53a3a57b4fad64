r"""Operator 9: personal data by patterns, checksums and context.

Patterns propose spans, validators confirm them (Luhn for cards, mod-97 for IBANs, ranges and digit
counts), and words near a span adjust its score. Spans of the four base kinds that are confirmed always
stay; the two further kinds stay at a score of ``least_score`` or more where no base span overlaps
them. All of it is Spark's own regular expressions and array functions, in one projection without a shuffle.

How positions come about: splitting a text by a pattern gives the gaps between its matches, so
one fold over gaps and matches adds up their lengths. The fold keeps confirmed spans only.
Patterns start at the start of a run, or where the last match ended (``\G``): no other place can start a
leftmost match, and a long run is then scanned once. Loops are possessive, which keeps
long texts off the stack; nothing follows them, so the matches are the same.

Defined results: a null or empty text has no spans; equal rows have equal spans; an empty table stays empty;
input columns that bear an output's name are replaced, others stay. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fenced, names_without

OUTPUT = ["spans"]
#: Kinds in the order in which spans at one start are listed; the first four are the base.
KINDS = ["email", "ip", "card", "phone", "iban", "local_phone"]
N_BASE = 4

#: For each kind: what a text must hold to be worth a scan, and the pattern.
GUARDS = {
    "email": "@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"\+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
    "local_phone": r"\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}",
}
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9)+.-])\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9-])",
}
#: Scores before context: a checksum is worth more than a shape.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "local_phone": 0.4}
#: Whole words that raise a span's score when they stand near it.
_CALLS = r"(?:tele)?phone|call|tel|mobile|fax|anruf\w*|telefon\w*|tel[eé]fono|llam\w+|appel\w*"
CONTEXT = {
    "email": r"e-?mails?|contact|write|mailto|kontakt\w*|correo|courriel",
    "ip": r"ip|address|server|host|adresse|direcci[oó]n",
    "card": r"cards?|visa|master(?:card)?|payment|\w*karte|carte|tarjeta",
    "phone": _CALLS,
    "iban": r"iban|bank\w*|account|konto\w*|compte|cuenta",
    "local_phone": _CALLS,
}
#: Whole words near a span that lower its score: numbers of other things.
AGAINST = r"order|invoice|serial|version|isbn|issn|sku|model|rechnung\w*|bestell\w+|facture|commande|factura|pedido"
CONTEXT_CHARS, CONTEXT_BONUS, LEAST_SCORE = 40, 0.3, 0.6


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn check digit."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, 1).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's rearranged number leaves 1 when divided by 97."""
    bare = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        value = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(value < 10, (acc * 10 + value) % 97).otherwise((acc * 100 + value) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c))) == 1


def _confirmed(kind: str, hit: Column) -> Column:
    digits = _digits(hit)
    if kind == "ip":
        short = F.transform(F.split(hit, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(short, lambda p: F.when(F.length(p) <= 3, F.concat(F.lit("0"), p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return mod97(hit) if kind == "iban" else F.lit(True)


def _spans_of(kind: str, text: Column) -> Column:
    number = KINDS.index(kind)
    shape = f"array<struct<start:int,kind_no:int,end:int,kind:string,text:string>>"
    none = F.array().cast(shape)
    pairs = F.arrays_zip(
        F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("hit")
    )

    def step(acc: Column, pair: Column) -> Column:
        start = acc["pos"] + F.length(pair["gap"])
        end = start + F.coalesce(F.length(pair["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), pair["hit"].alias("text"))
        good = pair["hit"].isNotNull() & _confirmed(kind, pair["hit"])
        found = F.when(good, F.concat(acc["found"], F.array(span).cast(shape))).otherwise(acc["found"])
        return F.struct(end.alias("pos"), found.alias("found"))

    fold = F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), none.alias("found")), step, lambda acc: acc["found"])
    guard = F.contains(text, F.lit("@")) if kind == "email" else F.regexp_like(text, F.lit(GUARDS[kind]))
    return F.when(guard, fold).otherwise(none)


def _scored(span: Column, text: Column) -> Column:
    """A span with its score: its kind's, more or less by the words within CONTEXT_CHARS before and after it, its own text aside."""
    from_ = F.greatest(F.lit(0), span["start"] - CONTEXT_CHARS)
    near = F.lower(F.concat(F.substring(text, from_ + 1, span["start"] - from_), F.lit(" "), F.substring(text, span["end"] + 1, F.lit(CONTEXT_CHARS))))
    holds = lambda words: F.regexp_like(near, F.lit(rf"(?U)\b(?:{words})\b")).cast("int") * CONTEXT_BONUS
    score = F.lit(None).cast("double")
    for kind in KINDS:
        score = F.when(span["kind"] == kind, F.lit(SCORES[kind]) + holds(CONTEXT[kind]) - holds(AGAINST)).otherwise(score)
    return F.struct(*[span[f].alias(f) for f in ("start", "kind_no", "end", "kind", "text")], F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2).alias("score"))


def find_personal_data(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` (text, ...) with spans: structs of start, kind_no, end, kind, text, score, in order of start and kind."""
    names = names_without(docs, OUTPUT)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    text = F.col("t")
    base = F.concat(*[_spans_of(k, text) for k in KINDS[:N_BASE]])
    more = F.concat(*[_spans_of(k, text) for k in KINDS[N_BASE:]])
    found = rows.select("row", "t", base.alias("base"), more.alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    scored = F.filter(F.transform(apart, lambda s: _scored(s, text)), lambda s: s["score"] >= least_score)
    spans = F.when(
        (F.size("base") > 0) | (F.size("more") > 0),
        F.array_sort(F.concat(F.transform("base", lambda s: _scored(s, text)), scored)),
    ).otherwise(F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string,text:string,score:double>>"))
    return fenced(found, [*[F.col("row").getField(c).alias(c) for c in names], spans.alias("spans")])


def span_list(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

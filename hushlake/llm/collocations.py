"""Operator 12: phrases of two to four words that stand together more often than their parts, by position bitmaps.

Texts are cut into pieces and pieces into words. A shard is a run of words of one language, as one task reads them: the number of each
word at each position, with an empty position between pieces, so that no phrase crosses from one to the next. In a shard every word
has a compressed bitmap of its positions: those of its blocks of eight positions that are not empty, as a byte each. The bitmap of a
phrase's last words, moved on by one position and cut with the bitmaps of all words in the same blocks, gives the bitmaps of all longer
phrases; the bits left are counted, and phrases are extended depth first, a bounded group of sisters at a time. A phrase's count is the sum
over the shards.

Only words that are frequent in their whole language take part, then only pairs that are, for no phrase is more frequent than its
parts. Shards get the words and pairs that they hold by joins; nothing that grows with the corpus is broadcast.

Defined results: null and empty texts hold no words; a null language is ``und``; equal rows count each; an empty table gives no rows; other
columns are ignored. A language with fewer phrases than asked for gives all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, slices, written

#: Positions of a shard, beyond which a task begins the next.
SHARD_WORDS = 2_000_000
#: Pairs of blocks that are cut at a time.
MOST_CUTS = 2_000_000
LONGEST = 4
#: Bits of a block, and how far its number is from a position's.
BLOCK, SHIFT = 8, 3
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: What ends a piece, and what stands between words.
PIECE_ENDS, BETWEEN = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"

SHARDS = "shard long, lang string, words array<string>, counts array<long>, places binary"
#: A shard's own number of a language: its task's number and its place among the task's shards.
SHARD_BITS = 24


class _Shard:
    """Words of one language in the order in which a task reads them."""

    def __init__(self):
        self.numbers: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[str]) -> None:
        """``words`` of whole pieces, each piece ended by an empty string."""
        number = self.numbers
        self.parts.append(np.fromiter((number.setdefault(w, len(number)) if w else -1 for w in words), np.int32, len(words)))
        self.size += len(words)

    def row(self, shard: int, lang: str) -> dict:
        places = np.concatenate(self.parts)
        counts = np.bincount(places[places >= 0], minlength=len(self.numbers))
        return {"shard": shard, "lang": lang, "words": list(self.numbers), "counts": counts, "places": places.tobytes()}


def _words(text: str) -> list[str]:
    """The words of a text, with an empty string after each piece that holds any."""
    ended = _ENDS.sub(" \n ", text.encode().translate(LOWER).decode())
    return ["" if w == "\n" else w for w in _GAPS.split(ended) if w] + [""]


_ENDS, _GAPS = re.compile(PIECE_ENDS), re.compile("[\x20\x09]+")


def shards(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The shards of all texts (lang, text) as a written table. A task's memory is a shard for each language that it is reading."""
    ship(docs.sparkSession)
    schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("places", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << SHARD_BITS, 0
        filling: dict[str, _Shard] = {}
        for batch in (part for whole in batches for part in slices(whole)):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                shard = filling.setdefault(lang, _Shard())
                shard.add(_words(text))
                if shard.size >= shard_words:
                    yield pa.RecordBatch.from_pylist([filling.pop(lang).row(first + made, lang)], schema=schema)
                    made += 1
            # Many small languages share the memory of one large shard.
            while sum(s.size for s in filling.values()) >= 4 * shard_words:
                lang = max(filling, key=lambda x: filling[x].size)
                yield pa.RecordBatch.from_pylist([filling.pop(lang).row(first + made, lang)], schema=schema)
                made += 1
        for lang, shard in filling.items():
            yield pa.RecordBatch.from_pylist([shard.row(first + made, lang)], schema=schema)
            made += 1

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return written(rows.where("text <> ''").mapInArrow(gather, SHARDS), "shards")


class Bitmaps:
    """The compressed position bitmaps of a shard's words, by word and by block."""

    def __init__(self, places: np.ndarray):
        """``places``: the number of the word at each position, below 0 for none."""
        at = np.flatnonzero(places >= 0)
        word = places[at].astype(np.int64)
        blocks = (len(places) >> SHIFT) + 2
        by_word = np.argsort(word * blocks + (at >> SHIFT), kind="stable")
        key = (word * blocks + (at >> SHIFT))[by_word]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        bits = (1 << (at[by_word] & (BLOCK - 1))).astype(np.uint8)
        #: A row for each word and each of its blocks, in order of both.
        self.word, self.block = key[first] // blocks, key[first] % blocks
        self.bits = np.bitwise_or.reduceat(bits, first) if len(first) else bits
        order = np.argsort(self.block, kind="stable")
        #: The same rows by block.
        self.b_word, self.b_bits = self.word[order], self.bits[order]
        self.b_start = np.searchsorted(self.block[order], np.arange(blocks + 1))

    def moved(self, node: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bitmaps moved on by one position: what leaves a block at its end enters the next."""
        stay, leave = (bits << 1).astype(np.uint8), bits >> (BLOCK - 1)
        s, x = np.flatnonzero(stay), np.flatnonzero(leave)
        return np.r_[node[s], node[x]], np.r_[block[s], block[x] + 1], np.r_[stay[s], leave[x]]

    def cuts(self, block: np.ndarray) -> np.ndarray:
        """With how many words' blocks each block is cut."""
        return self.b_start[block + 1] - self.b_start[block]

    def extend(self, node: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The bitmaps of all phrases that are one word longer: node, word, block, bits."""
        node, block, bits = self.moved(node, block, bits)
        n = self.cuts(block)
        row = np.repeat(np.arange(len(n)), n)
        with_ = np.arange(len(row)) + np.repeat(self.b_start[block] - (np.cumsum(n) - n), n)
        left = bits[row] & self.b_bits[with_]
        kept = np.flatnonzero(left)
        return node[row[kept]], self.b_word[with_[kept]], block[row[kept]], left[kept]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal keys together, and where each group starts in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def extended(maps: Bitmaps, may_follow, longest: int, most_cuts: int = MOST_CUTS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All phrases of two to ``longest`` words, depth first: arrays of words, a row for each phrase, and their counts.

    ``may_follow(a, b)`` says for arrays of words which b is asked for behind which a.
    """
    firsts, starts = np.unique(maps.word, return_index=True)
    # A group of sisters: their words (a row each), and their bitmaps' rows in order.
    stack = [(firsts[:, None], np.repeat(np.arange(len(firsts)), np.diff(np.r_[starts, len(maps.word)])), maps.block, maps.bits)]
    while stack:
        words, node, block, bits = stack.pop()
        if not len(node):
            continue
        cost = np.cumsum(maps.cuts(block) + maps.cuts(block + 1))
        if cost[-1] > most_cuts and len(words) > 1:
            # The first half of the sisters goes deep before the second is looked at.
            half = np.searchsorted(node, len(words) // 2)
            stack.append((words[len(words) // 2 :], node[half:] - len(words) // 2, block[half:], bits[half:]))
            stack.append((words[: len(words) // 2], node[:half], block[:half], bits[:half]))
            continue
        node, word, block, bits = maps.extend(node, block, bits)
        asked = np.flatnonzero(may_follow(words[node, -1], word))
        node, word, block, bits = node[asked], word[asked], block[asked], bits[asked]
        if not len(node):
            continue
        order, first = _groups(node, word)
        counts = np.add.reduceat(np.bitwise_count(bits[order]).astype(np.int64), first)
        longer = np.c_[words[node[order[first]]], word[order[first]]]
        yield longer, counts
        if longer.shape[1] < longest:
            stack.append((longer, np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)])), block[order], bits[order]))


def _places(shard: pd.DataFrame, local: np.ndarray) -> np.ndarray:
    """A shard's positions, by the place of each word in ``local`` (words' own numbers in the shard); -1 for other words."""
    places = np.frombuffer(shard["places"].iloc[0], np.int32)
    number = np.full(max(int(places.max(initial=-1)), int(local.max(initial=-1))) + 2, -1, np.int32)
    number[local] = np.arange(len(local), dtype=np.int32)
    return number[places]  # the last entry stands for -1


def frequent_words(table: DataFrame, min_count: int) -> DataFrame:
    """Words of a language found so often: lang, word, f, number (different for all, not dense). A written table."""
    each = table.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    found = each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    kept = written(found, "words")
    return written(kept.select("lang", "word", "f", F.monotonically_increasing_id().alias("number")), "words")


def _known_words(table: DataFrame, frequent: DataFrame) -> DataFrame:
    """The frequent words of each shard: shard, local (the word's number in the shard), number. A written table."""
    each = table.select("shard", "lang", F.posexplode("words").alias("local", "word"))
    return written(each.join(frequent.select("lang", "word", "number"), ["lang", "word"]).select("shard", "local", "number"), "known-words")


def _pairs(table: DataFrame, known: DataFrame) -> DataFrame:
    """Counts of all pairs of frequent words in each shard: shard, a, b (words' numbers), n."""

    def count(shard: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(words):
            return pd.DataFrame(columns=["shard", "a", "b", "n"])
        number = words["number"].to_numpy()
        maps = Bitmaps(_places(shard, words["local"].to_numpy()))
        found = list(extended(maps, lambda a, b: np.ones(len(a), bool), 2))
        phrases, counts = np.concatenate([np.zeros((0, 2), np.int64), *[p for p, _ in found]]), np.concatenate([np.zeros(0, np.int64), *[n for _, n in found]])
        return pd.DataFrame({"shard": shard["shard"].iloc[0], "a": number[phrases[:, 0]], "b": number[phrases[:, 1]], "n": counts})

    both = table.select("shard", "places").groupBy("shard").cogroup(known.groupBy("shard"))
    return both.applyInPandas(count, "shard long, a long, b long, n long")


def _longer(table: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts of phrases of three and four words, each two of which are a frequent pair: shard's words' numbers, and n."""
    numbers = [f"w{k}" for k in range(LONGEST)]
    words = known.select("shard", F.lit(0).alias("kind"), F.col("local").cast("long").alias("a"), F.col("number").alias("b"))
    both = words.unionByName(pairs.select("shard", F.lit(1).alias("kind"), "a", "b"))

    def count(shard: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        is_word = held["kind"].to_numpy() == 0
        if not len(shard) or is_word.all():
            return pd.DataFrame(columns=[*numbers, "n"])
        local, number = held["a"].to_numpy()[is_word], held["b"].to_numpy()[is_word]
        order = np.argsort(number)
        local, number = local[order], number[order]
        first, second = (np.searchsorted(number, held[c].to_numpy()[~is_word]) for c in ("a", "b"))
        asked = np.unique(first * len(number) + second)
        maps = Bitmaps(_places(shard, local))

        def may_follow(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = a.astype(np.int64) * len(number) + b
            return asked[np.minimum(np.searchsorted(asked, key), len(asked) - 1)] == key

        found = [(np.pad(number[p], ((0, 0), (0, LONGEST - p.shape[1])), constant_values=-1), n) for p, n in extended(maps, may_follow, LONGEST) if p.shape[1] > 2]
        phrases, counts = np.concatenate([np.zeros((0, LONGEST), np.int64), *[p for p, _ in found]]), np.concatenate([np.zeros(0, np.int64), *[n for _, n in found]])
        return pd.DataFrame(phrases, columns=numbers).assign(n=counts)

    made = table.select("shard", "places").groupBy("shard").cogroup(both.groupBy("shard"))
    return made.applyInPandas(count, ", ".join(f"{c} long" for c in numbers) + ", n long")


def phrase_counts(docs: DataFrame, min_count: int, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """All words and phrases of up to four words found so often in their language (lang, phrase, k words, f), and each language's number of words (lang, n)."""
    table = shards(docs, shard_words)
    totals = table.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = frequent_words(table, min_count)
    known = _known_words(table, frequent)
    # A pair's rows meet once: its whole count stands beside each shard that holds it.
    counted = _pairs(table, known).withColumn("f", F.sum("n").over(Window.partitionBy("a", "b"))).where(F.col("f") >= min_count)
    pairs = written(counted.select("shard", "a", "b", "f"), "pairs")
    numbers = [f"w{k}" for k in range(LONGEST)]
    longer = _longer(table, known, pairs).groupBy(numbers).agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    two = pairs.groupBy("a", "b").agg(F.max("f").alias("f")).select(F.col("a").alias("w0"), F.col("b").alias("w1"), F.lit(-1).cast("long").alias("w2"), F.lit(-1).cast("long").alias("w3"), "f")
    found = written(two.unionByName(longer.select(*numbers, "f")), "phrases")
    # A phrase's words by their numbers.
    place = F.posexplode(F.filter(F.array(*numbers), lambda x: x >= 0)).alias("place", "number")
    named = found.select(F.struct(*numbers).alias("p"), "f", place).join(frequent.select("number", "lang", "word"), "number")
    spelled = named.groupBy("p", "f").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
    phrases = spelled.select("lang", F.array_join(F.transform("words", lambda x: x["word"]), " ").alias("phrase"), F.size("words").alias("k"), "f")
    singles = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("k"), "f")
    return written(singles.unionByName(phrases), "counts"), totals


def _parts(words: Column, k: Column, least: int) -> Column:
    """The proper parts of at least so many words that stand together in a phrase."""
    place = F.sequence(F.lit(0), k - least)
    cut = lambda i: F.transform(F.sequence(F.lit(least), k - i), lambda n: F.array_join(F.slice(words, i + 1, n), " "))
    return F.filter(F.flatten(F.transform(place, cut)), lambda x: x != F.array_join(words, " "))


def mine_collocations(docs: DataFrame, min_count: int = 30, most: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Each language's ``most`` best phrases of docs (lang, text): lang, rank, phrase, a, l, r, n, score.

    ``a`` is the phrase's count, l and r those of its two parts at the cut of the lowest score, which is 2,000,000 a / (l + r) rounded down.
    A phrase that lies inside a longer one with at least 80 % of its count is left out.
    """
    counts, totals = phrase_counts(docs, min_count, shard_words)
    cand = counts.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    # Every cut of every phrase asks for the counts of its two parts.
    part = lambda words: F.array_join(words, " ")
    at = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = cand.select("lang", "phrase", "k", "a", "words", at).select("lang", "phrase", "a", "cut", part(F.slice("words", 1, F.col("cut"))).alias("left"), part(F.slice("words", F.col("cut") + 1, F.col("k"))).alias("right"))
    of = lambda name, f: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("CAST(2000000 AS DECIMAL(10, 0)) * CAST(a AS DECIMAL(20, 0)) DIV CAST(l + r AS DECIMAL(20, 0))")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    inside = cand.where("k > 2").select("lang", F.col("a").alias("longer"), F.explode(_parts(F.col("words"), F.col("k"), 2)).alias("phrase"))
    within = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = lowest.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * 80))
    best = kept.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
    # A language's best of each part first, so that no task sees all of a language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= most)
    some = ranked(best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))), "lang", "salt").drop("rank", "salt")
    return ranked(some, "lang").join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_sql(min_count: int, most: int) -> str:
    """DuckDB SQL: all runs of one to four words are counted by their text."""
    return rf"""
    WITH p AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents WHERE text IS NOT NULL
    ), w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
    ), g AS (
      SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k
    ), c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
    ), t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM c WHERE k = 1 GROUP BY lang
    ), d AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM c WHERE k > 1 AND f >= {min_count}
    ), u AS (SELECT *, unnest(range(1, k)) AS cut FROM d
    ), s AS (
      SELECT u.lang, u.phrase, u.a, u.cut, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * u.a // (x.f + y.f) AS BIGINT) AS score
      FROM u JOIN c x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:u.cut], ' ')
             JOIN c y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.cut + 1:u.k], ' ')
    ), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
    ), i AS (
      SELECT d.lang, array_to_string(d.w[i:i + m - 1], ' ') AS phrase, max(d.a) AS longer
      FROM d, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < d.k AND i + m - 1 <= d.k GROUP BY ALL
    ), r AS (
      SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < 80 * b.a
    )
    SELECT r.lang, rank, r.phrase, a, l, r, n, score FROM r JOIN t ON t.lang = r.lang WHERE rank <= {most}"""

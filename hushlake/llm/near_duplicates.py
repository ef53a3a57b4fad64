"""Operator 7: the n-gram Jaccard join by MinHash banding.

Documents are sets of hashed five-word shingles. Documents with the same set form one node. MinHash values are
cut into bands whose number and length are chosen for a target recall at the threshold; nodes are shuffled on
band hashes, and nodes that share one are candidates. Every candidate pair is verified on the full sets.

Pairs are never written out. Candidates are compared where they meet, in blocks, and each block pair yields only
the number of links of each node and a spanning forest of its links. The meeting place is the
candidates' connected component while that is small, so that a set travels once for each block; a component of more
than ``component_nodes`` nodes is compared bucket by bucket instead, each pair in its first common band. Blocks are dealt
by a hash and hold a bounded number of nodes and shingles, so no task grows with a group.

Defined results: a text of fewer than five words is one shingle of all its words; a null or empty text has no shingle, no link, and is
a class of its own; a row without a doc_id takes no part and has a null class; rows with equal sets are linked to each other, also if they
share a doc_id; an empty table stays empty; other columns are ignored or, in ``one_of_each_class``, kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .quality import split_words
from .shared import ship, slices, small_batches, written

THRESHOLD, NGRAM, RECALL, MOST_HASHES = 0.8, 5, 0.9999, 256
#: Nodes of a component up to which its nodes meet as a whole, and bounds of a block.
COMPONENT_NODES, BLOCK_NODES, BLOCK_SHINGLES = 4096, 512, 1_000_000

SKETCH = "k1 long, k2 long, node binary, n int, bands array<long>"
LINKS = "node binary, root binary, n_links long"


def choose_bands(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): the longest bands that reach the recall at the threshold with so many hashes."""
    best = (most_hashes, 1)
    for rows in range(1, most_hashes + 1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


def shingles(text: Column, ngram: int = NGRAM) -> Column:
    """Distinct 64-bit hashes of a text's word n-grams; the text must not be null."""
    words = split_words(text)

    def grams(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - ngram)
        many = F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(ngram)]))
        one = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= ngram, many).when(F.size(w) > 0, one).otherwise(F.array().cast("array<long>"))

    return F.array_distinct(F.element_at(F.transform(F.array(words), grams), 1))


def _sketcher(bands: int, rows: int, seed: int):
    random = np.random.default_rng(seed)
    multiply = (random.integers(0, 2**31, bands * rows, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
    add = random.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole_batch in batches for part in slices(whole_batch)):
            listed = batch.column("shingles")
            at = listed.offsets.to_numpy().astype(np.int64)
            values = listed.values.to_numpy()[at[0] : at[-1]].view(np.uint64)
            at -= at[0]
            sizes = np.diff(at)
            full = np.flatnonzero(sizes)
            nodes: list[bytes | None] = [None] * len(sizes)
            for i in full:
                nodes[i] = hashlib.blake2b(np.sort(values[at[i] : at[i + 1]]).tobytes(), digest_size=16).digest()
            keys = np.zeros((len(full), bands), np.uint64)
            if len(full):
                short = (mixed(values) >> np.uint64(32)).astype(np.uint32)
                starts = at[:-1][full]
                for band in range(bands):
                    key = np.full(len(full), band + 1, np.uint64)
                    for k in range(band * rows, (band + 1) * rows):
                        least = np.minimum.reduceat(short * multiply[k] + add[k], starts)
                        key = mixed(key + least)
                    keys[:, band] = key
            out = iter(keys.view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1"),
                    batch.column("k2"),
                    pa.array(nodes, pa.binary()),
                    pa.array(sizes.astype(np.int32)),
                    pa.array([next(out) if x is not None else None for x in nodes], pa.list_(pa.int64())),
                ],
                names=["k1", "k2", "node", "n", "bands"],
            )

    return sketch


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number in each of n nodes' component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _common(a: list[np.ndarray], b: list[np.ndarray], pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of sets a[i] and b[j] for the pairs (i, j)."""
    if len(pairs[0]) <= 4 * (len(a) + len(b)):
        return np.array([len(np.intersect1d(a[i], b[j], assume_unique=True)) for i, j in zip(*pairs, strict=True)], np.int64)
    values, number = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    shared = np.bincount(number) > 1  # a shingle of one set is in no intersection
    new = np.cumsum(shared) - 1
    keep = shared[number]
    number, row = new[number[keep]], row[keep]
    order = np.argsort(number, kind="stable")
    number, row = number[order], row[order]
    total = np.zeros((len(a), len(b)), np.float32)
    for start in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(number, [start, start + 4096])
        held = np.zeros((len(a) + len(b), 4096), np.float32)
        held[row[lo:hi], number[lo:hi] - start] = 1
        total += held[: len(a)] @ held[len(a) :].T
    return total[pairs].astype(np.int64)


def _comparer(threshold: float):
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, band, low, high = key
        rows = rows.drop_duplicates("node")
        left, right = (rows[rows["block"] == b].reset_index(drop=True) for b in (low, high))
        if left.empty or right.empty:
            return pd.DataFrame(columns=["node", "root", "n_links"])
        sets = [[np.asarray(x, np.int64) for x in f["shingles"]] for f in (left, right)]
        bands = [np.array(f["bands"].tolist(), np.int64) for f in (left, right)]
        sizes = [np.array([len(x) for x in s], np.int64) for s in sets]
        near = np.minimum.outer(sizes[0], sizes[1]) >= threshold * np.maximum.outer(sizes[0], sizes[1]) - 1e-9
        meet = np.zeros_like(near)
        for k in range(bands[0].shape[1]):
            same = bands[0][:, k][:, None] == bands[1][:, k][None, :]
            if k == band:
                meet = same & ~meet  # candidates of this bucket that share no earlier band
                break
            meet |= same
        if low == high:
            meet = np.triu(meet, 1)
        pairs = np.nonzero(meet & near)
        common = _common(*sets, pairs)
        good = common >= threshold * (sizes[0][pairs[0]] + sizes[1][pairs[1]] - common) - 1e-9
        i, j = pairs[0][good], pairs[1][good]
        copies = [f["copies"].to_numpy() for f in (left, right)]
        n, shift = len(left) + (0 if low == high else len(right)), 0 if low == high else len(left)
        links = np.zeros(n, np.int64)
        np.add.at(links, i, copies[1][j])
        np.add.at(links, j + shift, copies[0][i])
        label = _forest(n, i, j + shift)
        nodes = left["node"].tolist() + ([] if low == high else right["node"].tolist())
        linked = np.flatnonzero(links)
        return pd.DataFrame({"node": [nodes[x] for x in linked], "root": [nodes[label[x]] for x in linked], "n_links": links[linked]})

    return compare


def near_duplicates(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    ngram: int = NGRAM,
    recall: float = RECALL,
    most_hashes: int = MOST_HASHES,
    component_nodes: int = COMPONENT_NODES,
    block_nodes: int = BLOCK_NODES,
    seed: int = 1,
) -> DataFrame:
    """A row for each of ``docs`` (doc_id, text): k1 (doc_id), k2 (hash of the text), class_id, class_key, n_links.

    n_links: other documents of a similarity of ``threshold`` or more. A class is what links connect; class_id is its least doc_id.
    """
    ship(docs.sparkSession)
    known = docs.select(F.col("doc_id").cast("long").alias("k1"), F.xxhash64("text").alias("k2"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    bands, rows = choose_bands(threshold, recall, most_hashes)
    listed = known.where("k1 IS NOT NULL").select("k1", "k2", shingles(F.col("t"), ngram).alias("shingles"))
    with small_batches(docs.sparkSession):
        sketches = written(listed.mapInArrow(_sketcher(bands, rows, seed), SKETCH), "sketches")
    nodes = written(
        sketches.where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min(F.struct("k1", "k2")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("n").alias("n")),
        "nodes",
    )

    held = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    centers = held.groupBy("bucket").agg(F.min("node").alias("center"), F.max("node").alias("other")).where("center <> other").select("bucket", "center")
    stars = held.join(centers, "bucket").select(F.col("node").alias("a"), F.col("center").alias("b"))
    candidates = written(connected_components(stars), "candidates")
    members = candidates.join(nodes.select("node", "n", "bands"), "node")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles"))
    sized = members.join(sizes, "component")
    whole = sized.where(F.col("nodes") <= component_nodes).select(F.col("component").alias("place"), F.lit(-1).alias("band"), "node", "nodes", "shingles")
    apart = sized.where(F.col("nodes") > component_nodes).select("node", "n", F.posexplode("bands").alias("band", "bucket"))
    buckets = apart.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles")).where("nodes > 1")
    split = apart.join(buckets, ["band", "bucket"]).select(F.col("bucket").cast("string").cast("binary").alias("place"), "band", "node", "nodes", "shingles")
    blocks = F.greatest(F.ceil(F.col("nodes") / block_nodes), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = whole.unionByName(split).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = dealt.select("place", "band", "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    paired = paired.select("place", "band", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "node", "block")

    # Full sets of the nodes that have a candidate, from one document of each.
    needed = candidates.join(nodes, "node").select("node", "first.k1", "first.k2", "copies", "bands")
    texts = known.join(needed, ["k1", "k2"]).dropDuplicates(["node"])
    sets = texts.select("node", "copies", "bands", shingles(F.col("t"), ngram).alias("shingles"))
    compared = paired.join(sets, "node").groupBy("place", "band", "low", "high").applyInPandas(_comparer(threshold), LINKS)
    links = written(compared, "links")

    classes = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("n_links").alias("linked"))
    joined = (
        nodes.select("node", "copies", F.col("first.k1").alias("least"))
        .join(counts, "node", "left")
        .join(classes, "node", "left")
        .select("node", "least", F.coalesce("component", "node").alias("class_key"), (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    )
    firsts = joined.groupBy("class_key").agg(F.min("least").alias("class_id"))
    of_node = written(joined.join(firsts, "class_key").select("node", "class_key", "class_id", "n_links"), "classes")
    found = sketches.select("k1", "k2", "node").join(of_node, "node", "left")
    out = found.select("k1", "k2", F.coalesce("class_id", "k1").alias("class_id"), "class_key", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    without = known.where("k1 IS NULL").select("k1", "k2", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("binary").alias("class_key"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(without)


def one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each class: the first by doc_id. Documents without words or without a doc_id stay."""
    found = near_duplicates(docs, **options)
    firsts = found.where("class_key IS NOT NULL").groupBy("class_key").agg(F.min(F.struct("k1", "k2")).alias("first")).select("first.k1", "first.k2")
    known = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("k1"), F.xxhash64("text").alias("k2"))
    bare = F.col("k1").isNull() | (F.size(split_words(F.coalesce(F.col("row.text").cast("string"), F.lit("")))) == 0)
    kept = known.where(~bare).join(firsts, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return kept.unionByName(known.where(bare)).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])

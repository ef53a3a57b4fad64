"""Operator 6: exact top-k inner products by a paged M-tree, searched best-first.

Vectors are whole numbers, floor(1024 x) of each component, which a double holds exactly. The inner product is no metric, so each vector gets one further
coordinate that gives all of them the same norm; in that space the nearest by Euclidean distance is the highest by inner product.

The tree: an inner page lists its children's routing objects (vectors of the child's own, the first by a hash), each with its covering radius and its
distance to the page's own routing object; a leaf page lists vectors with their ids and that distance. Every vector goes to its nearest routing
object on each level. Nodes of more than ``TASK_ROWS`` vectors are split by Spark, a level a round, in tasks of bounded size; what is
below is built in one task for each node. A split that leaves most vectors with one routing object (they are all about as far apart) is
followed by one that deals them evenly, so the depth grows with the logarithm of the vectors. Pages are a table bucketed by
node: queries are shuffled to the pages, which stay where they are.

The search: each query has a queue of nodes in order of their bounds, the least distance that any vector below can have. A
round takes the first node from each queue (eight, then sixty-four and more once every query has seen a leaf), brings the queries of each node
together in blocks, and reads its page once for each block. A child or vector whose stored distance to the routing object differs from the query's by more
than the query's reach is left out without computing its distance (the triangle inequality); other children enter the
queue with their bound. The query's worst score so far bounds its reach, and a queue ends where its next bound is beyond it. Bounds are
floating-point with a margin; scores are exact.

Equal vectors are indexed once with their k + 1 least ids, which is all that any query can return of them.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id; equal rows count once; scores
beyond a long are held at its limits; a missing component at the end of a shorter vector is 0; a
query without other vectors has no rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_folder, release, ship, written

SCALE = 1024
#: Vectors of a leaf page, children of an inner one, vectors of a node that one task splits, queries of a block.
PAGE_ROWS, FAN_OUT, TASK_ROWS, BLOCK_QUERIES = 512, 64, 8192, 256
#: A child with this share of its parent's vectors is split evenly. Nodes taken from a queue at a time, and pages that may be broadcast.
STUCK, MOST_TAKEN, FEW_PAGES = 0.75, 1024, 32

PLACED = "node string, key binary, v binary, ids array<long>, d double, of long"
PAGE = "node string, children array<string>, matrix binary, distances binary, radii binary, ids array<array<long>>"
FOUND = "q long, hits array<struct<minus:long,vec_id:long>>, pushed array<struct<bound:double,node:string,near:double>>"
RESULT = "query_id long, rank int, vec_id long, score long"
MOST = 2**63 - 1


def quantised(embedding: Column) -> Column:
    """floor(1024 x) of each component as a double; null for vectors that take no part."""
    scaled = F.transform(embedding, lambda x: x.cast("double") * SCALE)
    fine = F.forall(scaled, lambda y: F.coalesce(~F.isnan(y) & (F.abs(y) < float("inf")), F.lit(False)))
    return F.when(embedding.isNotNull() & fine, F.transform(scaled, lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)))


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        v = [np.asarray(x, "<f8").tobytes() for x in batch["v"]]
        with np.errstate(over="ignore"):
            norm2 = [float((np.frombuffer(x) ** 2).sum()) for x in v]
        key = [hashlib.blake2b(x, digest_size=16).digest() for x in v]
        yield pd.DataFrame({"vec_id": batch["vec_id"], "key": key, "v": v, "norm2": norm2})


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole-numbered matrices, held within a long."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < 2**53:
        return (a @ b.T).astype(np.int64)
    if largest < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(whole(a) @ whole(b).T, -MOST, MOST).astype(np.int64)


class Space:
    """The metric space of vectors of a norm (squared) that all have with their further coordinate, which is 0 for queries."""

    def __init__(self, dim: int, norm2: float):
        self.dim, self.norm2, self.flat = dim, norm2, not np.isfinite(4 * norm2)

    def matrix(self, vectors) -> np.ndarray:
        size = 8 * self.dim
        return np.frombuffer(b"".join(x if len(x) == size else x.ljust(size, b"\0") for x in vectors), "<f8").reshape(-1, self.dim)

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Distances of two sets of vectors; all 0, which bounds nothing, where norms are beyond floating-point numbers."""
        if self.flat:
            return np.zeros((len(x), len(y)))
        more = [np.sqrt(np.maximum(self.norm2 - (m**2).sum(1), 0)) for m in (x, y)]
        return np.sqrt(np.maximum(2 * self.norm2 - 2 * (x @ y.T + np.outer(*more)), 0))

    def of_queries(self, q: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.zeros((len(q), len(y)))
        return np.sqrt(np.maximum((q**2).sum(1)[:, None] + self.norm2 - 2 * (q @ y.T), 0))

    def reach(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The distance within which a vector must lie of each query to have this score or more; with a margin."""
        if self.flat:
            return np.full(len(q), np.inf)
        both = (q**2).sum(1) + self.norm2
        return np.sqrt(np.maximum(both - 2 * least, 0)) + 1e-5 * np.sqrt(both) + 1e-6

    def reach_column(self, norm2: Column, least: Column) -> Column:
        """``reach`` in Spark, for the queries' norms."""
        both = norm2 + F.lit(self.norm2)
        return F.sqrt(F.greatest(both - 2 * least, F.lit(0.0))) + 1e-5 * F.sqrt(both) + 1e-6


def _nearest(space: Space):
    """Vectors of one node, or a part of them, to the nearest of its routing objects."""

    def place(rows: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or seeds.empty:
            return pd.DataFrame(columns=["node", "key", "v", "ids", "d", "of"])
        seeds = seeds.sort_values("place")
        d = space.between(space.matrix(rows["v"]), space.matrix(seeds["v"]))
        child = d.argmin(1)
        if seeds["evenly"].iloc[0]:
            number = {k: i for i, k in enumerate(seeds["key"])}
            child = np.array([number.get(k, int.from_bytes(k[:8], "big") % len(seeds)) for k in rows["key"]])
        names = seeds["child"].to_numpy()
        return pd.DataFrame({"node": names[child], "key": rows["key"], "v": rows["v"], "ids": rows["ids"], "d": d[np.arange(len(d)), child], "of": seeds["n"].iloc[0]})

    return place


def _page(space: Space, name: str, x: np.ndarray, d: np.ndarray, children=None, radii=None, ids=None) -> dict:
    packed = lambda a: None if a is None else np.ascontiguousarray(a, "<f8").tobytes()
    return {"node": name, "children": children, "matrix": packed(x), "distances": packed(d), "radii": packed(radii), "ids": ids}


def _branches(space: Space, page_rows: int, fan_out: int):
    """All vectors of a node to the pages of its part of the tree."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key").reset_index(drop=True)
        x, ids, pages = space.matrix(rows["v"]), rows["ids"].tolist(), []
        todo = [(rows["node"].iloc[0], np.arange(len(x)), rows["d"].to_numpy())]
        while todo:
            name, at, d = todo.pop()
            if len(at) <= page_rows:
                pages.append(_page(space, name, x[at], d, ids=[[int(i) for i in ids[k]] for k in at]))
                continue
            n = max(2, min(fan_out, 2 * -(-len(at) // page_rows)))
            far = space.between(x[at], x[at[:n]])
            child = far.argmin(1)
            if np.bincount(child).max() > STUCK * len(at):
                child = np.arange(len(at)) % n
            near = far[np.arange(len(at)), child]
            held = [c for c in range(n) if (child == c).any()]
            names = [f"{name}.{c}" for c in held]
            pages.append(_page(space, name, x[at[held]], d[held], names, [near[child == c].max() for c in held]))
            todo += [(f"{name}.{c}", at[child == c], near[child == c]) for c in held]
        return pd.DataFrame(pages)

    return build


def _inner(space: Space):
    """The children of one node to its page."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_page(space, rows["node"].iloc[0], space.matrix(rows["v"]), rows["d"].to_numpy(), rows["child"].tolist(), rows["radius"].to_numpy())])

    return build


def build_tree(distinct: DataFrame, space: Space, page_rows: int = PAGE_ROWS, fan_out: int = FAN_OUT, task_rows: int = TASK_ROWS) -> DataFrame:
    """The pages (columns of PAGE) over distinct vectors (key, v, ids); the root's name is ``r``."""
    placed = distinct.select(F.lit("r").alias("node"), "key", "v", "ids", F.lit(0.0).alias("d"), F.lit(MOST).alias("of"))
    small, inner = [], []
    while True:
        sizes = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("of").alias("whole"))
        evenly = (F.col("n") > STUCK * F.col("whole")).alias("evenly")
        big = written(sizes.where(F.col("n") > task_rows).select("node", "n", evenly, F.ceil(F.col("n") / task_rows).cast("int").alias("parts")), "tree-nodes")
        small.append(placed.join(big, "node", "left_anti"))
        if big.isEmpty():
            break
        split = placed.join(big, "node")
        first = F.row_number().over(Window.partitionBy("node").orderBy("key"))
        seeds = split.select("node", "key", "v", "d", "n", "evenly", "parts", first.alias("place")).where(F.col("place") <= fan_out)
        seeds = written(seeds.withColumn("child", F.concat_ws(".", "node", "place")), "tree-seeds")
        part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part")
        left = split.select("node", "key", "v", "ids", part).groupBy("node", "part")
        right = seeds.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).groupBy("node", "part")
        placed = written(left.cogroup(right).applyInPandas(_nearest(space), PLACED), "tree-level")
        radii = placed.groupBy("node").agg(F.max("d").alias("radius")).withColumnRenamed("node", "child")
        inner.append(seeds.select("node", "child", "v", "d").join(radii, "child"))
    rows = small[0]
    for more in small[1:]:
        rows = rows.unionByName(more)
    pages = rows.groupBy("node").applyInPandas(_branches(space, page_rows, fan_out), PAGE)
    for level in inner:
        pages = pages.unionByName(level.groupBy("node").applyInPandas(_inner(space), PAGE))
    return pages


def _visitor(space: Space, k: int):
    """A page and a block of queries to their hits in it and the children that they must still see."""

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                yield one(row)

    def one(row) -> pd.DataFrame:
        q, least, near = space.matrix(row.v), np.asarray(row.least, float), np.asarray(row.near, float)
        reach = space.reach(q, least)
        x, d = np.frombuffer(row.matrix, "<f8").reshape(-1, space.dim), np.frombuffer(row.distances, "<f8")
        apart = np.abs(near[:, None] - d[None, :])
        hits, pushed = [[] for _ in q], [[] for _ in q]
        if row.children is not None:
            radii = np.frombuffer(row.radii, "<f8")
            open_ = apart - radii <= reach[:, None]
            some = np.flatnonzero(open_.any(0))
            far = space.of_queries(q, x[some])
            bound = np.maximum(far - radii[some], 0)
            for i, j in zip(*np.nonzero(open_[:, some] & (bound <= reach[:, None])), strict=True):
                pushed[i].append({"bound": float(bound[i, j]), "node": row.children[some[j]], "near": float(far[i, j])})
        else:
            open_ = apart <= reach[:, None]
            some = np.flatnonzero(open_.any(0))
            scores = _product(q, x[some])
            for i in range(len(q)):
                hits[i] = best(scores[i], least[i], [row.ids[j] for j in some], row.query_id[i])
        return pd.DataFrame({"q": row.q, "hits": hits, "pushed": pushed})

    def best(scores: np.ndarray, least: float, ids: list, own: int) -> list[dict]:
        """At most k of one query; of its k + 1 best vectors, one may have no id but the query's own."""
        floor = max(least, np.partition(scores, -k - 1)[-k - 1] if len(scores) > k + 1 else -np.inf)
        found = sorted((-int(scores[j]), int(i)) for j in np.flatnonzero(scores >= floor) for i in ids[j] if i != own)
        return [{"minus": s, "vec_id": i} for s, i in found[:k]]

    return visit


def search_tree(pages: DataFrame, queries: DataFrame, space: Space, k: int, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """For queries (q, query_id, v, norm2) the rows of ``best`` (minus, vec_id), and ``n_pages``, the pages that each has read."""
    best, queue = FOUND.split("hits ")[1].split(", pushed ")
    start = F.array(F.struct(F.lit(0.0).alias("bound"), F.lit("r").alias("node"), F.lit(0.0).alias("near"))).cast(queue)
    active = queries.select("*", F.array().cast(best).alias("best"), F.lit(float("-inf")).alias("least"), start.alias("queue"), F.lit(0).cast("long").alias("n_pages"))
    done, take = [], 1
    while True:
        asked = active.select("q", "query_id", "v", "least", F.explode(F.slice("queue", 1, take)).alias("e")).select("q", "query_id", "v", "least", "e.node", "e.near")
        counts = written(asked.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "search-counts")
        few = [r.node for r in counts.select("node").limit(FEW_PAGES + 1).collect()]
        block = F.pmod(F.xxhash64("q"), F.ceil(F.col("n") / block_queries)).alias("block")
        listed = asked.join(counts, "node").select("*", block).groupBy("node", "block").agg(F.collect_list(F.struct("q", "query_id", "v", "least", "near")).alias("a"))
        blocks = listed.select("node", *[F.col(f"a.{c}").alias(c) for c in ("q", "query_id", "v", "least", "near")])
        # The upper levels' pages are few and met by all queries: at most FEW_PAGES pages of bounded size are broadcast.
        met = blocks.join(F.broadcast(pages.where(F.col("node").isin(few))) if len(few) <= FEW_PAGES else pages, "node")
        found = met.mapInPandas(_visitor(space, k), FOUND).groupBy("q").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("pushed")).alias("pushed"), F.count(F.lit(1)).alias("pages"))
        new = active.join(found, "q", "left").withColumn("best", F.slice(F.array_sort(F.concat("best", F.coalesce("hits", F.array().cast(best)))), 1, k))
        new = new.withColumn("least", F.when(F.size("best") == k, -F.element_at("best", -1)["minus"].cast("double")).otherwise(F.lit(float("-inf"))))
        new = new.withColumn("reach", space.reach_column(F.col("norm2"), F.col("least")))
        left = F.concat(F.slice("queue", take + 1, F.size("queue")), F.coalesce("pushed", F.array().cast(queue)))
        new = new.withColumn("queue", F.array_sort(F.filter(left, lambda e: e["bound"] <= F.col("reach"))))
        table = written(new.select(*queries.columns, "best", "least", "queue", (F.col("n_pages") + F.coalesce("pages", F.lit(0))).alias("n_pages")), "search-round")
        done.append(table.where(F.size("queue") == 0).select("q", "query_id", "best", "n_pages"))
        waiting, blind = table.agg(F.count_if(F.size("queue") > 0), F.count_if((F.size("queue") > 0) & (F.size("best") == 0))).first()
        release(counts)
        if not waiting:
            break
        active, take = table.where(F.size("queue") > 0), 1 if blind else min(8 * take, MOST_TAKEN)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _clean(df: DataFrame) -> DataFrame:
    whole = df.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    return whole.mapInPandas(_pack, "vec_id long, key binary, v binary, norm2 double")


def indexed(vectors: DataFrame, k: int, page_rows: int = PAGE_ROWS, fan_out: int = FAN_OUT, task_rows: int = TASK_ROWS) -> tuple[Space, DataFrame] | None:
    """The space and the tree's pages, or None without vectors. The pages are a table bucketed by node; ``drop_index`` ends it."""
    spark = vectors.sparkSession
    ship(spark)
    known = _clean(vectors).groupBy("key", "vec_id").agg(F.first("v").alias("v"), F.first("norm2").alias("norm2"))  # equal rows meet before any window
    few = known.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    distinct = written(few.groupBy("key").agg(F.first("v").alias("v"), F.first("norm2").alias("norm2"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "vectors")
    n, size, norm2 = distinct.agg(F.count(F.lit(1)), F.max(F.length("v")), F.max("norm2")).first()
    if not n:
        return None
    space = Space(max(1, size // 8), norm2)
    pages = build_tree(distinct, space, page_rows, fan_out, task_rows)
    name, buckets = f"hushlake_pages_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    pages.repartition(buckets, "node").write.format("parquet").bucketBy(buckets, "node").option("path", new_folder(spark, "tree-pages")).saveAsTable(name)
    table = spark.table(name)
    table._name = name
    return space, table


def drop_index(pages: DataFrame) -> None:
    """Delete the pages and their entry in the catalog."""
    spark = pages.sparkSession
    location = spark.sql(f"DESCRIBE FORMATTED {pages._name}").where("col_name = 'Location'").first().data_type
    spark.sql(f"DROP TABLE {pages._name}")
    pages._written_to = location
    release(pages)


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    page_rows: int = PAGE_ROWS,
    fan_out: int = FAN_OUT,
    task_rows: int = TASK_ROWS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """For each of ``queries`` (vec_id, embedding) its ``k`` highest among ``vectors`` (vec_id, embedding): query_id, rank, vec_id, score.

    Ties go to the smaller vec_id; rows of ``vectors`` with the query's own id do not count.
    """
    spark = vectors.sparkSession
    index = indexed(vectors, k, page_rows, fan_out, task_rows)
    if index is None:
        return spark.createDataFrame([], RESULT)
    space, pages = index
    asked = _clean(queries).groupBy("key", "vec_id").agg(F.first("v").alias("v"), F.first("norm2").alias("norm2"))
    numbered = written(asked.select(F.col("vec_id").alias("query_id"), "v", "norm2"), "queries").select(F.monotonically_increasing_id().alias("q"), "*")
    numbered = written(numbered, "queries")
    found = search_tree(pages, numbered, space, k, block_queries)
    drop_index(pages)
    ranked = found.select("query_id", F.posexplode("best").alias("at", "b"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.minus")).alias("score"))

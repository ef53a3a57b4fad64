"""Operator 13: importance resampling towards target texts, by array-scored weights and external merging of sorted runs.

A text's features are its words and pairs of neighbouring words, each in a bucket by its hash. The counts of all buckets over the documents
and over the target texts give an array of gains, and a document's weight is the mean gain of its features. Adding noise hashed from
its id makes the highest scores a draw without replacement.

The draw is a distributed external sort. Each task sorts the documents that may be drawn and writes them as a run, a file of records with
the first key of every 1024 in an index at its end. Rounds of merging follow: up to ``fan_in`` runs become one, in segments of about ``rows_per_task``
records that different tasks make, each by a tournament tree over its slices of the runs. The last round merges only the segments up to the
number of documents to draw, stops within the last of them, and emits ranks.

Defined results: a null or empty text has no words and no features, and its weight is 0; a null doc_id is hashed as an empty string and is
drawn last among equal scores; rows that share a doc_id, or are equal, are documents of their own and equal keys are ranked in any order; an empty
table gives no rows; a null or empty target text has no features; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .seekable import file_system
from .shared import new_folder, release, ship, slices, written

BUCKETS = 10_000
#: Runs that a task merges at a time, and records that it makes about.
FAN_IN, ROWS_PER_TASK = 64, 500_000
#: A record: the score with its sign changed, the doc_id (the largest number for null), and the row's number.
RECORD = np.dtype([("minus", "<i8"), ("doc_id", "<i8"), ("row", "<i8")])
#: Records of a block: what a task reads of a run at a time, and what an index entry stands for.
BLOCK = 1024
NO_ID = 2**63 - 1
#: Keys of a segment from which the one that ends it is chosen.
OVERSAMPLE = 16
#: Everything but 0-9, a-z and bytes of longer characters is a space; A-Z become small.
FOLD = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def buckets_of(text: str | None) -> tuple[np.ndarray, int]:
    """The buckets of all features of a text, and its number of words."""
    words = (text or "").encode().translate(FOLD).split()
    alone = list(map(zlib.crc32, words))
    # The hash of two words goes on from that of the first and a space.
    pairs = map(zlib.crc32, islice(words, 1, None), map(zlib.crc32, repeat(b" "), alone))
    hashes = np.fromiter((h for both in (alone, pairs) for h in both), np.uint32, max(0, 2 * len(words) - 1))
    return (hashes % BUCKETS).astype(np.uint16), len(words)


def with_features(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id (null without a ``key``), buckets (unsigned 16-bit numbers), n_words and n_features of each text, as a written table."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            made = [buckets_of(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array([b.tobytes() for b, _ in made], pa.binary()), pa.array([n for _, n in made], pa.int64()), pa.array([len(b) for b, _ in made], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "buckets", "n_words", "n_features"])

    rows = docs.select((F.col(f"`{key}`") if key else F.lit(None)).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(count, "doc_id long, buckets binary, n_words long, n_features long"), "features")


def bucket_counts(features: DataFrame) -> np.ndarray:
    """How many features lie in each bucket: one array, added up by the tasks for their rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for content in batch.column("buckets"):
                total += np.bincount(np.frombuffer(content.as_buffer(), np.uint16), minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in features.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # a row for each bucket
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, 1000 times the logarithm of its share in the target over that in the source, rounded down."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(h: int) -> int:
    """Gumbel noise of a 32-bit hash, in thousandths, rounded down."""
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(features: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """row_no (a number of each row), doc_id, n_words, n_features, weight and score of features."""
    fields = ["row_no", "doc_id", "n_words", "n_features"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights, scores = [], []
            for content, h in zip(batch.column("buckets"), batch.column("h").to_pylist(), strict=True):
                found = np.frombuffer(content.as_buffer(), np.uint16)
                weights.append(int(gain[found].sum()) // len(found) if len(found) else 0)
                scores.append(weights[-1] + noise(h))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in fields], pa.array(weights, pa.int64()), pa.array(scores, pa.int64())], [*fields, "weight", "score"])

    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    rows = features.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "n_words", "n_features", "buckets", F.conv(digits, 16, 10).cast("long").alias("h"))
    return rows.mapInArrow(score, "row_no long, doc_id long, n_words long, n_features long, weight long, score long")


class RunWriter:
    """Writes one sorted file of records, whose blocks' first keys follow them; it appears under its own name only when it is complete."""

    def __init__(self, path: str, attempt: str):
        self.fs, self.path = file_system(path)
        self.temporary = f"{self.path}.{attempt}.tmp"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temporary)
        self.index: list[bytes] = []
        self.size = 0

    def add(self, records: np.ndarray) -> None:
        self.index += [records[at].tobytes() for at in range(-self.size % BLOCK, len(records), BLOCK)]
        self.out.write(records.tobytes())
        self.size += len(records)

    def close(self) -> None:
        self.out.write(b"".join(self.index) + struct.pack("<Q", self.size))
        self.out.close()
        self.fs.move(self.temporary, self.path)


class RunReader:
    """Reads records of a run's file, and finds keys in it by its index and one block."""

    def __init__(self, path: str):
        fs, inner = file_system(path)
        self.file = fs.open_input_file(inner)
        self.size = struct.unpack("<Q", self._at(self.file.size() - 8, 8))[0]

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def index(self) -> list[tuple[int, int]]:
        start = self.size * RECORD.itemsize
        keys = np.frombuffer(self._at(start, -(-self.size // BLOCK) * RECORD.itemsize), RECORD)
        return list(zip(keys["minus"].tolist(), keys["doc_id"].tolist(), strict=True))

    def records(self, start: int, stop: int) -> np.ndarray:
        return np.frombuffer(self._at(start * RECORD.itemsize, (stop - start) * RECORD.itemsize), RECORD)

    def places(self, keys: list[tuple[int, int]]) -> list[int]:
        """How many records come before each key."""
        index, out = self.index(), []
        for key in keys:
            block = max(0, bisect_left(index, key) - 1)
            some = self.records(block * BLOCK, min(self.size, (block + 1) * BLOCK))
            out.append(block * BLOCK + bisect_left(list(zip(some["minus"].tolist(), some["doc_id"].tolist(), strict=True)), key))
        return out

    def close(self) -> None:
        self.file.close()


def stream(files: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Records of slices (path, start, stop) of files that follow one another, a block in memory at a time and one file open."""
    for path, start, stop in files:
        reader = RunReader(path)
        for at in range(start, stop, BLOCK):
            yield from reader.records(at, min(stop, at + BLOCK)).tolist()
        reader.close()


def tournament(streams: list[Iterator[tuple]]) -> Iterator[tuple]:
    """All items of sorted streams in order, by a tree of losers: each item replays only the matches from its leaf to the root."""
    n = len(streams)
    over = (math.inf,)
    heads = [next(s, over) for s in streams]
    # Node k plays the winners of nodes 2k and 2k + 1; the streams are the leaves n to 2n - 1.
    losers, winners = [0] * n, [0] * n + list(range(n))
    for node in range(n - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if heads[a] <= heads[b] else (b, a)
    first = winners[1] if n > 1 else 0
    while n and heads[first] is not over:
        yield heads[first]
        heads[first] = next(streams[first], over)
        node = (first + n) // 2
        while node:
            if heads[losers[node]] < heads[first]:
                losers[node], first = first, losers[node]
            node //= 2


def write_runs(eligible: DataFrame, folder: str) -> DataFrame:
    """A sorted run for each partition of row_no, doc_id, score: run, no (of the file in its run), path, n. A written table."""
    ship(eligible.sparkSession)
    keyed = eligible.select((-F.col("score")).alias("minus"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("row_no").alias("row"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out = TaskContext.get(), None
        path = f"{folder}/run-{task.partitionId():06d}"
        for batch in batches:
            records = np.zeros(batch.num_rows, RECORD)
            for name in RECORD.names:
                records[name] = batch.column(name).to_numpy()
            if out is None and len(records):
                out = RunWriter(path, str(task.taskAttemptId()))
            if out is not None:
                out.add(records)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"run": task.partitionId(), "no": 0, "path": path, "n": out.size}], schema=pa.schema([("run", pa.int64()), ("no", pa.int64()), ("path", pa.string()), ("n", pa.int64())]))

    return written(keyed.sortWithinPartitions("minus", "doc_id").mapInArrow(write, "run long, no long, path string, n long"), "runs")


def _splits(runs: DataFrame, rows_per_task: int) -> dict[int, list[tuple[int, int]]]:
    """Keys that part each target run into segments of about so many records, from a hashed sample of its blocks' first keys.

    The driver gets OVERSAMPLE keys for each segment, and keeps one of them.
    """
    every = max(1, rows_per_task // BLOCK)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for target, path in zip(batch["target"], batch["path"], strict=True):
                reader = RunReader(path)
                yield pd.DataFrame(reader.index(), columns=["minus", "doc_id"], dtype="int64").assign(target=target)
                reader.close()

    sampled = runs.mapInPandas(keys, "minus long, doc_id long, target long").where(F.pmod(F.xxhash64("minus", "doc_id"), F.lit(every)) < OVERSAMPLE)
    out: dict[int, list[tuple[int, int]]] = {}
    for target, minus, doc_id in sorted(sampled.select("target", "minus", "doc_id").collect()):
        out.setdefault(target, []).append((minus, doc_id))
    step = min(OVERSAMPLE, every)
    return {target: sorted(set(found[step - 1 :: step])) for target, found in out.items()}


def _merges(runs: DataFrame, fan_in: int, rows_per_task: int) -> DataFrame:
    """The merges of a round: ``target`` (the run to be), ``segment`` of it, ``n`` records, and each of its runs' slices there. A written table.

    Runs are dealt into groups of ``fan_in``. Each file is asked for the places of those splitting keys that lie within it.
    """
    dealt = runs.withColumn("target", F.floor(F.col("run") / fan_in)).repartition(max(1, runs.count()))
    splits = _splits(dealt, rows_per_task)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                keys, reader = splits.get(row.target, []), RunReader(row.path)
                least, most = (tuple(reader.records(at, at + 1).tolist()[0][:2]) for at in (0, row.n - 1))
                first = bisect_right(keys, least)
                inside = keys[first : bisect_right(keys, most)]
                found = [0, *reader.places(inside), row.n]
                reader.close()
                parts = [(row.target, first + k, row.run, row.no, row.path, a, b) for k, (a, b) in enumerate(zip(found, found[1:], strict=False)) if b > a]
                yield pd.DataFrame(parts, columns=["target", "segment", "run", "no", "path", "start", "stop"])

    cuts = dealt.mapInPandas(cut, "target long, segment long, run long, no long, path string, start long, stop long")
    by_run = cuts.groupBy("target", "segment", "run").agg(F.array_sort(F.collect_list(F.struct("no", "path", "start", "stop"))).alias("files"))
    files = F.transform("files", lambda f: F.struct(f["path"].alias("path"), f["start"].alias("start"), f["stop"].alias("stop")))
    length = F.aggregate("files", F.lit(0).cast("long"), lambda a, f: a + f["stop"] - f["start"])
    return written(by_run.groupBy("target", "segment").agg(F.collect_list(files).alias("runs"), F.sum(length).alias("n")), "merges")


def _merged(row) -> Iterator[tuple]:
    """A segment's records in order."""
    return tournament([stream([(f["path"], f["start"], f["stop"]) for f in run]) for run in row.runs])


def _merge_round(merges: DataFrame, folder: str) -> DataFrame:
    """Makes each segment's file: the runs of the next round."""

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = str(TaskContext.get().taskAttemptId())
        for batch in batches:
            for row in batch.itertuples():
                path = f"{folder}/run-{row.target:06d}-{row.segment:06d}"
                out, merged = RunWriter(path, attempt), _merged(row)
                while some := list(islice(merged, BLOCK)):
                    out.add(np.array(some, RECORD))
                out.close()
                yield pd.DataFrame([(row.target, row.segment, path, out.size)], columns=["run", "no", "path", "n"])

    return written(merges.repartition(max(1, merges.count())).mapInPandas(merge, "run long, no long, path string, n long"), "runs")


def ranks(eligible: DataFrame, draw: int, fan_in: int = FAN_IN, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """row_no and rank (from 1) of the ``draw`` rows of the highest scores, ties to the smaller doc_id; eligible: row_no, doc_id, score.

    A round's plan is a row for each file and each segment; of the last one the driver gets each segment's number of records.
    """
    spark = eligible.sparkSession
    runs = write_runs(eligible, new_folder(spark, "sorted-runs"))
    while (runs.agg(F.max("run")).first()[0] or 0) >= fan_in:
        runs = _merge_round(_merges(runs, fan_in, rows_per_task), new_folder(spark, "sorted-runs"))
    merges, at, firsts = _merges(runs, fan_in, rows_per_task), 0, []
    for segment, n in sorted(merges.select("segment", "n").collect()):  # a row for each segment
        if at < draw:
            firsts.append((segment, at))
        at += n
    known = spark.createDataFrame(firsts, "segment long, first long")

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                merged, rank = islice(_merged(row), draw - row.first), row.first
                while some := [r for _, _, r in islice(merged, 50_000)]:
                    yield pd.DataFrame({"row_no": some, "rank": range(rank + 1, rank + 1 + len(some))})
                    rank += len(some)

    return merges.join(known, "segment").repartition(max(1, len(firsts))).mapInPandas(emit, "row_no long, rank long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, fan_in: int = FAN_IN, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of docs (doc_id, text); target: texts to draw towards (text).

    Of the documents with at least ``min_words`` words ``percent`` in a hundred are drawn, rounded down; the others' rank is null.
    """
    features, wanted = with_features(docs, "doc_id"), with_features(target)
    gain = gains(bucket_counts(features), bucket_counts(wanted))
    table = written(scored(features, gain, seed), "scores")
    release(features, wanted)
    eligible = table.where(F.col("n_words") >= min_words)
    drawn = ranks(eligible, percent * eligible.count() // 100, fan_in, rows_per_task)
    return table.join(drawn, "row_no", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")


def op13_sql(percent: int, min_words: int, seed: int) -> str:
    """DuckDB SQL for the query's rows; the checksum of each distinct feature is folded from its bytes."""
    table = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    words = lambda c: f"list_filter(string_split_regex(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce({words("text")}, []) AS w FROM documents
    ), b AS (SELECT coalesce({words("text")}, []) AS w FROM benchmark
    ), e AS (
      SELECT 's' AS side, row_no, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM d
      UNION ALL SELECT 't', NULL, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM b
    ), c AS (SELECT {table}::BIGINT[] AS crc
    ), f AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM e)
    ), g AS (
      SELECT feature, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda a, x: xor(a >> 8, crc[(xor(a, x) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM f, c
    ), x AS (SELECT e.*, bucket FROM e JOIN g USING (feature)
    ), n AS (SELECT bucket, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 't') AS t FROM x GROUP BY bucket
    ), o AS (SELECT sum(s) AS sa, sum(t) AS ta FROM n
    ), y AS (SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sa + {BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * (ta + {BUCKETS})::DOUBLE))) AS BIGINT) AS gain FROM n, o
    ), m AS (SELECT row_no, sum(gain)::BIGINT AS gain, count(*) AS n_features FROM x JOIN y USING (bucket) WHERE side = 's' GROUP BY row_no
    ), z AS (
      SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce((gain - (gain % n_features + n_features) % n_features) // n_features, 0) AS weight,
        ('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (row_no)
    ), q AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM z
    ), r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {min_words} ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (n_words >= {min_words}) OVER () AS n FROM q)
    SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN n_words >= {min_words} AND place <= {percent} * n // 100 THEN place END AS rank FROM r"""

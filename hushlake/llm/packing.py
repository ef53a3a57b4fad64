"""Operator 10: best-fit packing by hierarchical residual merging.

A document is its token ids and an end id. What is longer than a sequence is cut into full
sequences, the first piece taking the rest. Each task best-fits its own short pieces, longest first,
emits nearly full bins, and passes on the underfull bins as items. These are dealt to fewer tasks and
packed again, until one task is left or a round no longer lowers their number. A task never
gets more than ``items_per_task`` items, so rounds stop early rather than gather all in one place.

Defined results: a null or empty text is the end id alone; rows that share a doc_id, or are equal, are
packed each on its own; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship, slices, written
from .tokens import encoder

#: Share of a sequence from which a bin is emitted before the last round.
NEARLY_FULL = 0.998
#: Tasks of a round whose underfull bins meet in one task of the next.
FAN_IN = 8
#: Items that a task packs at a time.
ITEMS_PER_TASK = 200_000

MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
BINS = pa.schema([("done", pa.bool_()), ("fill", pa.int64()), ("members", pa.list_(MEMBER))])
BINS_DDL = "done boolean, fill long, members array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def best_fit(items: list[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """Best-fit decreasing over (length, members) items; a member ends with its offset in the bin."""
    free: dict[int, list[int]] = {}
    rooms: list[int] = []
    bins: list[tuple[int, list]] = []
    for length, members in sorted(items, key=lambda x: -x[0]):
        at = bisect_left(rooms, length)
        if at < len(rooms):
            room = rooms[at]
            holders = free[room]
            number = holders.pop()
            if not holders:
                del free[room]
                rooms.pop(at)
        else:
            room, number = capacity, len(bins)
            bins.append((0, []))
        fill, inside = bins[number]
        inside.extend((*m[:-1], m[-1] + fill) for m in members)
        bins[number] = (fill + length, inside)
        if left := room - length:
            if left not in free:
                free[left] = []
                insort(rooms, left)
            free[left].append(number)
    return bins


def _rows(bins: list[tuple[int, list]], done) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in MEMBER]
    for at in range(0, len(bins), 5000):
        rows = [{"done": done(fill), "fill": fill, "members": [dict(zip(names, m, strict=True)) for m in inside]} for fill, inside in bins[at : at + 5000]]
        yield pa.RecordBatch.from_pylist(rows, schema=BINS)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    capacity: int = 2048,
    nearly_full: float = NEARLY_FULL,
    fan_in: int = FAN_IN,
    items_per_task: int = ITEMS_PER_TASK,
) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ship(docs.sparkSession)
    full = int(capacity * nearly_full)
    end = end_id.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list[tuple[int, list]] = []
        for batch in (part for whole_batch in batches for part in slices(whole_batch)):
            whole: list[tuple[int, list]] = []
            ids = encoder(tokenizer_path).encode_many(batch.column("text").to_pylist())
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                content += end
                total = len(content) // 4
                start, cut = 0, total % capacity or capacity
                for piece in range(-(-total // capacity)):
                    member = (doc_id, piece, start, cut, zlib.crc32(content[4 * start : 4 * (start + cut)]), 0)
                    (whole if cut == capacity else items).append((cut, [member]))
                    start, cut = start + cut, capacity
            yield from _rows(whole, lambda _: True)
            if len(items) >= items_per_task:
                bins = best_fit(items, capacity)
                items = [b for b in bins if b[0] < full]
                yield from _rows([b for b in bins if b[0] >= full], lambda _: True)
                if len(items) >= items_per_task // 2:  # they do not fit together: leave them to the next round
                    yield from _rows(items, lambda _: False)
                    items = []
        yield from _rows(best_fit(items, capacity), lambda fill: fill >= full)

    def again(last: bool):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = []
            for batch in batches:
                for row in batch.to_pylist():
                    items.append((row["fill"], [tuple(m.values()) for m in row["members"]]))
            yield from _rows(best_fit(items, capacity), lambda fill: last or fill >= full)

        return pack

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bins = written(rows.mapInArrow(first, BINS_DDL), "bins")
    finished = [bins.where("done")]
    open_bins = bins.where("NOT done")
    tasks, left = rows.rdd.getNumPartitions(), open_bins.count()
    while left:
        tasks = max(1, -(-tasks // fan_in), -(-left // items_per_task))
        bins = written(open_bins.repartition(tasks).mapInArrow(again(tasks == 1), BINS_DDL), "bins")
        finished.append(bins.where("done"))
        open_bins = bins.where("NOT done")
        before, left = left, open_bins.count()
        if left > 0.99 * before and tasks == -(-before // items_per_task):  # nothing fits together any more
            finished.append(open_bins)
            break
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    # The bins are files by now, so a task that runs again numbers them alike.
    numbered = out.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    return numbered.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")

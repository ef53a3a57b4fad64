"""Operator 2: token ids of whole documents in seekable zstandard files, in ascending doc_id order.

Documents are range-partitioned by id, each partition writes files of a bounded number of documents and bytes from its own task, and a
manifest table names the files with their counts. A task that is run again writes the same files
anew under a temporary name and moves it into place. Offsets over the whole corpus come from
the manifest, one row a file, so no task sees more than its partition.

Defined results: a null or empty text has only the end id; a null doc_id sorts first;
rows that share a doc_id are separate documents in the order of a hash of their text; an empty table
has a manifest without rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .seekable import Reader, Writer
from .shared import new_folder, ship, slices, written
from .tokens import encoder

MANIFEST = "file_no long, path string, n_docs long, n_ids long"
#: Documents and compressed bytes beyond which a task begins its next file.
FILE_DOCS, FILE_BYTES = 1_000_000, 2**31
#: A file's number is its partition's and, in its lower bits, its own in the partition.
FILE_BITS = 24
DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, file_docs: int = FILE_DOCS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``docs`` (doc_id, text) and return the manifest, itself a written table.

    Memory: a task holds one Arrow batch and 21 bytes for each document of the file that it writes.
    """
    ship(docs.sparkSession)
    folder = folder or new_folder(docs.sparkSession, "token-files")
    end = end_id.to_bytes(4, "little")
    shape = pa.schema([("file_no", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number, made, out, n_ids = task.partitionId(), 0, None, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"file_no": number << FILE_BITS | made, "path": out.name, "n_docs": len(out), "n_ids": n_ids}], schema=shape)

        for batch in (part for whole_batch in batches for part in slices(whole_batch)):
            ids = encoder(tokenizer_path).encode_many(batch.column("text").to_pylist())
            for doc_id, content in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                if out is None:
                    out, n_ids = Writer(f"{folder}/part-{number:06d}-{made:06d}.ids.zst", str(task.taskAttemptId())), 0
                out.add(doc_id, content + end)
                n_ids += len(content) // 4 + 1
                if len(out) >= file_docs or out.n_bytes >= file_bytes:
                    yield closed()
                    out, made = None, made + 1
        if out is not None:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    ordered = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return written(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files with its place in the corpus: doc_id, start, n_tokens, ids_crc32."""
    ship(manifest.sparkSession)
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, start in zip(batch["path"], batch["start"], strict=True):
                file, rows, at = Reader(path), [], int(start)
                for doc_id, content in file.documents():
                    n = len(content) // 4
                    rows.append((doc_id, at, n, zlib.crc32(content)))
                    at += n
                    if len(rows) == 50_000:
                        yield _frame(rows)
                        rows = []
                file.close()
                yield _frame(rows)

    files = manifest.select("path", before.alias("start"))
    return files.repartition(max(1, manifest.count())).mapInPandas(read, DOCUMENTS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"]).astype({"doc_id": "Int64"})


def document_index(manifest: DataFrame) -> DataFrame:
    """Where each document is: doc_id, path, frame. Only the files' indexes are read."""
    ship(manifest.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                file = Reader(path)
                file.close()
                for at in range(0, len(file), 50_000):
                    part = file.ids(at, at + 50_000)
                    yield pd.DataFrame({"doc_id": pd.array(part, dtype="Int64"), "path": path, "frame": range(at, at + len(part))})

    return manifest.select("path").repartition(max(1, manifest.count())).mapInPandas(read, "doc_id long, path string, frame int")


def read_documents(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Token ids of the documents whose doc_id is in ``wanted`` only: doc_id, ids. Other frames stay compressed.

    The ids wanted meet the files' indexes in a join, and each file's frames are read where they meet; a null doc_id is never wanted.
    """
    places = document_index(manifest).join(wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        path, file = None, None
        for batch in batches:
            for at in range(0, len(batch), 100):
                found = []
                for row in batch.iloc[at : at + 100].itertuples():
                    if row.path != path:
                        if file:
                            file.close()
                        path, file = row.path, Reader(row.path)
                    found.append((row.doc_id, np.frombuffer(file.frame(row.frame), "<u4").astype("int64").tolist()))
                yield pd.DataFrame(found, columns=["doc_id", "ids"])
        if file:
            file.close()

    # A file's frames may be read by several tasks, so that many wanted documents of one file do not meet in one.
    dealt = places.repartition(F.col("path"), F.floor(F.col("frame") / 4096)).sortWithinPartitions("path", "frame")
    return dealt.mapInPandas(read, "doc_id long, ids array<long>")

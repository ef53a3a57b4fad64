import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hushlake.llm.seekable import Reader, Writer
from hushlake.llm.token_files import read_documents, read_token_files, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def corpus():
    rng = random.Random(1)
    rows = [(i * 3, " ".join(rng.choice(["The", "of", "Seldom", "é😀", "x\ny", "<|endoftext|>"]) for _ in range(rng.randint(0, 80))), "c") for i in range(500)]
    rows += [(7, None, "c"), (8, "", "c"), (9, "long " * 30_000, "c"), (None, "no id", "c"), (30, "second of its id", "c")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("file_docs", "file_bytes"), [(1_000_000, 2**31), (40, 2**31), (1_000_000, 500)])
def test_round_trip(spark, tmp_path, file_docs, file_bytes):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string").repartition(3)
    manifest = write_token_files(docs, PATH, 2, f"file://{tmp_path}/files", file_docs, file_bytes)
    assert manifest.agg(F.max("n_docs")).first()[0] <= file_docs and (manifest.count() > 8) == (min(file_docs, file_bytes) < 1000)
    got = sorted(read_token_files(manifest).collect(), key=lambda r: r.start)
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for doc_id, text, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r.start == at
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    some = read_documents(manifest, docs.where(F.col("doc_id").isin(0, 9, 30)).select("doc_id")).collect()
    assert sorted(r.doc_id for r in some) == [0, 9, 9, 30, 30]


def test_a_writer_holds_few_bytes_for_a_document(tmp_path):
    import tracemalloc

    writer, n = Writer(str(tmp_path / "many.zst"), "0"), 200_000
    writer.add(0, b"\2\0\0\0")
    tracemalloc.start()
    for i in range(1, n):
        writer.add(i if i % 7 else None, b"\2\0\0\0")
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    writer.close()
    assert held / n < 24.5
    reader = Reader(str(tmp_path / "many.zst"))
    assert len(reader) == n and reader.ids(0, 15) == [None if i and i % 7 == 0 else i for i in range(15)] and reader.frame(n - 1) == b"\2\0\0\0"


def test_one_equal_row_fills_a_third(spark):
    rows = [(i, f"text {i}") for i in range(200)] + [(50, "the same row")] * 100
    manifest = write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH, 2, file_docs=30)
    got = read_token_files(manifest).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in rows) and sorted(r.start for r in got)[1:] == np.cumsum([r.n_tokens for r in sorted(got, key=lambda r: r.start)])[:-1].tolist()


def test_any_zstandard_reader_and_damage(tmp_path):
    path = str(tmp_path / "x.ids.zst")
    writer = Writer(path, "0")
    contents = [bytes([i]) * (4 * i) for i in range(20)]
    for i, c in enumerate(contents):
        writer.add(i, c)
    writer.close()
    with open(path, "rb") as f:
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(contents)
    reader = Reader(path)
    assert reader.frame(7) == contents[7] and dict(reader.documents({3, 19})) == {3: contents[3], 19: contents[19]}
    reader.entries = reader.entries.copy()
    reader.entries[7, 2] ^= 1
    with pytest.raises(ValueError):
        reader.frame(7)


def test_empty_table(spark):
    manifest = write_token_files(spark.createDataFrame([], "doc_id long, text string"), PATH, 2)
    assert manifest.count() == 0 and read_token_files(manifest).count() == 0

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from hushlake.llm.packing import best_fit, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(spark, rows, capacity, **options):
    """Every piece whole and in place, no gaps in a sequence; returns (sequences, ids, rows)."""
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(4)
    got = pack_documents(docs, PATH, 0, capacity, **options).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first, start = len(ids) % capacity or capacity, 0
        for piece in range(-(-len(ids) // capacity)):
            length = first if piece == 0 else capacity
            part = np.array(ids[start : start + length], "<u4")
            want.append((doc_id, piece, start, length, zlib.crc32(part.tobytes())))
            start += length
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(r.length for r in got), got


def some(n, seed=1):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice(["the", "of", "seldom", "é😀"]) for _ in range(int(rng.paretovariate(1.0) * 10) % 3000)), 1) for i in range(n)]
    return rows + [(None, None, 1), (-1, "", 1), (-2, "a<|endoftext|>b", 1), (5, "again", 1), (5, "again", 1)]


def test_pieces_and_places(spark):
    sequences, ids, _ = check(spark, some(1500), 256)
    assert sequences <= 1.02 * ids / 256 + 1


def test_few_items_a_task_take_several_rounds(spark):
    sequences, ids, _ = check(spark, some(1500, 2), 256, items_per_task=100, fan_in=2)
    assert sequences <= 1.05 * ids / 256 + 1


def test_items_that_do_not_fit_together_end(spark):
    sequences, _, got = check(spark, [(i, "a b " * 20, 1) for i in range(400)], 60, items_per_task=50, fan_in=2)
    assert sequences == len(got) == 400


def test_best_fit_fills_bins():
    rng = random.Random(3)
    items = [(n, [(i, 0)]) for i, n in enumerate(rng.randint(1, 100) for _ in range(5000))]
    bins = best_fit(items, 100)
    assert sum(f for f, _ in bins) == sum(n for n, _ in items) and max(f for f, _ in bins) <= 100
    assert len(bins) <= 1.01 * sum(n for n, _ in items) / 100 + 1


def test_empty_table(spark):
    assert check(spark, [], 64)[0] == 0

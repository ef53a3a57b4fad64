import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from hushlake.llm import queries
from hushlake.llm.rank_bpe import RankEncoder, decode_documents, encode_documents, read_ranks

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
PIECES = ["a", "B", "é", "\n", "\t", " ", " ", "'s", "'S", "1", "23", ",", "...", " word", "word", "<|endoftext|>", "İ", "Σ", "́", "😀", "-", "　", "\r\n", "ÿ", "×", "\x1c", "\x85", "᠎", "​"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def ids_of(content: bytes) -> list[int]:
    return np.frombuffer(content, "<u4").tolist()


def test_the_bitmap_is_empty_after_each_piece():
    encoder, rng = RankEncoder(PATH, PATTERN), random.Random(4)
    for n in (1, 2, 3, 50, 3000):
        encoder.merge(bytes(rng.choice(b"abc e") for _ in range(n)))
        assert not any(encoder.leaves)


def test_equals_the_library_on_hard_texts(library):
    rng = random.Random(8)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(15_000)]
    texts += ["x{0}{0} y{0}1{0}.{0} {0}".format(chr(c)) for c in [*range(0x3000), *rng.sample(range(0x3000, 0xD800), 2000), *rng.sample(range(0xE000, 0x110000), 2000)]]
    for text, got in zip(texts, RankEncoder(PATH, PATTERN, cache_words=500).encode_many(texts), strict=True):
        assert ids_of(got) == library.encode_ordinary(text), repr(text)


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_000 + "é" * 3000, "!?" * 20_000, "0123456789" * 3000, " " * 30_000, "\n" * 9999 + "x"])
def test_very_long_pieces(library, text):
    assert ids_of(RankEncoder(PATH, PATTERN).encode(text)) == library.encode_ordinary(text)


def test_ties_are_merged_from_the_left_and_stale_entries_are_skipped(tmp_path):
    # Ranks that fall when parts are merged: a merge may make a pair that comes before those that wait.
    import base64

    ranks = {bytes([b]): b + 10 for b in range(256)} | {b"abc": 0, b"ab": 300, b"bc": 301, b"aa": 302, b"aab": 1, b"cab": 2}
    path = tmp_path / "ranks"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
    own, ref = RankEncoder(str(path), PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for text in ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(5000)]:
        assert ids_of(own.encode(text)) == ref.encode_ordinary(text), text


def test_rows_and_round_trip(spark, library):
    rows = [(1, "The cat's\n\n 12 dogs", "x"), (1, "The cat's\n\n 12 dogs", "x"), (None, None, None), (2, "", "y"), (3, "wörd " * 20_000 + "z" * 30_000, None), (4, "one", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = decode_documents(encode_documents(docs, PATH, PATTERN), PATH, PATTERN).collect()
    want = [(d, library.encode_ordinary(t or ""), (t or "").encode()) for d, t, _ in rows]
    key = lambda x: (x[0] or 0, x[1])
    assert sorted([(r.doc_id, r.ids, bytes(r.decoded)) for r in got], key=key) == sorted(want, key=key)
    both = encode_documents(docs, PATH, PATTERN, decode=True).collect()
    assert sorted([(r.doc_id, r.ids, bytes(r.decoded)) for r in both], key=key) == sorted(want, key=key)
    holes = spark.createDataFrame([(1, None), (2, []), (3, [65, 66]), (4, [67])], "doc_id long, ids array<int>").coalesce(1)
    assert [bytes(r.decoded) for r in decode_documents(holes, PATH, PATTERN).orderBy("doc_id").collect()] == [b"", b"", *[b"".join(library.decode_single_token_bytes(i) for i in x) for x in ([65, 66], [67])]]
    assert encode_documents(docs.limit(0), PATH, PATTERN).columns == ["doc_id", "ids"] and encode_documents(docs.limit(0), PATH, PATTERN).count() == 0


def test_the_query_equals_the_library_on_the_whole_table(spark, library):
    sf = "/root/testdata/sf0.001"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode())))
    assert {tuple(r) for r in queries.op11_rank_bpe(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == want

"""Operator 11: byte-level BPE by merge ranks, with a queue of ranks kept in a hierarchical bitmap.

A text is split into pre-tokens by a pattern. The bytes of a pre-token are a linked list of parts, and each pair of neighbours that is
in the vocabulary waits in the bucket of its rank. A bitmap of two levels says which buckets hold anything: two find-first-set
steps give the lowest rank, whose leftmost pair is merged. Entries whose pair has changed since stay in their buckets and are
skipped when they come up. A pre-token of n bytes has at most 3n entries, so time grows with its length and not with its square.

Each worker remembers the ids of words it has met, up to a fixed number.

Defined results: a null or empty text has no ids; rows that share a doc_id, or are equal, are rows of their own, a null doc_id stays null;
an empty table gives no rows; other columns are ignored. A vocabulary that lacks one of the 256 bytes is an error.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship, slices

#: Words that one Python worker remembers, twice: when so many are new, those not met again since the last time are forgotten. About 170 MB.
CACHE_WORDS = 400_000
#: Characters that are split into words at a time.
CHUNK_CHARS = 4_000_000
#: A space, plain letters and one mark.
ENDED = re.compile("( [A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?])").fullmatch
#: A text that holds one of these is split by the pattern as a whole: its runs of white space are pre-tokens of several characters.
RUNS = ("  ", " \n", "\n ", "\n\n")


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankEncoder:
    """Encodes whole texts, and decodes ids, by a file of ranks and the pattern of its pre-tokens.

    Single spaces and newlines between other characters start a pre-token of their own under the pattern, so a text's ids are
    those of its words in order, each with the space or newline before it; a text with longer runs of them is split as a whole.
    """

    def __init__(self, path: str, pattern: str, cache_words: int = CACHE_WORDS):
        import regex

        self.ranks = read_ranks(path)
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        if len(self.tokens) > 65_536:
            raise ValueError("two levels of 256 bits have room for 65,536 ranks")
        self.token_bytes = pa.array(self.tokens, pa.large_binary())
        self.split = regex.compile(pattern).findall
        apart = all(self.split(f" Aé{mark}") == [" Aé", mark] for mark in ".,;:!?")
        self.ended = ENDED if apart else lambda _: None
        #: A rank's bit in its leaf of 256 ranks, and a leaf's in the top: room for 65,536 ranks.
        self.bits = [1 << (k & 255) for k in range(max(256, len(self.tokens)))]
        self.leaves = [0] * (len(self.tokens) // 256 + 1)
        self.pairs = [self.ranks.get(bytes((a, b))) for a in range(256) for b in range(256)]
        self.cache_words = cache_words
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.

        A leaf of the bitmap is one integer with a bit for each of 256 ranks, its top one with a bit for each leaf. Both are empty again at the end.
        """
        rank_of, leaves, n = self.ranks.get, self.leaves, len(piece)
        known = rank_of(piece)
        if known is not None:
            return [known]
        single, pairs, bits = self.single, self.pairs, self.bits
        ids, ends, before = [single[b] for b in piece], list(range(1, n + 1)), list(range(-1, n - 1))
        #: By the position of a pair's first part: the rank under which it was queued last.
        waiting = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]  # noqa: B905
        buckets: dict[int, list[int]] = {}
        top = 0
        for at, rank in enumerate(waiting):
            if rank is not None:
                bucket = buckets.get(rank)
                if bucket:
                    bucket.append(at)
                else:
                    buckets[rank] = [at]
                    leaves[rank >> 8] |= bits[rank]
                    top |= bits[rank >> 8]
        waiting.append(None)
        while top:
            # Two find-first-set steps give the lowest rank; its leftmost position comes first.
            leaf_no = (top & -top).bit_length() - 1
            leaf = leaves[leaf_no]
            low = leaf & -leaf
            rank = leaf_no << 8 | low.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                del buckets[rank]
                leaves[leaf_no] = leaf = leaf ^ low
                if not leaf:
                    top ^= bits[leaf_no]
            if waiting[at] != rank:
                continue
            second = ends[at]
            end = ends[at] = ends[second]
            ids[at] = rank
            ids[second] = -1
            waiting[second] = None
            # The merged part makes a new pair with each of its neighbours.
            new = None
            if end < n:
                before[end] = at
                new = rank_of(piece[at : ends[end]])
                if new is not None:
                    bucket = buckets.get(new)
                    if bucket:
                        heappush(bucket, at)
                    else:
                        buckets[new] = [at]
                        leaves[new >> 8] |= bits[new]
                        top |= bits[new >> 8]
            waiting[at] = new
            first = before[at]
            if first >= 0:
                new = waiting[first] = rank_of(piece[first:end])
                if new is not None:
                    bucket = buckets.get(new)
                    if bucket:
                        heappush(bucket, first)
                    else:
                        buckets[new] = [first]
                        leaves[new >> 8] |= bits[new]
                        top |= bits[new >> 8]
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a text, pre-token by pre-token, as little-endian unsigned 32-bit numbers."""
        ids = [i for piece in self.split(text) for i in self.merge(piece.encode())]
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        """The ids of a word, which is remembered."""
        ids = self.recent.get(word)
        if ids is None:
            ids = self.older.get(word)
            if ids is None:
                parts = self.ended(word)
                if parts:  # two pre-tokens, of which only the letters are remembered
                    return self.word(parts[1]) + self.word(parts[2])
                ids = self.encode(word)
            if len(self.recent) >= self.cache_words:
                self.recent, self.older = {}, self.recent
            self.recent[word] = ids
        return ids

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (None: the empty text), as little-endian unsigned 32-bit numbers."""
        out = [b""] * len(texts)
        group, chars = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            if text[0] in " \n" or text[-1] in " \n" or any(run in text for run in RUNS):
                out[i] = b"".join(map(self.word, self.split(text)))
                continue
            group.append(i)
            chars += len(text)
            if chars >= CHUNK_CHARS:
                self._by_word(texts, group, out)
                group, chars = [], 0
        if group:
            self._by_word(texts, group, out)
        return out

    def _by_word(self, texts: list[str | None], group: list[int], out: list[bytes]) -> None:
        """Many texts' words at once: each distinct word is looked up once, and the ids of all words are gathered in order."""
        heads, rests = [], []
        for i in group:
            head, _, rest = texts[i].replace("\n", " \n").partition(" ")
            heads.append(self.word(head))
            rests.append(rest)
        split = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        # A rest is empty where the text is one word.
        found = [self.word(word if word[:1] in ("", "\n") else " " + word) for word in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat, number = np.frombuffer(b"".join(found), "<u4"), coded.indices.to_numpy()
        of_word = sizes[number]
        ends = np.concatenate([[0], np.cumsum(of_word)])
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[number] - ends[:-1], of_word) + np.arange(ends[-1])]
        cuts = ends[split.offsets.to_numpy()].tolist()
        for k, (i, head) in enumerate(zip(group, heads, strict=True)):
            out[i] = head + ids[cuts[k] : cuts[k + 1]].tobytes()

    def decode(self, ids: pa.Array, ends: np.ndarray) -> pa.Array:
        """The bytes of runs of ids: run k ends before number ``ends[k]``."""
        parts = self.token_bytes.take(ids)
        offsets = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset :]
        cuts = np.r_[0, offsets[ends] - offsets[0]] if len(ends) else np.zeros(1, np.int64)
        content = parts.buffers()[2].slice(offsets[0], offsets[len(parts)] - offsets[0]) if len(parts) else pa.py_buffer(b"")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(cuts.astype(np.int64).tobytes()), content])


_encoders: dict[tuple[str, str], RankEncoder] = {}


def encoder(path: str, pattern: str) -> RankEncoder:
    """This worker's encoder of a file of ranks."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = RankEncoder(path, pattern)
    return _encoders[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, decode: bool = False) -> DataFrame:
    """The ids of every whole text: doc_id, ids (array<int>). ``path``: the file of ranks, the same on every worker.

    ``decode`` adds ``decoded``, the bytes that the ids stand for, as ``decode_documents`` does, without sending the ids to another worker.
    """
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            found = encoder(path, pattern).encode_many(batch.column("text").to_pylist())
            ends = np.cumsum([len(x) // 4 for x in found])
            ids = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4")))
            more = [encoder(path, pattern).decode(ids.flatten(), ends).cast(pa.binary())] if decode else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, *more], ["doc_id", "ids", "decoded"][: 2 + decode])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids array<int>" + ", decoded binary" * decode)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the bytes of a row's ids: doc_id, ids, decoded. Null ids: no bytes."""
    ship(encoded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            ids = batch.column("ids")
            ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
            made = encoder(path, pattern).decode(ids.flatten(), ends)
            yield pa.RecordBatch.from_arrays([*batch.columns, made.cast(pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, ids array<int>, decoded binary")

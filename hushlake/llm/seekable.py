"""Token-id files: one zstandard frame for each document, an index of ids, and a trailing seek table.

A file is ``frame ... frame | index frame | seek table``. The seek table is a skippable frame
as in the public Zstandard seekable format: for each frame its compressed size, its size, and the low
32 bits of the XXH64 of its content. The index is a skippable frame too, so any zstandard
reader can stream the whole file. A frame holds a document's ids as little-endian uint32.
"""

from __future__ import annotations

import struct
from array import array
from collections.abc import Iterator

import numpy as np

#: Fixed values of the Zstandard formats: magic numbers and the descriptor with its checksum flag.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80


def file_system(path: str):
    """A pyarrow file system for a path or URI, and the path in it."""
    from pyarrow import fs

    if ":" not in path.split("/", 1)[0]:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class Writer:
    """Writes one file; it appears under its own name only when it is complete."""

    def __init__(self, path: str, attempt: str, level: int = 3):
        import zstandard

        self.name = path
        self.fs, self.path = file_system(path)
        self.temporary = f"{self.path}.{attempt}.tmp"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.temporary)
        self.compressor = zstandard.ZstdCompressor(level=level)
        # 21 bytes for each document: its seek entry, its id, and whether it has one.
        self.sizes, self.lengths, self.sums = array("I"), array("I"), array("I")
        self.ids, self.missing = array("q"), bytearray()
        self.n_bytes = 0

    def __len__(self) -> int:
        return len(self.ids)

    def add(self, doc_id: int | None, content: bytes) -> None:
        import xxhash

        frame = self.compressor.compress(content)
        self.out.write(frame)
        self.sizes.append(len(frame))
        self.lengths.append(len(content))
        self.sums.append(xxhash.xxh64_intdigest(content) & 0xFFFFFFFF)
        self.ids.append(doc_id or 0)
        self.missing.append(doc_id is None)
        self.n_bytes += len(frame)

    def close(self) -> None:
        packed = self.compressor.compress(np.asarray(self.ids, "<i8").tobytes() + bytes(self.missing))
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed)) + packed)
        n = len(self) + 1
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK_TABLE, 12 * n + 9))
        for at in range(0, len(self), 100_000):
            part = slice(at, at + 100_000)
            self.out.write(np.column_stack([np.frombuffer(x[part], np.uint32) for x in (self.sizes, self.lengths, self.sums)]).astype("<u4").tobytes())
        self.out.write(struct.pack("<III", len(packed) + 8, 0, 0))
        self.out.write(struct.pack("<IBI", n, CHECKSUM_FLAG, SEEKABLE_MAGIC))
        self.out.close()
        self.fs.move(self.temporary, self.path)


class Reader:
    """Reads the seek table and index; then only the frames it is asked for."""

    def __init__(self, path: str):
        import zstandard

        where, inner = file_system(path)
        self.file = where.open_input_file(inner)
        self.decompressor = zstandard.ZstdDecompressor()
        size = self.file.size()
        count, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError(f"{path} has no seek table")
        table = self._at(size - 9 - 12 * count, 12 * count)
        self.entries = np.frombuffer(table, "<u4").reshape(count, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        at, length = int(self.starts[count - 1]) + 8, int(self.entries[count - 1, 0]) - 8
        index = self.decompressor.decompress(self._at(at, length))
        self.numbers, self.missing = np.frombuffer(index, "<i8", count - 1), np.frombuffer(index, np.bool_, count - 1, 8 * (count - 1))

    def __len__(self) -> int:
        return len(self.numbers)

    def ids(self, start: int, stop: int) -> list[int | None]:
        """The ids of some documents in the file's order."""
        return [None if n else x for x, n in zip(self.numbers[start:stop].tolist(), self.missing[start:stop].tolist(), strict=True)]

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def frame(self, k: int) -> bytes:
        """The content of the file's document number ``k``; its checksum must hold."""
        import xxhash

        content = self.decompressor.decompress(self._at(int(self.starts[k]), int(self.entries[k, 0])))
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return content

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, bytes]]:
        """Documents in the file's order, all or those with these ids."""
        for at in range(0, len(self), 10_000):
            for k, doc_id in enumerate(self.ids(at, at + 10_000), at):
                if wanted is None or doc_id in wanted:
                    yield doc_id, self.frame(k)

    def close(self) -> None:
        self.file.close()

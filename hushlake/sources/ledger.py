"""Answers that are kept as soon as they come, so that nothing is asked twice.

A ledger is a folder of a shared file system with a file for each key. A file is written under another name and then moved, so it is
there whole or not at all; of two tasks that bring an answer for one key, the first one's stays.
"""

from __future__ import annotations

import json


def file_system(path: str):
    """A pyarrow file system for a path or URI, and the path in it."""
    from pyarrow import fs

    if ":" not in path.split("/", 1)[0]:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class Ledger:
    """Reply and error by key."""

    def __init__(self, folder: str, attempt: str):
        self.fs, self.folder = file_system(folder)
        self.attempt = attempt

    def _path(self, key: str) -> str:
        return f"{self.folder}/{key[:3]}/{key}.json"

    def _is_there(self, path: str) -> bool:
        return self.fs.get_file_info(path).is_file

    def find(self, key: str) -> tuple[str | None, str | None] | None:
        """What was kept for a key, or None."""
        if not self._is_there(self._path(key)):
            return None
        with self.fs.open_input_stream(self._path(key)) as f:
            kept = json.loads(f.read())
        return kept["reply"], kept["error"]

    def keep(self, key: str, reply: str | None, error: str | None) -> tuple[str | None, str | None]:
        """Keeps an answer if there is none yet; gives the one that is kept."""
        path = self._path(key)
        temporary = f"{path}.{self.attempt}"
        self.fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with self.fs.open_output_stream(temporary) as f:
            f.write(json.dumps({"reply": reply, "error": error}, ensure_ascii=False).encode())
        if self._is_there(path):
            self.fs.delete_file(temporary)
        else:
            self.fs.move(temporary, path)
        return self.find(key)

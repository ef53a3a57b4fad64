"""Settings files of KEY=VALUE lines."""

from __future__ import annotations

from pathlib import Path


class Settings:
    """Values by key. Blank lines, and lines that start with ``#``, are skipped; a value ends at its first ``#``."""

    def __init__(self, lines: list[str]):
        self.values: dict[str, str] = {}
        for line in map(str.strip, lines):
            if line and not line.startswith("#") and "=" in line:
                key, value = line.split("=", 1)
                self.values[key.strip()] = value.split("#", 1)[0].strip()

    @classmethod
    def read(cls, path: str) -> Settings:
        """A missing file is an error."""
        return cls(Path(path).read_text(encoding="utf-8").splitlines())

    def text(self, key: str, default: str = "") -> str:
        return self.values.get(key) or default

    def integer(self, key: str, default: int = 0) -> int:
        try:
            return int(self.values[key])
        except (KeyError, ValueError):
            return default

    def flag(self, key: str, default: bool = False) -> bool:
        return self.values[key].lower() in ("true", "1", "yes", "on") if self.values.get(key) else default

    def shown(self) -> dict[str, str]:
        """Values for printing: those of keys and tokens are hidden."""
        return {k: "***" if v and any(w in k.lower() for w in ("key", "token")) else v for k, v in self.values.items()}

"""File operations that fail by script, for tests of what a store does then (O-103)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from tidelog.sources.store import Files


@dataclass
class Fault:
    """The nth call (from 1) of an operation whose path holds `part` fails. A write may leave the first
    `keep` characters of its text under a name that nobody reads. A fault that has struck is spent."""

    operation: str  # write_new, remove, make
    part: str = ""
    nth: int = 1
    keep: int | None = None
    seen: int = 0

    @property
    def spent(self) -> bool:
        return self.seen >= self.nth


class ScriptedFiles(Files):
    def __init__(self, spark: SparkSession, *script: Fault):
        super().__init__(spark)
        self.script = list(script)

    def _strike(self, operation: str, path: str) -> Fault | None:
        struck = None
        for f in self.script:
            if f.operation == operation and f.part in path and not f.spent:
                f.seen += 1
                struck = struck or (f if f.spent else None)
        return struck

    def unspent(self) -> list[Fault]:
        return [f for f in self.script if not f.spent]

    def write_new(self, path: str, text: str) -> None:
        if f := self._strike("write_new", path):
            if f.keep is not None:
                folder, _, name = path.rpartition("/")
                super().write_new(f"{folder}/.{name}.short", text[: f.keep])
            raise OSError(f"scripted: {path}")
        super().write_new(path, text)

    def remove(self, path: str) -> None:
        if self._strike("remove", path):
            raise OSError(f"scripted: {path}")
        super().remove(path)

    def make(self, path: str) -> None:
        if self._strike("make", path):
            raise OSError(f"scripted: {path}")
        super().make(path)

"""What is indexed: one small JSON document a table, and a manifest of files for each index.

The document holds definitions only and doesn't grow with the data; manifests, with the
statistics of every file, are Parquet.  A change writes new Parquet first and replaces
the document last, so that is where it commits.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from . import files


@dataclass
class IndexDef:
    name: str
    kind: str  # BTREE or BITMAP
    columns: list[list]  # [name, ascending]
    created: float
    manifest: str = ""
    generations: list[str] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [c for c, _ in self.columns]

    def same_definition(self, other: IndexDef) -> bool:
        return self.kind == other.kind and self.columns == other.columns


@dataclass
class TableEntry:
    name: str
    roots: list[str]
    format: str
    schema: str
    partition_columns: list[str]
    indexes: dict[str, IndexDef] = field(default_factory=dict)
    version: int = 0


class ChangedElsewhere(RuntimeError):
    """Another session has changed a table's indexes since this one read them."""


class Catalog:
    """Documents under ``root``, by the table's root paths; what was read is remembered until the file changes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._held: dict[str, tuple[tuple[int, int] | None, TableEntry | None]] = {}

    @staticmethod
    def key(roots: list[str] | tuple[str, ...]) -> str:
        return hashlib.sha256("\n".join(sorted(map(files.plain, roots))).encode()).hexdigest()[:16]

    def _document(self, roots) -> str:
        return f"{self.root}/{self.key(roots)}/catalog.json"

    def folder(self, roots, index: str) -> str:
        return f"{self.root}/{self.key(roots)}/index={index}"

    def _read(self, path: str) -> TableEntry:
        d = json.loads(files.read_text(self.spark, path))
        return TableEntry(**d | {"indexes": {n: IndexDef(**i) for n, i in d["indexes"].items()}})

    def load(self, roots) -> TableEntry | None:
        key, path = self.key(roots), self._document(roots)
        stamp = files.stamp(self.spark, path)
        if key not in self._held or self._held[key][0] != stamp:
            self._held[key] = stamp, self._read(path) if stamp else None
        return self._held[key][1]

    def save(self, entry: TableEntry) -> None:
        """Replaces the document if it still has the version that ``entry`` was read with."""
        key, path = self.key(entry.roots), self._document(entry.roots)
        now = self._read(path).version if files.stamp(self.spark, path) else 0
        if now != entry.version:
            self._held.pop(key, None)
            raise ChangedElsewhere(f"the indexes of {entry.name} were changed by another session; repeat the statement")
        entry.version += 1
        files.replace_text(self.spark, path, json.dumps(asdict(entry), indent=1))
        self._held[key] = files.stamp(self.spark, path), entry

    def forget(self) -> None:
        """Rereads documents that another session may have changed."""
        self._held.clear()

    @staticmethod
    def new_id() -> str:
        return uuid.uuid4().hex[:12]

"""The table cache: which tables are kept, how, and what is kept now."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .catalog import Catalog

_NESTED = (T.ArrayType, T.MapType, T.StructType)


class TableCache:
    """Tables persisted at their first optimized scan; Spark's block manager evicts and locates."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._held: dict[str, tuple[str, DataFrame]] = {}

    @staticmethod
    def level(vector: bool, binary: bool) -> StorageLevel | None:
        if vector and binary:
            raise ValueError("the data cache and the binary cache exclude each other")
        return StorageLevel.MEMORY_AND_DISK if vector else StorageLevel.DISK_ONLY if binary else None

    def table(self, name: str, roots, df: DataFrame, level: StorageLevel) -> DataFrame:
        """``df``, kept; tables with nested columns are kept on disk only in their raw form or not at all."""
        if level == StorageLevel.MEMORY_AND_DISK and any(isinstance(f.dataType, _NESTED) for f in df.schema.fields):
            return df
        key = Catalog.key(roots)
        if key not in self._held:
            self._held[key] = (name, df.persist(level))
        return self._held[key][1]

    def drop(self, roots=None) -> None:
        for key in [Catalog.key(roots)] if roots is not None else list(self._held):
            if key in self._held:
                self._held.pop(key)[1].unpersist()

    def stats(self) -> DataFrame:
        """A row for each kept dataset: name, partitions kept and in all, bytes in memory and on disk."""
        rows = [(i.name()[:200], i.numCachedPartitions(), i.numPartitions(), i.memSize(), i.diskSize()) for i in self.spark.sparkContext._jsc.sc().getRDDStorageInfo()]
        return self.spark.createDataFrame(rows, "name string, cached_partitions int, partitions int, memory_bytes long, disk_bytes long")


@dataclass
class PathGate:
    """Paths that may be kept: those that match ``allow`` and don't match ``deny``; with hit and miss counts."""

    allow: str = ".*"
    deny: str | None = None
    hits: int = 0
    misses: int = 0
    _seen: set[str] = field(default_factory=set)

    def allows(self, path: str) -> bool:
        return bool(re.search(self.allow, path)) and not (self.deny and re.search(self.deny, path))

    def cache_paths(self, cache: TableCache, spark: SparkSession, fmt: str, paths: list[str], level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
        """A read of ``paths``, kept if all of them pass the gate."""
        df = spark.read.format(fmt).load(paths)
        if not all(map(self.allows, paths)):
            return df
        key = Catalog.key(paths)
        self.hits += key in self._seen
        self.misses += key not in self._seen
        self._seen.add(key)
        return cache.table(",".join(paths), paths, df, level)

"""Plumbing that the operators share: the shared folder, materialised tables, Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Java and RE2 regular expression of one word.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, a temporary one in local runs.

    On a cluster executors would each write to a disk of their own, so there it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quern-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_shared(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again; the files go when the driver's JVM ends.

    A later stage that loses an executor rereads the files instead of repeating ``df``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, fs = _path(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


def drop_shared(spark: SparkSession, path: str) -> None:
    where, fs = _path(spark, path)
    fs.delete(where, True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else unchanged.  ``lower`` does the same for pure ASCII and is much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc32_of_id(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The bytes of a string or binary column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist() if not pa.types.is_binary(column.type) else column.to_pylist()


def record_batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, weight=None, most_weight: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Tuples to record batches of at most ``most`` rows and about ``most_weight`` bytes by ``weight(row)``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row) if weight else 0
        if len(held) >= most or size >= most_weight:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def release() -> None:
    """Memory that Arrow and the C library hold but don't use goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, which gives unused memory back after each batch and at its end.

    Workers stay for later tasks: what a stage's texts took would else be held beside what the next stage takes.
    """

    def each(batches):
        for b in batches:
            yield b
            del b
            release()

    def released(batches):
        yield from run(each(batches))
        release()

    return released

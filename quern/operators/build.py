"""Index builders: keys with the rows that hold them, per data file, as sorted Parquet.

A B-tree is a table ``(k0, k1, ..., file, rows, row_ids)`` sorted by its keys: the least and
greatest keys of row groups and pages, which Parquet keeps, are its inner nodes.  A bitmap
index has ``(k0, file, bucket, rows, positions, bitmap)`` instead.  Null keys are kept like any other.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import plain_column

#: Key types; others are refused.
KEY_TYPES = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def keyed_rows(spark: SparkSession, fmt: str, paths: list[str], columns: list[str], roots: tuple[str, ...], schema: T.StructType) -> DataFrame:
    """``(k0, ..., file, row)`` of data files; ``row`` is null where the format has no row numbers."""
    df = spark.read.format(fmt).schema(schema).options(**({"basePath": roots[0]} if len(roots) == 1 else {})).load(paths)
    row = F.col("_metadata.row_index") if fmt == "parquet" else F.lit(None).cast("long")
    return df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)], plain_column(F.col("_metadata.file_path")).alias("file"), row.alias("row"))


def _sorting(columns: list[list]) -> list[Column]:
    return [F.col(f"k{i}").asc_nulls_last() if ascending else F.col(f"k{i}").desc_nulls_first() for i, (_, ascending) in enumerate(columns)]


def btree(rows: DataFrame, columns: list[list]) -> tuple[DataFrame, list[Column]]:
    """Entries, and the order that their files have."""
    keys = [f"k{i}" for i in range(len(columns))]
    entries = rows.groupBy(*keys, "file").agg(F.count("*").alias("rows"), F.array_sort(F.collect_list("row")).alias("row_ids"))
    return entries, [*_sorting(columns), F.col("file")]


#: Rows of a bucket up to which positions (2 bytes each) are smaller than its bitmap of 4096 bytes.
SPARSE = 2048


def bitmap(rows: DataFrame, columns: list[list]) -> tuple[DataFrame, list[Column]]:
    """Entries, and the order that their files have.  Row r is position r modulo 32768 of bucket r / 32768 (rounded down; buckets count from 1).

    A key's rows within a bucket are a sorted list of ``positions`` if they are few, else a
    ``bitmap``; both are gathered in one pass.
    """
    place = F.bitmap_bit_position(_row_number())
    listed = rows.groupBy("k0", "file", _bucket(rows).alias("bucket")).agg(F.count("*").alias("rows"), F.collect_list(place.cast("short")).alias("positions"), F.bitmap_construct_agg(place).alias("bitmap"))
    few = F.col("rows") <= SPARSE
    return listed.select("k0", "file", "bucket", "rows", F.when(few, F.sort_array("positions")).alias("positions"), F.when(~few, F.col("bitmap")).alias("bitmap")), [*_sorting(columns), F.col("file"), F.col("bucket")]


def _row_number() -> Column:
    return F.coalesce(F.col("row"), F.lit(0)) + 1  # bucket numbers of the built-in functions begin at 1 for value 1


def _bucket(rows: DataFrame) -> Column:
    return F.col("bucket") if "bucket" in rows.columns else F.bitmap_bucket_number(_row_number())


BUILDERS = {"BTREE": btree, "BITMAP": bitmap}
#: Rows that a sorted file of an index stands for, about: what one task gathers and sorts.
ROWS_A_FILE = 250_000
#: Bytes of data or index files that one task reads, while an index is built.
READ_BYTES = 8 << 20


@contextmanager
def small_reads(spark: SparkSession):
    """Spark plans scans of at most ``READ_BYTES`` a task meanwhile (a row group stays whole), so that what a
    task sorts or gathers of them doesn't grow with the table."""
    settings = {"spark.sql.files.maxPartitionBytes": READ_BYTES, "spark.sql.files.openCostInBytes": 1 << 20}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write(rows: DataFrame, kind: str, columns: list[list], path: str) -> T.StructType:
    """Builds an index of ``kind`` over ``rows(k0, ..., file, row)``, sorted by key, at ``path``; its schema.

    Rows are dealt into ranges of the index's order, about ``ROWS_A_FILE`` each, before they are
    gathered: a range is gathered, sorted and written by one task, and an entry lies in one range.
    """
    parts = -(-rows.count() // ROWS_A_FILE)
    if parts > 1:
        if kind == "BITMAP":
            rows = rows.withColumn("bucket", _bucket(rows))
        rows = rows.repartitionByRange(parts, *_sorting(columns), "file", *(["bucket"] if kind == "BITMAP" else []))
    entries, order = BUILDERS[kind](rows, columns)
    (entries if parts > 1 else entries.coalesce(1)).sortWithinPartitions(*order).write.parquet(path)
    return entries.schema

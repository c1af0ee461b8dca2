"""Reads of single rows: only row groups that hold a wanted row are opened."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Value of a null in a Hive-style partition path (a fixed value of the layout).
HIVE_NULL = "__HIVE_DEFAULT_PARTITION__"


def partition_value(file: Column, name: str, kind: T.DataType) -> Column:
    """A partition column's value from its file's path."""
    raw = F.regexp_extract(file, rf"/{name}=([^/]*)/", 1)
    return F.when(raw == HIVE_NULL, F.lit(None)).otherwise(raw).cast(kind)


#: Rows of a file that are listed together, and those that go to one task; whole buckets of a bitmap index.
BLOCK, SHARE = 1 << 16, 1 << 20
#: Row numbers of an entry that are dealt out together.
PIECE = 1 << 13


class _Cursor:
    """A file read forwards, a batch at a time, from the row groups that are asked for."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.source = path, pq.ParquetFile(path, memory_map=False)
        have = set(self.source.schema_arrow.names)
        self.names = [n for n in names if n in have]
        self.ends = np.cumsum([self.source.metadata.row_group(g).num_rows for g in range(self.source.metadata.num_row_groups)])
        self.group, self.batches, self.batch, self.begin, self.end = -1, None, None, 0, 0

    def take(self, rows: np.ndarray):
        """Tables of the sorted ``rows``; none of them lies before those taken last."""
        at = 0
        while at < len(rows):
            group = int(np.searchsorted(self.ends, rows[at], "right"))
            if group != self.group:
                self.group, self.begin = group, int(self.ends[group - 1]) if group else 0
                self.end = self.begin
                self.batches = self.source.iter_batches(BLOCK, [group], self.names) if self.names else None
            if not self.names:  # rows without a column of the file
                upto = int(np.searchsorted(rows, self.ends[group]))
                yield None, upto - at
                at = upto
                continue
            while rows[at] >= self.end:
                self.batch = next(self.batches)
                self.begin, self.end = self.end, self.end + self.batch.num_rows
            upto = int(np.searchsorted(rows, self.end))
            yield self.batch.take(pa.array(rows[at:upto] - self.begin)), upto - at
            at = upto


def pieces(entries: DataFrame) -> DataFrame:
    """``(file, share, start, offsets, bitmap)`` of index entries: row numbers are ``start`` and each of ``offsets``, or of the bitmap's bits.

    Entries are cut at the shares of their file but stay lists and bitmaps, so that the tasks which
    read an index pass on a few bytes a row, not a row with its file's name.
    """
    share = lambda row: F.floor(row / SHARE)
    if "row_ids" not in entries.columns:
        start = (F.col("bucket") - 1) * 32768
        return entries.select("file", share(start).alias("share"), start.alias("start"), F.col("positions").cast("array<long>").alias("offsets"), "bitmap")
    ids = F.col("row_ids")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / PIECE).cast("int")), lambda i: F.slice(ids, i * PIECE + 1, F.lit(PIECE)))
    cut = entries.where(F.size(ids) > 0).select("file", F.explode(F.when(F.size(ids) <= PIECE, F.array(ids)).otherwise(parts)).alias("part"))
    first, last = share(F.element_at("part", 1)), share(F.element_at("part", -1))
    cut = cut.select("file", "part", (first == last).alias("whole"), F.explode(F.sequence(first, last)).alias("share"))
    within = F.when(F.col("whole"), F.col("part")).otherwise(F.filter("part", lambda r: share(r) == F.col("share")))
    return cut.select("file", "share", F.lit(0).cast("long").alias("start"), within.alias("offsets"), F.lit(None).cast("binary").alias("bitmap"))


def _listed(dealt: DataFrame) -> DataFrame:
    """``(file, share, row)`` of ``pieces``."""
    byte = lambda i: F.conv(F.hex(F.substring(F.col("bitmap"), i, F.lit(1))), 16, 10).cast("int")
    bits = lambda v, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.getbit(v, b) == 1), lambda b: (i * 8 + b).cast("long"))
    set_ = F.flatten(F.transform(F.transform(F.sequence(F.lit(1), F.octet_length("bitmap")), byte), bits))
    offset = F.explode(F.when(F.col("bitmap").isNull(), F.col("offsets")).otherwise(set_)).alias("offset")
    return dealt.select("file", "share", "start", offset).select("file", "share", (F.col("start") + F.col("offset")).alias("row"))


def read_rows(wanted: DataFrame, columns: T.StructType, tasks: int, need: int = 1) -> DataFrame:
    """``columns`` and ``file`` of the rows ``wanted(file, row)`` or ``pieces`` of them, from Parquet files that executors can open.

    Rows are listed by block of their file; a task has neighbouring blocks in turn and reads their row
    groups batch by batch, so its memory depends neither on the file nor on how many rows are wanted.
    Only rows that are listed ``need`` times are read: once by each of so many indexes.
    """
    out = T.StructType([*columns.fields, T.StructField("file", T.StringType())])
    schema = to_arrow_schema(out)
    names = [f.name for f in columns.fields]

    def run(batches):
        cursor = None
        for b in batches:
            listed = b.column(1)
            for i in range(b.num_rows):
                path, (rows, times) = b.column(0)[i].as_py(), np.unique(listed[i].values.to_numpy(zero_copy_only=False), return_counts=True)
                rows = rows[times >= need]
                if cursor is None or cursor.path != path:
                    if cursor:
                        cursor.source.close()
                    cursor = _Cursor(path, names)
                for found, n in cursor.take(rows):
                    filled = [found.column(f.name).cast(f.type) if f.name in cursor.names else pa.nulls(n, f.type) for f in list(schema)[:-1]]
                    whole = pa.table([*filled, pa.array([path] * n, pa.string())], schema=schema)
                    yield from whole.combine_chunks().to_batches(max_chunksize=10_000)
        if cursor:
            cursor.source.close()

    listed = "offsets" in wanted.columns
    dealt = (wanted if listed else wanted.select("file", "row", F.floor(F.col("row") / SHARE).alias("share"))).repartition(tasks, "file", "share")
    dealt = (_listed(dealt) if listed else dealt).withColumn("block", F.floor(F.col("row") / BLOCK))
    grouped = dealt.groupBy("file", "share", "block").agg(F.collect_list("row").alias("rows")).sortWithinPartitions("file", "block")
    return grouped.select("file", "rows").mapInArrow(run, out)


def decode_bitmaps(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(*keys, file, row)`` of ``(k0, file, bucket, positions, bitmap)``: lists are exploded, bitmaps of
    one file and bucket (and key, if it is kept) united first.  Each row has one key, so nothing comes twice."""
    keys = keys or []
    start = (F.col("bucket") - 1) * 32768
    listed = entries.where("positions IS NOT NULL").select(*keys, "file", start.alias("start"), F.explode("positions").alias("p")).select(*keys, "file", (F.col("start") + F.col("p")).alias("row"))
    united = entries.where("bitmap IS NOT NULL").groupBy(*keys, "file", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    # Bytes that are not zero, then their bits.
    byte = F.posexplode(F.transform(F.sequence(F.lit(1), F.octet_length("bitmap")), lambda i: F.conv(F.hex(F.substring(F.col("bitmap"), i, F.lit(1))), 16, 10).cast("int")))
    bytes_ = united.select(*keys, "file", "bucket", byte.alias("at", "byte")).where("byte <> 0")
    bits = bytes_.select(*keys, "file", "bucket", "at", F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.getbit(F.col("byte"), i) == 1)).alias("bit"))
    return listed.unionByName(bits.select(*keys, "file", (start + F.col("at") * 8 + F.col("bit")).alias("row")))

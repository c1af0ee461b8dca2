"""Small files and folders through Hadoop's file systems, so that any store Spark reads will do."""

from __future__ import annotations

import re
import tempfile
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _fs(spark, path)
    return fs.exists(where)


def stamp(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """Time and size of a file; None if there is none."""
    where, fs = _fs(spark, path)
    if not fs.exists(where):
        return None
    found = fs.getFileStatus(where)
    return int(found.getModificationTime()), int(found.getLen())


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _fs(spark, path)
    fs.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _fs(spark, path)
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the target, then renames over it: a reader sees the old or the new text."""
    target, fs = _fs(spark, path)
    beside, _ = _fs(spark, f"{path}.new")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    overwrite = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._jvm.org.apache.hadoop.fs.Options
    rename = spark.sparkContext._gateway.new_array(getattr(options, "Rename"), 1)
    rename[0] = getattr(options, "Rename").OVERWRITE
    overwrite.rename(fs.makeQualified(beside), fs.makeQualified(target), rename)


def plain(path: str) -> str:
    """A file's path without encoding and, for local files, without a scheme."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return unquote(parts.path)
    return unquote(path)


def plain_column(path: Column) -> Column:
    """``plain`` for ``_metadata.file_path``."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, r"^file:/{1,3}(?=/)|^file:(?=/)", "")


def is_local(path: str) -> bool:
    return urlsplit(path).scheme in ("", "file")


def workspace(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``, or, where that is
    unset in a local run, a temporary one.  On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")

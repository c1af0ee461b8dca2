"""Statistics of each indexed file, and what they say about reading it.

Built as aggregates over index entries, a row a file.  Bloom filters and samples are held
against a predicate where they lie; the driver, which lists the files anyway, decides.  MINMAX, BLOOM, SAMPLE and PARTBYVALUE give a share of rows that a read
would hit, or that it hits none.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import order
from ..plans.intervals import KeySet

KINDS = ("BLOOM", "MINMAX", "PARTBYVALUE", "SAMPLE")
#: What a judgement says: none of the file's rows can match; read by index; read whole.
SKIP, USE, FULL = "SKIP", "USE_INDEX", "FULL_SCAN"


@dataclass(frozen=True)
class Options:
    kinds: tuple[str, ...] = KINDS
    part_num: int = 5
    sample_rate: float = 0.05
    sample_min: int = 24
    sample_max: int = 1000
    bloom_bits: int = 1 << 20
    bloom_hashes: int = 3
    threshold: float = 0.2


def _bloom_place(keys: list, seed: int, bits: int):
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(bits)) + 1


def build(entries: DataFrame, width: int, options: Options, generation: str, rows: DataFrame | None = None, tasks: int = 1) -> DataFrame:
    """``(file, gen, rows, entries, index_bytes, dense, nulls, min0, max0, ..., bloom, sample, cuts)``.

    Bitmap indexes have only the first part (they need no more: their entries are few).
    ``rows(k0, ..., file, row)`` are the indexed rows by file: Bloom bits and samples of a file come from
    few tasks there, from each range of keys among entries.  ``tasks``: how many share the cut points' keys.
    ``entries`` are read from the index's own files.
    """
    keys = [f"k{i}" for i in range(width)]
    kind = {k: entries.schema[k].dataType for k in keys}
    is_btree = "row_ids" in entries.columns
    size = F.sum(F.lit(8) + sum((F.coalesce(F.octet_length(F.col(k).cast("string")), F.lit(0)) for k in keys), F.lit(0)) + (8 * F.size("row_ids") if is_btree else F.coalesce(F.octet_length("bitmap"), 2 * F.size("positions"))))
    base = entries.groupBy("file").agg(
        F.lit(generation).alias("gen"),
        F.sum("rows").alias("rows"),
        F.count("*").alias("entries"),
        size.cast("long").alias("index_bytes"),
        (F.lit(0) if is_btree else F.count("bitmap")).cast("long").alias("dense"),
        *[x for i, k in enumerate(keys) for x in (F.sum(F.when(F.col(k).isNull(), F.col("rows")).otherwise(0)).alias(f"nulls{i}"), F.min(k).alias(f"min{i}"), F.max(k).alias(f"max{i}"))],
    )
    empty = {"bloom": T.ArrayType(T.StructType([T.StructField("bucket", T.LongType()), T.StructField("bitmap", T.BinaryType())])), "sample": T.ArrayType(T.StructType([T.StructField(k, kind[k]) for k in keys])), "cuts": T.ArrayType(T.StructType([T.StructField("key", kind["k0"]), T.StructField("rows", T.LongType())]))}
    if not is_btree:
        return base.select("*", *[F.lit(None).cast(t).alias(n) for n, t in empty.items()])
    parts = base
    if "BLOOM" in options.kinds:
        # Each leading part of the key is added: a read may fix a prefix of the columns only.
        places = F.array(*[_bloom_place([F.lit(n), *keys[:n]], s, options.bloom_bits) for n in range(1, width + 1) for s in range(options.bloom_hashes)])
        marks = _bitmaps((entries if rows is None else rows).select("file", F.explode(places).alias("at")))
        parts = parts.join(marks.groupBy("file").agg(F.collect_list(F.struct("bucket", "bitmap")).alias("bloom")), "file", "left")
    else:
        parts = parts.withColumn("bloom", F.lit(None).cast(empty["bloom"]))
    if "SAMPLE" in options.kinds:
        # A hash in place of a random draw: the same rows on every build.
        sizes = base.select("file", F.least(F.greatest(F.lit(options.sample_rate), F.least(F.lit(1.0), options.sample_min / F.col("rows"))), options.sample_max / F.col("rows")).alias("share"))
        drawn = entries.select("file", *keys, F.explode("row_ids").alias("row")) if rows is None else rows.where("row IS NOT NULL")
        drawn = drawn.join(F.broadcast(sizes), "file").where(F.pmod(F.xxhash64(F.lit(11), "row"), F.lit(1 << 20)) < F.col("share") * (1 << 20))
        parts = parts.join(drawn.groupBy("file").agg(F.collect_list(F.struct(*keys)).alias("sample")), "file", "left")
    else:
        parts = parts.withColumn("sample", F.lit(None).cast(empty["sample"]))
    if "PARTBYVALUE" in options.kinds:
        cuts = cut_points(entries, width, options.part_num, tasks)
        parts = parts.join(cuts.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("key", "rows"))).alias("cuts")), "file", "left")
    else:
        parts = parts.withColumn("cuts", F.lit(None).cast(empty["cuts"]))
    return parts.select(*base.columns, *empty)


def cut_ranges(entries: DataFrame, width: int, part_num: int, tasks: int) -> DataFrame:
    """``(file, bin, k0, n, base, ats)``: the keys of those ranges of each file in which a cut point lies.

    A file of the index is a range of keys, a ``bin``: counted by file and bin, ranks of the cut points say
    in which bins they lie (``ats``: ranks within the bin; ``base``: rows before it), and only
    these are dealt out to be ranked, so a task holds some bins of a data file, never the file.
    """
    found = entries.where("k0 IS NOT NULL").select("file", "k0", F.col("rows").alias("n"), F.col("_metadata.file_name").alias("bin"))
    if width > 1:  # a leading key may lie in several bins: it counts in one
        found = found.repartition(tasks, "file", "k0") if tasks > 1 else found
        found = found.groupBy("file", "k0").agg(F.sum("n").alias("n"), F.min("bin").alias("bin"))
    by_file = Window.partitionBy("file")
    upto = by_file.orderBy("low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = found.groupBy("file", "bin").agg(F.min("k0").alias("low"), F.count("*").alias("keys"), F.sum("n").alias("rows"))
    sizes = sizes.select("file", "bin", "keys", (F.sum("keys").over(upto) - F.col("keys")).alias("before"), (F.sum("rows").over(upto) - F.col("rows")).alias("base"), F.sum("keys").over(by_file).alias("of"))
    step = F.ceil(F.col("of") / part_num)
    ranks = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0), F.lit(part_num - 1)), lambda i: i * step + 1), F.array("of")))
    within = F.filter(F.transform(ranks, lambda r: r - F.col("before")), lambda r: (r >= 1) & (r <= F.col("keys")))
    asked = sizes.select("file", "bin", "base", within.alias("ats")).where(F.size("ats") > 0)
    ranked = found.join(F.broadcast(asked), ["file", "bin"])
    return ranked.repartitionByRange(tasks, "file", "bin") if tasks > 1 else ranked


def cut_points(entries: DataFrame, width: int, part_num: int, tasks: int) -> DataFrame:
    """``(file, key, rows)``: of each file's distinct keys in turn the first of each of ``part_num`` parts and the last, with the rows up to it."""
    by_key = Window.partitionBy("file", "bin").orderBy("k0")
    counted = cut_ranges(entries, width, part_num, tasks).select("file", "k0", "ats", F.row_number().over(by_key).cast("long").alias("at"), (F.col("base") + F.sum("n").over(by_key)).alias("upto"))
    return counted.where(F.array_contains("ats", F.col("at"))).select("file", F.col("k0").alias("key"), F.col("upto").alias("rows"))


def _bitmaps(places: DataFrame) -> DataFrame:
    """``(file, bucket, bitmap)`` of ``places(file, at)``, as ``bitmap_construct_agg`` makes them.

    Bits are united in words of 64 first, 16,384 words a file at the default size: a hash table
    holds these, where the aggregate of bitmaps would have all places sorted.
    """
    at = F.bitmap_bit_position("at")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    words = places.groupBy("file", F.bitmap_bucket_number("at").alias("bucket"), F.floor(at / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    # A bitmap's bytes run from the low bits of its words; zeros stand between words that have any.
    low_first = F.regexp_replace(F.reverse(F.lpad(F.hex("bits"), 16, "0")), "(.)(.)", "$2$1")
    listed = words.select("file", "bucket", "word", low_first.alias("text")).groupBy("file", "bucket").agg(F.array_sort(F.collect_list(F.struct("word", "text"))).alias("w"))
    spaced = F.transform("w", lambda x, i: F.concat(F.repeat(F.lit("0"), (16 * (x["word"] - F.coalesce(F.get("w", i - 1)["word"], F.lit(-1)) - 1)).cast("int")), x["text"]))
    return listed.select("file", "bucket", F.unhex(F.rpad(F.array_join(spaced, ""), 8192, "0")).alias("bitmap"))


def bloom_places(spark: SparkSession, values: list[tuple], types: list[T.DataType], options: Options) -> list[list[int]]:
    """Bit places of key prefixes, hashed by Spark as when building."""
    if len(values) <= 20:  # literals are folded by the optimizer
        columns = [_bloom_place([F.lit(len(types)), *[F.lit(v).cast(t) for v, t in zip(row, types)]], s, options.bloom_bits) for row in values for s in range(options.bloom_hashes)]
        found = list(spark.sql("SELECT 1").select(*[c.alias(f"p{i}") for i, c in enumerate(columns)]).first())
        return [found[i : i + options.bloom_hashes] for i in range(0, len(found), options.bloom_hashes)]
    schema = T.StructType([T.StructField(f"k{i}", t) for i, t in enumerate(types)])
    keys = [F.col(f"k{i}") for i in range(len(types))]
    df = spark.createDataFrame(values, schema).select(*[_bloom_place([F.lit(len(types)), *keys], s, options.bloom_bits).alias(f"p{s}") for s in range(options.bloom_hashes)])
    return [list(r) for r in df.collect()]


def bloom_may_hold(bloom: Column, places: list[list[int]]) -> Column:
    """Whether the bits of all ``places`` of one of the keys are set in a manifest's ``bloom``."""

    def held(p: int) -> Column:
        bucket, bit = (p - 1) // 32768 + 1, (p - 1) % 32768
        byte = lambda b: F.conv(F.hex(F.substring(b["bitmap"], bit // 8 + 1, 1)), 16, 10).cast("int")
        return F.exists(bloom, lambda b: (b["bucket"] == bucket) & (byte(b).bitwiseAND(1 << bit % 8) != 0))

    return reduce(Column.__or__, [reduce(Column.__and__, map(held, key)) for key in places], F.lit(False))


def _rows_below(cuts: list, value: Any, inclusive: bool) -> float:
    """Rows of keys up to ``value``, estimated between cut points."""
    keys = [order(c["key"]) for c in cuts]
    v = order(value)
    i = (bisect_right if inclusive else bisect_left)(keys, v)
    if i == 0:
        return 0.0
    if i == len(cuts):
        return float(cuts[-1]["rows"])
    low, high = cuts[i - 1]["rows"], cuts[i]["rows"]
    if keys[i - 1] == v:
        return float(low)
    a, b = cuts[i - 1]["key"], cuts[i]["key"]
    share = (value - a) / (b - a) if isinstance(value, (int, float)) and isinstance(a, (int, float)) and b > a else 0.5
    return low + (high - low) * min(1.0, max(0.0, share))


def coverage_by_cuts(cuts: list, keys: KeySet) -> float:
    """Share of the non-null rows whose key is in ``keys``; a point counts as half a part at most."""
    total = cuts[-1]["rows"]
    hit = 0.0
    for i in keys.intervals:
        high = float(total) if i.hi is None else _rows_below(cuts, i.hi, i.hi_in)
        low = 0.0 if i.lo is None else _rows_below(cuts, i.lo, not i.lo_in)
        hit += max(high - low, 1.0 if i.overlaps(cuts[0]["key"], cuts[-1]["key"]) else 0.0)
    return min(1.0, hit / total) if total else 0.0


def may_hold(row: dict, sets: list[KeySet]) -> bool:
    """Whether a file's least and greatest keys leave room for the key sets of the leading columns."""
    return all(s.may_hold(row[f"min{i}"], row[f"max{i}"], row[f"nulls{i}"]) for i, s in enumerate(sets))


def judge(row: dict, sets: list[KeySet], judged: dict, options: Options) -> tuple[str, float | None]:
    """SKIP, USE_INDEX or FULL_SCAN for a file of an index, with the mean share it was judged by.

    ``sets`` are those of the leading key columns in turn; ``judged`` has what the file's Bloom
    filter (``held``) and sample (``share``) say of them, where they were asked.
    """
    if not may_hold(row, sets) or not judged.get("held", True):
        return SKIP, None
    shares = []
    if judged.get("share") is not None:
        shares.append(judged["share"])
    if "PARTBYVALUE" in options.kinds and row.get("cuts") and not sets[0].null:
        shares.append(coverage_by_cuts(row["cuts"], sets[0]))
    if not shares:
        return USE, None
    mean = sum(shares) / len(shares)
    return (USE if mean <= options.threshold else FULL), mean

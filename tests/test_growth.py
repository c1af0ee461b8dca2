"""What one task holds does not grow with the table: the steps that F1 to F20 of round 3 share."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.operators import build, queries, statistics
from quern.session import Engine
from quern.sources import rows

SF = "/root/testdata/sf0.001"


def table(spark, tmp_path, n=3000, files=3):
    spark.range(n).select(F.col("id").alias("a"), (F.col("id") % 2).alias("b"), F.concat(F.lit("row "), F.col("id")).alias("c")).repartitionByRange(files, "a").write.parquet(str(tmp_path / "t"))
    engine = Engine(spark, str(tmp_path / "index"))
    engine.register("growing", str(tmp_path / "t"))
    return engine


def test_manifest_is_not_joined_in_the_task_that_writes_it(spark, tmp_path, monkeypatch):
    frame = type(spark.range(0))
    plain = frame.coalesce

    def guarded(self, n):
        assert "Join" not in self._jdf.queryExecution().optimizedPlan().toString()
        return plain(self, n)

    monkeypatch.setattr(frame, "coalesce", guarded)
    table(spark, tmp_path).sql("CREATE OINDEX i ON growing (a, b)")


@pytest.mark.parametrize("using", ["BTREE", "BITMAP"])
def test_a_task_gathers_few_rows_of_an_index(spark, tmp_path, monkeypatch, using):
    """A key of half the rows of three files: entries of a file and key stay whole, ranges of them are small."""
    monkeypatch.setattr(build, "ROWS_A_FILE", 500)
    engine = table(spark, tmp_path)
    engine.sql(f"CREATE OINDEX i ON growing (b) USING {using}")
    found = engine._index("growing", "i")
    held = [sum(pq.read_table(f, columns=["rows"], partitioning=None).column("rows").to_pylist()) for f in (tmp_path / "index").rglob("data-*/*.parquet")]
    assert sum(held) == 3000 and max(held) <= 1500, held
    assert engine.entries(found[1], found[3]).count() == 6
    assert engine.sql("SELECT count(*) FROM growing WHERE b = 1").first()[0] == 1500


@pytest.mark.parametrize("keys", ["k", "k DESC", "k, a"])
def test_cut_points_of_a_large_file_are_shared_by_tasks(spark, tmp_path, monkeypatch, keys):
    monkeypatch.setattr(build, "ROWS_A_FILE", 500)
    made = spark.range(6000).select(F.col("id").alias("a"), F.when(F.col("id") % 50 > 0, F.floor(F.col("id") * 7919 % 6000 / 3)).alias("k"))
    made.unionByName(made.where("a < 100").selectExpr("a", "5L AS k")).coalesce(1).write.parquet(str(tmp_path / "t"))
    engine = Engine(spark, str(tmp_path / "index"))
    engine.register("growing", str(tmp_path / "t"))
    engine.sql(f"CREATE OINDEX i ON growing ({keys})")
    _, roots, _, index = engine._index("growing", "i")
    counts = [tuple(r) for r in spark.table("growing").where("k IS NOT NULL").groupBy("k").count().orderBy("k").collect()]
    step = -(-len(counts) // 5)
    plain = [(k, sum(n for _, n in counts[: i + 1])) for i, (k, _) in enumerate(counts) if i % step == 0 or i == len(counts) - 1]
    (row,) = engine._manifest(index).values()
    assert [(c["key"], c["rows"]) for c in row["cuts"]] == plain
    dealt = statistics.cut_ranges(engine.entries(roots, index), len(index.columns), 5, 24)
    held = dealt.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert max(held) <= 500 < len(counts), held


def test_bitmaps_by_words(spark):
    places = spark.range(5000).select(F.concat(F.lit("f"), F.col("id") % 3).alias("file"), (F.pmod(F.xxhash64("id"), F.lit(1 << 17)) + 1).alias("at"))
    places = places.union(spark.createDataFrame([("f0", p) for p in (1, 64, 65, 32768, 32769, 131072)], places.schema))
    plain = places.groupBy("file", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    listed = lambda df: sorted(map(repr, df.collect()))
    assert listed(statistics._bitmaps(places)) == listed(plain)


def test_rows_of_one_file_are_shared_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rows, "BLOCK", 64)
    monkeypatch.setattr(rows, "SHARE", 256)
    spark.range(3000).select("id", (F.col("id") * 2).alias("x")).coalesce(1).write.option("parquet.block.size", 1024).parquet(str(tmp_path / "t"))
    (path,) = (tmp_path / "t").glob("*.parquet")
    wanted = spark.createDataFrame([(str(path), i) for i in range(0, 3000, 3)], "file string, row long")
    read = rows.read_rows(wanted, spark.read.parquet(str(path)).schema, 8)
    assert sorted((r["id"], r["x"]) for r in read.collect()) == [(i, 2 * i) for i in range(0, 3000, 3)]
    assert sum(n > 0 for n in read.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()) > 1


@pytest.mark.parametrize("using", ["BTREE", "BITMAP"])
def test_entries_are_dealt_as_lists_not_as_rows(spark, tmp_path, monkeypatch, using):
    """F13, F16: the tasks that read an index hand on its lists and bitmaps, whatever the number of rows they name."""
    monkeypatch.setattr(rows, "SHARE", 1 << 15)
    monkeypatch.setattr(rows, "PIECE", 1000)
    spark.range(100_000).select(F.col("id").alias("a"), F.when(F.col("id") % 40000 < 9, 2).otherwise(F.col("id") % 2).alias("b"), (F.col("id") % 3).alias("c")).coalesce(1).write.parquet(str(tmp_path / "t"))
    engine = Engine(spark, str(tmp_path / "index"))
    engine.register("growing", str(tmp_path / "t"))
    engine.sql(f"CREATE OINDEX i ON growing (b) USING {using}")
    engine.sql("CREATE OINDEX j ON growing (c) USING BITMAP")
    dealt, plain = [], rows.read_rows
    monkeypatch.setattr(rows, "read_rows", lambda wanted, *more: dealt.append(wanted.count()) or plain(wanted, *more))
    for k, v in {"index.file.policy": "false", "index.statistics.policy": "false"}.items():
        engine.set(k, v)
    try:
        for where, most, use in (("b = 1", 60, "1"), ("b = 2", 4, "1"), ("b IN (1, 2)", 60, "1"), ("b = 1 AND c = 2", 60, "2"), ("b = 0 AND c = 1", 60, "2")):
            engine.set("index.max.use", use)
            listed = lambda df: sorted(map(tuple, df.collect()))
            assert listed(engine.sql(f"SELECT * FROM growing WHERE {where}")) == listed(spark.table("growing").where(where))
            assert dealt and dealt.pop() <= most, where
    finally:
        for k in ("index.file.policy", "index.statistics.policy", "index.max.use"):
            spark.conf.unset(f"spark.quern.{k}")


def test_copies_read_little_in_a_task(spark, monkeypatch):
    """All findings: a task that deals out a copy's rows holds them; it reads ``READ_BYTES``, not 128 MB."""
    monkeypatch.setattr(queries, "_fixtures", {})
    f, seen = queries.fixture(spark, SF), []
    plain = f.source
    monkeypatch.setattr(f, "source", lambda t: seen.append(spark.conf.get("spark.sql.files.maxPartitionBytes")) or plain(t))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for name in ("qx_customer", "qx_orders_orc", "qx_orders_by_status", "qx_nulls", "qx_lineitem_keys"):
        f.table(name)
    assert set(seen) == {str(build.READ_BYTES)} and spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_copies_have_more_files_when_tables_grow(spark, monkeypatch):
    monkeypatch.setattr(queries, "_fixtures", {})
    monkeypatch.setattr(queries.Fixture, "FILE_BYTES", 2 << 10)
    f = queries.fixture(spark, SF)
    for name, least in (("qx_lineitem", 8), ("qx_orders_orc", 6), ("qx_nulls", 4)):
        f.table(name)
        assert len(spark.table(name).inputFiles()) > least
    # What counts files keeps eight of them.
    assert sorted(map(tuple, queries.QUERIES["scan_report"](spark, SF).collect())) == [("SKIP", 7), ("USE_INDEX", 1)]
    assert sorted(r["l_orderkey"] for r in queries.QUERIES["btree_eq"](spark, SF).collect()) == [7] * spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey = 7").count()

"""Indexed queries against the same queries without an index, on the fixtures of FIXTURES.md."""

import pathlib
import pickle
import random
import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quern.session import Engine
from quern.sources.cache import PathGate, TableCache
from quern.sources.catalog import ChangedElsewhere


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "index"))
    e.set("index.file.policy", False)
    yield e
    for key in ("index.disabled", "index.max.use", "index.statistics.policy", "index.file.policy", "row.reads", "cache.enabled", "cache.table.list.enabled", "cache.table.list", "parquet.data.cache", "parquet.binary.cache"):
        spark.conf.unset("spark.quern." + key)


def made(engine, tmp_path, df, fmt="parquet", partitions=(), name=None):
    name = name or f"t_{uuid.uuid4().hex[:8]}"
    writer = df.write.format(fmt)
    (writer.partitionBy(*partitions) if partitions else writer).save(str(tmp_path / name))
    engine.register(name, str(tmp_path / name), fmt)
    return name


def numbers(spark, n=300, files=3):
    """i, 'this is test i'."""
    return spark.range(1, n + 1).select(F.col("id").cast("int").alias("a"), F.concat(F.lit("this is test "), F.col("id").cast("string")).alias("b")).repartitionByRange(files, "a")


def same(engine, text, used=True):
    """The engine's rows are Spark's; whether an index decided on any file."""
    rows = lambda df: sorted(map(repr, df.collect()))
    df = engine.sql(text)
    report = engine.last_scan_report().collect()
    assert rows(df) == rows(engine.spark.sql(text)), text
    assert bool(report) == used, (text, report)
    return report


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_predicates_by_btree(engine, spark, tmp_path, fmt):
    t = made(engine, tmp_path, numbers(spark), fmt)
    engine.sql(f"CREATE OINDEX i1 ON {t} (a)")
    for w in ("a = 1", "1 = a", "a > 20 AND a <= 40", "a IN (1, 5, 999)", "a < 0", "a BETWEEN 5 AND 6 OR a = 9", f"a IN ({','.join(map(str, range(1, 40)))})", "a = NULL", "a IN (3, NULL)", "NOT (a = 3) AND a < 7"):
        if fmt == "orc" and w == "a IN (3, NULL)":
            continue  # Spark's own ORC reader fails on a null in a pushed IN
        same(engine, f"SELECT * FROM {t} WHERE {w}", used=w != "a = NULL")
    same(engine, f"SELECT * FROM {t} WHERE b = 'this is test 3'", used=False)
    same(engine, f"SELECT count(*) FROM {t}", used=False)


def test_strings_and_prefixes(engine, spark, tmp_path):
    """shuffled 'this{i} is test'."""
    df = spark.createDataFrame([(i, f"this{i} is test") for i in random.Random(1).sample(range(1, 91), 90)], "a int, b string").repartition(3)
    t = made(engine, tmp_path, df)
    engine.sql(f"CREATE OINDEX i1 ON {t} (b)")
    same(engine, f"SELECT * FROM {t} WHERE b LIKE 'this3%'", used=False)  # a prefix alone opens no index
    for w in ("b LIKE 'this3%' AND b > 'this35'", "b BETWEEN 'this4' AND 'this5' OR b LIKE 'this5%'", "b LIKE 'this3%' AND b = 'this31 is test'", "b >= 'this88'"):
        same(engine, f"SELECT * FROM {t} WHERE {w}", used="OR" not in w)


def test_null_keys(engine, spark, tmp_path):
    """F4, F15."""
    df = spark.range(1, 101).select(F.when(F.col("id") > 5, F.col("id").cast("int")).alias("a"), (F.col("id") % 3).cast("int").alias("k"), F.concat(F.lit("this is row "), F.col("id")).alias("c")).repartition(3)
    t = made(engine, tmp_path, df)
    engine.sql(f"CREATE OINDEX i1 ON {t} (a)")
    engine.sql(f"CREATE OINDEX i2 ON {t} (k, a)")
    engine.sql(f"CREATE OINDEX b1 ON {t} (a) USING BITMAP")
    for off in ("i1", "b1"):
        engine.sql(f"DISABLE OINDEX {off}")
        for w in ("a IS NULL", "a IS NULL OR a = 9", "a = 9 AND a IS NULL", "a <=> 7 AND a > 0", "a IS NOT NULL AND a < 12", "k = 1 AND a < 20", "k = 2 AND a IS NULL"):
            same(engine, f"SELECT * FROM {t} WHERE {w}")
        engine.sql(f"ENABLE OINDEX {off}")


def test_bitmap_takes_points_and_ranges_together(engine, spark, tmp_path):
    """A point or a range on one bitmap column loses no row."""
    t = made(engine, tmp_path, spark.range(0, 3072).select((F.col("id") % 20).cast("int").alias("a"), F.col("id").alias("r")).repartition(2))
    engine.sql(f"CREATE OINDEX b ON {t} (a) USING BITMAP")
    engine.set("index.statistics.policy", False)
    for w in ("a = 5 OR a > 17", "a IN (1, 2)", "a = 1", "a > 100", "a <> 3 AND a < 5"):
        same(engine, f"SELECT * FROM {t} WHERE {w}")
    with pytest.raises(AnalysisException, match="one single column"):
        engine.sql(f"CREATE OINDEX b2 ON {t} (a, r) USING BITMAP")


def test_bitmap_of_rows_beyond_one_bucket(engine, spark, tmp_path):
    t = made(engine, tmp_path, spark.range(0, 100_000, 1, 1).select((F.col("id") % 50_000).alias("a"), F.col("id").alias("r")))
    engine.sql(f"CREATE OINDEX b ON {t} (a) USING BITMAP")
    for a in (0, 32766, 32767, 32768, 49_999):
        same(engine, f"SELECT * FROM {t} WHERE a = {a}")


def test_intersection_of_indexes(engine, spark, tmp_path):
    """F8: (i % 13, (300 - i) % 17, i); a = 1 and b = 10 gives c = 1."""
    df = spark.range(1, 201).select((F.col("id") % 13).cast("int").alias("a"), ((300 - F.col("id")) % 17).cast("int").alias("b"), F.col("id").cast("int").alias("c")).repartition(2)
    t = made(engine, tmp_path, df)
    engine.sql(f"CREATE OINDEX ia ON {t} (a)")
    engine.sql(f"CREATE OINDEX ib ON {t} (b) USING BITMAP")
    engine.set("index.max.use", 2)
    report = same(engine, f"SELECT * FROM {t} WHERE a = 1 AND b = 10")
    assert {r["index"] for r in report if r["decision"] == "USE_INDEX"} <= {"ia,ib", "ia", "ib"}
    assert [r["c"] for r in engine.sql(f"SELECT c FROM {t} WHERE a = 1 AND b = 10").collect()] == [1]


def test_choice_of_index(engine, spark, tmp_path):
    """F9."""
    df = spark.range(1, 301).select(*[(F.col("id") + 100 * i).cast("int").alias(c) for i, c in enumerate("abcd")]).repartitionByRange(3, "a")
    t = made(engine, tmp_path, df)
    engine.sql(f"CREATE OINDEX i_abc ON {t} (a, b, c)")
    engine.sql(f"CREATE OINDEX i_a ON {t} (a)")
    assert {r["index"] for r in same(engine, f"SELECT * FROM {t} WHERE a = 5")} == {"i_a"}
    assert {r["index"] for r in same(engine, f"SELECT * FROM {t} WHERE a = 5 AND b = 105 AND c > 200")} == {"i_abc"}
    same(engine, f"SELECT * FROM {t} WHERE b = 105", used=False)
    engine.sql("DISABLE OINDEX i_a")
    engine.sql("DISABLE OINDEX i_abc")
    same(engine, f"SELECT * FROM {t} WHERE a = 5", used=False)


def test_composite_in_isnt_skipped(engine, spark, tmp_path):
    t = made(engine, tmp_path, spark.range(0, 400).select((F.col("id") / 20).cast("int").alias("a"), (F.col("id") % 20).cast("int").alias("b")).repartitionByRange(4, "a", "b"))
    engine.sql(f"CREATE OINDEX i ON {t} (a, b)")
    same(engine, f"SELECT * FROM {t} WHERE a = 7 AND b IN (19, 0, 7)")


def test_statistics_and_descending(engine, spark, tmp_path):
    t = made(engine, tmp_path, numbers(spark, 3000, 5))
    engine.sql(f"CREATE OINDEX i ON {t} (a DESC)")
    report = same(engine, f"SELECT * FROM {t} WHERE a = 10")
    assert sorted(r["decision"] for r in report) == ["SKIP"] * 4 + ["USE_INDEX"]
    report = same(engine, f"SELECT * FROM {t} WHERE a > 10")
    assert all(r["decision"] == "FULL_SCAN" and r["coverage"] > 0.2 for r in report)
    top = engine.file_top(t, "i", 1, ascending=False).select("a").collect()
    assert len(top) == 5 and max(r["a"] for r in top) == 3000


def test_bloom_finds_holes(engine, spark, tmp_path):
    """every 13th key is -1."""
    df = spark.range(1, 301).select(F.when(F.col("id") % 13 == 0, -1).otherwise(F.col("id")).cast("int").alias("a")).coalesce(1)
    t = made(engine, tmp_path, df)
    engine.sql(f"CREATE OINDEX i ON {t} (a)")
    assert [r["a"] for r in engine.sql(f"SELECT a FROM {t} WHERE a IN (1, 13, 26, 39, 52)").collect()] == [1]
    assert [r["decision"] for r in same(engine, f"SELECT a FROM {t} WHERE a IN (13, 26, 39, 52)")] == ["SKIP"]


def test_file_policy_and_switches(engine, spark, tmp_path):
    t = made(engine, tmp_path, numbers(spark))
    engine.sql(f"CREATE OINDEX i ON {t} (a)")
    engine.set("index.file.policy", True)
    assert {r["reason"] for r in same(engine, f"SELECT * FROM {t} WHERE a = 1 AND b > ''") if r["decision"] != "SKIP"} == {"index too large"}
    engine.set("cache.enabled", False)
    same(engine, f"SELECT * FROM {t} WHERE a = 1", used=False)


def test_appended_changed_and_refreshed(engine, spark, tmp_path):
    t = made(engine, tmp_path, numbers(spark))
    engine.sql(f"CREATE OINDEX i ON {t} (a)")
    path = str(tmp_path / t)
    numbers(spark).where("a < 20").write.mode("append").parquet(path)
    engine.register(t, path)
    assert "not indexed" in {r["reason"] for r in same(engine, f"SELECT * FROM {t} WHERE a = 10")}
    engine.sql(f"REFRESH OINDEX ON {t}")
    engine.sql(f"REFRESH OINDEX ON {t}")
    assert "not indexed" not in {r["reason"] for r in same(engine, f"SELECT * FROM {t} WHERE a = 10")}
    assert engine.sql(f"SELECT * FROM {t} WHERE a = 10").count() == 2
    spark.createDataFrame([(10, "new")], "a int, b string").write.mode("overwrite").parquet(path)
    engine.register(t, path)
    same(engine, f"SELECT * FROM {t} WHERE a = 10")
    assert any("not found!" in r[0] for r in engine.sql(f"CHECK OINDEX ON {t}").collect())
    engine.sql(f"REFRESH OINDEX ON {t}")
    assert engine.sql(f"CHECK OINDEX ON {t}").count() == 0
    same(engine, f"SELECT * FROM {t} WHERE a = 10")


def test_partitions(engine, spark, tmp_path):
    """an index on one partition of two."""
    df = spark.range(1, 301).select(F.col("id").cast("int").alias("a"), F.concat(F.lit("x"), F.col("id")).alias("b"), (F.col("id") % 2).cast("int").alias("c"))
    t = made(engine, tmp_path, df, partitions=["c"])
    engine.sql(f"CREATE OINDEX i ON {t} (a) PARTITION (c=1)")
    with pytest.raises(AnalysisException, match="exists"):
        engine.sql(f"CREATE OINDEX i ON {t} (a) PARTITION (c=1)")
    same(engine, f"SELECT * FROM {t} WHERE a IN (7, 8)")
    assert [r["c"] for r in engine.sql(f"SELECT c FROM {t} WHERE a = 7").collect()] == [1]
    assert [m[0].split("/")[-1] for m in engine.sql(f"CHECK OINDEX ON {t}").collect()] == ["c=0"]
    engine.sql(f"CREATE OINDEX IF NOT EXISTS i ON {t} (a)")  # the other partition is added
    assert engine.sql(f"CHECK OINDEX ON {t}").count() == 0
    same(engine, f"SELECT * FROM {t} WHERE a IN (7, 8) AND c = 1")
    with pytest.raises(AnalysisException, match="partition column"):
        engine.sql(f"DROP OINDEX i ON {t} PARTITION (z=1)")
    with pytest.raises(AnalysisException, match="Ambiguous"):
        engine.sql(f"CREATE OINDEX IF NOT EXISTS i ON {t} (b) PARTITION (c=0)")
    engine.sql(f"DROP OINDEX i ON {t} PARTITION (c=0)")
    assert [m[0].split("/")[-1] for m in engine.sql(f"CHECK OINDEX ON {t}").collect()] == ["c=0"]
    same(engine, f"SELECT * FROM {t} WHERE a IN (7, 8)")
    engine.sql(f"DROP OINDEX i ON {t}")
    assert engine.sql(f"SHOW OINDEX FROM {t}").count() == 0


def test_errors_and_show(engine, spark, tmp_path):
    t = made(engine, tmp_path, numbers(spark))
    with pytest.raises(AnalysisException, match="Column nope"):
        engine.sql(f"CREATE OINDEX i ON {t} (nope)")
    with pytest.raises(AnalysisException, match="does not exist"):
        engine.sql(f"DROP OINDEX i ON {t}")
    engine.sql(f"DROP OINDEX IF EXISTS i ON {t}")
    engine.sql(f"CREATE OINDEX i ON {t} (a, b DESC)")
    assert [tuple(r) for r in engine.sql(f"SHOW OINDEX FROM {t}").collect()] == [(t, "i", 0, "a", "A", "BTREE", True), (t, "i", 1, "b", "D", "BTREE", True)]
    nested = made(engine, tmp_path, spark.sql("SELECT array(1) AS a, 1 AS b"))
    with pytest.raises(AnalysisException, match="type"):
        engine.sql(f"CREATE OINDEX i ON {nested} (a)")
    spark.range(3).createOrReplaceTempView("plain_range")
    with pytest.raises(AnalysisException, match="relation"):
        engine.sql("SHOW OINDEX FROM plain_range")


def test_types_and_nested_columns(engine, spark, tmp_path):
    """keys of every kind; nested columns come back through row reads."""
    df = spark.range(0, 200).selectExpr("cast(id % 100 as byte) AS y", "cast(id as short) AS s", "id AS l", "id % 2 = 0 AS o", "cast(id as float) / 3 AS f", "CASE WHEN id = 5 THEN double('NaN') ELSE id / 7 END AS d", "cast(cast(id as string) as binary) AS n", "date_add(date'2020-01-01', cast(id as int)) AS t", "timestamp_seconds(id * 1000) AS ts", "cast(id as decimal(10,2)) AS m", "array(named_struct('p', id, 'q', map('k', id))) AS x").repartition(3)
    t = made(engine, tmp_path, df)
    for c in ("y", "s", "l", "o", "f", "d", "t", "ts", "m"):
        engine.sql(f"CREATE OINDEX i_{c} ON {t} ({c})")
    for w in ("y = 5", "s < 4", "l = 77", "d = double('NaN')", "d > 28.0", "t = date'2020-02-01'", "ts < timestamp'1970-01-01 01:00:00'", "m = 7.00", "f = cast(2 as float) / 3"):
        same(engine, f"SELECT l, to_json(x[0]) AS x, ts, t, m, hex(n) AS n FROM {t} WHERE {w}")


def test_self_join_subquery_and_shadowed_view(engine, spark, tmp_path):
    t = made(engine, tmp_path, numbers(spark))
    engine.sql(f"CREATE OINDEX i ON {t} (a)")
    same(engine, f"SELECT x.a FROM {t} x JOIN {t} y ON x.a = y.a WHERE x.a = 5 AND y.a = 5")
    same(engine, f"SELECT * FROM (SELECT a, b FROM {t}) WHERE a = 5")
    same(engine, f"SELECT a FROM {t} WHERE a = (SELECT max(id) FROM range(9))", used=False)
    assert spark.table(t).count() == 300  # the view is as it was


def test_limits_by_key(engine, spark, tmp_path):
    t = made(engine, tmp_path, spark.range(0, 60).select((F.col("id") % 3).alias("a"), F.col("id").alias("r")).coalesce(1))
    engine.sql(f"CREATE OINDEX i ON {t} (a)")
    engine.sql(f"CREATE OINDEX b ON {t} (a) USING BITMAP")
    for index in ("i", "b"):
        assert sorted(r["r"] for r in engine.key_limit(t, index, 2).collect()) == [0, 1, 2, 3, 4, 5]


def test_cache(engine, spark, tmp_path):
    t = made(engine, tmp_path, numbers(spark))
    with pytest.raises(ValueError):
        TableCache.level(True, True)
    engine.set("parquet.data.cache", True)
    assert engine.sql(f"SELECT * FROM {t} WHERE a = 5").count() == 1
    assert engine.cache_stats().count() >= 1
    plan = lambda: engine.sql(f"SELECT * FROM {t} WHERE a = 5")._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan()
    engine.set("cache.table.list.enabled", True)
    engine.set("cache.table.list", "default.other")
    engine.cache.drop()
    assert "InMemoryTableScan" not in plan()
    gate = PathGate(allow=r"\.parquet$", deny="secret")
    assert gate.allows("/x/a.parquet") and not gate.allows("/secret/a.parquet") and not gate.allows("/x/a.orc")


def test_random_predicates(engine, spark, tmp_path):
    """Random conditions, with and without row reads, give what Spark gives."""
    rng = random.Random(7)
    df = spark.createDataFrame([(rng.choice([None, *range(12)]), rng.choice([None, *"abcdef"]), i) for i in range(400)], "a int, b string, r int").repartition(3)
    t = made(engine, tmp_path, df)
    for statement in (f"CREATE OINDEX i1 ON {t} (a)", f"CREATE OINDEX i2 ON {t} (b, a)", f"CREATE OINDEX i3 ON {t} (b) USING BITMAP"):
        engine.sql(statement)

    def term():
        c = rng.choice("ab")
        v = lambda: str(rng.randrange(12)) if c == "a" else f"'{rng.choice('abcdefg')}'"
        return rng.choice([f"{c} = {v()}", f"{c} > {v()}", f"{c} <= {v()}", f"{c} IN ({v()}, {v()})", f"{c} IS NULL", f"{c} IS NOT NULL", f"{c} BETWEEN {v()} AND {v()}", f"NOT ({c} = {v()})"])

    def condition(depth):
        return term() if depth == 0 else f"({condition(depth - 1)} {rng.choice(['AND', 'OR'])} {condition(depth - 1)})"

    for k in range(14):
        engine.set("index.max.use", 1 + k % 2)
        engine.set("row.reads", k % 3 != 0)
        engine.set("index.statistics.policy", k % 4 != 0)
        text = f"SELECT * FROM {t} WHERE {condition(k % 3)} AND {condition(k % 2)}"
        rows = lambda df: sorted(map(repr, df.collect()))
        assert rows(engine.sql(text)) == rows(spark.sql(text)), text


def used_by(engine):
    return [r["decision"] for r in engine.last_scan_report().where("decision = 'USE_INDEX'").collect()]


def test_every_place_that_names_a_table(engine, spark, tmp_path):
    t = made(engine, tmp_path, numbers(spark))
    engine.sql(f"CREATE OINDEX i ON {t} (a)")
    for text in (
        f"SELECT x.a, y.b FROM {t} x JOIN {t} y ON x.a = y.a WHERE x.a = 5 AND y.a = 5",
        f"SELECT a FROM {t} WHERE a = 5 UNION ALL SELECT a FROM {t} WHERE a = 250",
        f"SELECT b FROM {t} WHERE a = 5 AND b IN (SELECT z.b FROM {t} z WHERE z.a = 5)",
        f"WITH c AS (SELECT * FROM {t} WHERE a = 5), {t}x AS (SELECT 1 AS k) SELECT c.b FROM c JOIN {t} ON c.a = {t}.a, {t}x WHERE {t}.a = 5",
    ):
        same(engine, text)
        assert len(used_by(engine)) == 2, text
    for text in (f"-- {t} first\nSELECT b FROM {t} WHERE a = 5", f"/* x */ SELECT '{t}' AS s, a FROM `{t}` WHERE a = 5", f"SELECT {t}.a FROM {t} WHERE {t}.a = 5"):
        same(engine, text)
        assert len(used_by(engine)) == 1, text
    same(engine, f"WITH {t} AS (SELECT 5 AS a) SELECT * FROM {t} WHERE a = 5", used=False)


def test_qualified_names_and_other_statements(engine, spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS qdb")
    spark.sql("DROP TABLE IF EXISTS qdb.t")
    numbers(spark).repartition(2).write.format("parquet").saveAsTable("qdb.t")
    engine.sql("CREATE OINDEX i ON qdb.t (a)")
    for text in ("SELECT b FROM qdb.t WHERE a = 5", "SELECT t.b FROM `qdb`.`t` WHERE t.a = 5", "SELECT b FROM spark_catalog.qdb.t AS x WHERE x.a = 5"):
        same(engine, text)
        assert len(used_by(engine)) == 1, text
    plan = engine.sql("EXPLAIN FORMATTED SELECT b FROM qdb.t WHERE a = 5").first()[0]
    assert "MapInArrow" in plan
    for text in ("CREATE TABLE qdb.made USING parquet AS SELECT a, b FROM qdb.t WHERE a = 5", "INSERT INTO qdb.made SELECT a, b FROM qdb.t WHERE a = 7"):
        spark.sql("DROP TABLE IF EXISTS qdb.made") if text.startswith("CREATE") else None
        engine.sql(text)
        assert len(used_by(engine)) == 1, text
    assert sorted(r["a"] for r in spark.table("qdb.made").collect()) == [5, 7]
    with pytest.raises(AnalysisException):
        engine.sql("SELECT no_such_column FROM qdb.t")
    spark.sql("DROP DATABASE qdb CASCADE")


def test_refresh_forgets_files_that_are_gone(engine, spark, tmp_path):
    path = f"{tmp_path}/gone"
    numbers(spark).repartition(3).write.parquet(path)
    engine.register("gone", path)
    engine.sql("CREATE OINDEX i ON gone (a)")
    lost = next(p for p in pathlib.Path(path).glob("part-*.parquet"))
    lost.unlink()
    engine.register("gone", path)
    assert [r[0] for r in engine.sql("CHECK OINDEX ON gone").collect()] == [f"Data file: {lost} not found!"]
    engine.sql("REFRESH OINDEX ON gone")
    assert engine.sql("CHECK OINDEX ON gone").count() == 0


def test_the_driver_holds_little_of_each_file(engine, spark, tmp_path):
    """Neither Bloom bits nor samples, and samples are bounded; a manifest of 10,000 files is a small list."""
    t = made(engine, tmp_path, spark.range(50_000).select(F.col("id").alias("a"), F.col("id").alias("b")).coalesce(1))
    engine.sql(f"CREATE OINDEX i ON {t} (a)")
    _, roots, _, index = engine._index(t, "i")
    held = engine._manifest(index)
    assert len(held) == 1 and not {"bloom", "sample"} & set(*held.values()) and len(pickle.dumps(held)) < 2000
    whole = spark.read.parquet(index.manifest)
    assert whole.select(F.size("sample")).first()[0] <= 1200
    index.manifest += "-many"
    whole.drop("file").crossJoin(spark.range(10_000).select(F.concat(F.lit("/x/"), F.col("id").cast("string")).alias("file"))).write.parquet(index.manifest)
    assert len(engine._manifest(index)) == 10_000 and len(pickle.dumps(engine._manifest(index))) < 10_000 * 700


def test_sessions_do_not_lose_each_others_indexes(engine, spark, tmp_path):
    t = made(engine, tmp_path, numbers(spark))
    other = Engine(spark, engine.catalog.root)
    engine.sql(f"CREATE OINDEX i ON {t} (a)")
    assert [r["key_name"] for r in other.sql(f"SHOW OINDEX FROM {t}").collect()] == ["i"]
    stale = other.catalog.load(engine._relation(t)[1])
    engine.sql(f"CREATE OINDEX j ON {t} (b)")
    stale.indexes.clear()
    with pytest.raises(ChangedElsewhere):
        other.catalog.save(stale)
    assert {r["key_name"] for r in other.sql(f"SHOW OINDEX FROM {t}").collect()} == {"i", "j"}

"""A query for each operator, over copies of the driver's tables in several files.

Queries are written once, in SQL that both Spark and DuckDB run; the names of indexed
copies begin with ``qx_``, which the oracle's text leaves out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import Engine
from ..sources import files
from ..sources.cache import PathGate
from .build import small_reads

_fixtures: dict[tuple, "Fixture"] = {}


class Fixture:
    """Copies of the tables, each range-partitioned into files, and an engine over them; made as asked for."""

    #: (source table, columns that order its files, number of files at least).
    TABLES = {
        "qx_lineitem": ("lineitem", ("l_orderkey",), 8),
        "qx_orders": ("orders", ("o_orderdate",), 8),
        "qx_part": ("part", ("p_partkey",), 4),
        "qx_customer": ("customer", ("c_custkey",), 4),
        "qx_events": ("events", ("ts",), 8),
        "qx_supplier": ("supplier", ("s_suppkey",), 2),
    }

    #: Bytes of the source that a file of a copy stands for at most: a task sorts and writes a file.
    FILE_BYTES = 8 << 20

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.folder = f"{files.workspace(spark)}/quern-{uuid.uuid4().hex}"
        self.engine = Engine(spark, f"{self.folder}/index")
        self.made: set[str] = set()
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)

    def source(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")

    def files(self, table: str, least: int) -> int:
        """How many files a copy of ``table`` has: ``least``, or more where they would grow too large."""
        size = int(self.source(table)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
        return max(least, -(-size // self.FILE_BYTES))

    def table(self, name: str) -> None:
        if name in self.made:
            return
        with small_reads(self.spark):  # a task deals out what it reads, and holds it meanwhile
            self._copy(name, f"{self.folder}/{name}")
        self.made.add(name)

    def _copy(self, name: str, path: str) -> None:
        if name in self.TABLES:
            source, order, n = self.TABLES[name]
            self.source(source).repartitionByRange(self.files(source, n), *order).sortWithinPartitions(*order).write.parquet(path)
            self.engine.register(name, path)
        elif name == "qx_orders_by_status":
            self.source("orders").repartitionByRange(self.files("orders", 3), "o_orderkey").write.partitionBy("o_orderstatus").parquet(path)
            self.engine.register(name, path)
        elif name == "qx_orders_orc":
            self.source("orders").repartitionByRange(self.files("orders", 6), "o_orderkey").write.orc(path)
            self.engine.register(name, path, "orc")
        elif name == "qx_lineitem_keys":
            # Eight files at any size, unsorted and of the key alone, as they grow with the table.
            self.source("lineitem").select("l_orderkey").repartitionByRange(8, "l_orderkey").write.parquet(path)
            self.engine.register(name, path)
        elif name == "qx_nulls":
            # Every 20th key is null.
            self.source("orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_custkey END AS custkey", "CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_orderpriority END AS priority").repartitionByRange(self.files("orders", 4), "o_orderkey").write.parquet(path)
            self.engine.register(name, path)
        elif name == "qx_nested":
            self.source("embeddings").repartitionByRange(self.files("embeddings", 4), "vec_id").write.parquet(path)
            self.engine.register(name, path)
        else:
            raise KeyError(name)

    def index(self, statement: str) -> None:
        if statement not in self.made:
            self.engine.sql(statement)
            self.made.add(statement)

    def with_settings(self, **settings):
        return _Settings(self.engine, settings)


class _Settings:
    """Settings for the time of planning a query; then as they were."""

    def __init__(self, engine: Engine, settings: dict):
        self.engine, self.settings = engine, {k.replace("__", "."): v for k, v in settings.items()}

    def __enter__(self):
        self.before = {k: self.engine.get(k) for k in self.settings}
        for k, v in self.settings.items():
            self.engine.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.engine.set(k, v)


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fixtures:
        _fixtures[key] = Fixture(spark, sf_dir)
    f = _fixtures[key]
    for name in f.made:
        if name.startswith("qx_"):  # another session, or another scale's fixture, may have taken the name
            f.engine.register(name, f"{f.folder}/{name}", "orc" if name.endswith("_orc") else "parquet")
    return f


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The index file policy compares index and data sizes; these copies are too small for it.
SMALL = {"index__file__policy": "false"}

IDX = {
    "orderkey": "CREATE OINDEX IF NOT EXISTS l_ok ON qx_lineitem (l_orderkey)",
    "part_supp": "CREATE OINDEX IF NOT EXISTS l_ps ON qx_lineitem (l_partkey, l_suppkey)",
    "quantity": "CREATE OINDEX IF NOT EXISTS l_qty ON qx_lineitem (l_quantity DESC)",
    "shipdate": "CREATE OINDEX IF NOT EXISTS l_sd ON qx_lineitem (l_shipdate)",
    "linenumber": "CREATE OINDEX IF NOT EXISTS l_ln ON qx_lineitem (l_linenumber) USING BITMAP",
    "returnflag": "CREATE SINDEX IF NOT EXISTS l_rf ON qx_lineitem (l_returnflag) USING BITMAP",
    "o_priority": "CREATE OINDEX IF NOT EXISTS o_pr ON qx_orders (o_orderpriority, o_orderkey)",
    "o_orderkey": "CREATE OINDEX IF NOT EXISTS o_ok ON qx_orders (o_orderkey)",
    "o_custkey": "CREATE OINDEX IF NOT EXISTS o_ck ON qx_orders (o_custkey)",
    "p_size": "CREATE OINDEX IF NOT EXISTS p_sz ON qx_part (p_size) USING BITMAP",
    "p_type": "CREATE OINDEX IF NOT EXISTS p_ty ON qx_part (p_type)",
    "c_name": "CREATE OINDEX IF NOT EXISTS c_nm ON qx_customer (c_name)",
    "e_user": "CREATE OINDEX IF NOT EXISTS e_us ON qx_events (user_id)",
    "n_cust": "CREATE OINDEX IF NOT EXISTS n_ck ON qx_nulls (custkey)",
    "n_prio": "CREATE OINDEX IF NOT EXISTS n_pr ON qx_nulls (priority) USING BITMAP",
    "n_both": "CREATE OINDEX IF NOT EXISTS n_cp ON qx_nulls (priority, custkey)",
    "orc": "CREATE OINDEX IF NOT EXISTS r_ok ON qx_orders_orc (o_orderkey)",
    "nested": "CREATE OINDEX IF NOT EXISTS v_lb ON qx_nested (vec_id)",
}


def _tables_of(text: str) -> list[str]:
    return [t for t in (*Fixture.TABLES, "qx_orders_by_status", "qx_orders_orc", "qx_nulls", "qx_nested") if f"{t} " in f"{text} ".replace(")", " ").replace("\n", " ").replace(",", " ").replace(".", " ")]


def indexed(name: str, text: str, *indexes: str, oracle: str | None = None, **settings) -> None:
    """A query through the engine's SQL; the same text is its oracle."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = fixture(spark, sf_dir)
        for t in dict.fromkeys([*_tables_of(text), *(t for i in indexes for t in _tables_of(IDX[i]))]):
            f.table(t)
        for i in indexes:
            f.index(IDX[i])
        with f.with_settings(**SMALL | settings):
            return f.engine.sql(text)

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or text.replace("qx_nulls", _NULLS).replace("qx_orders_by_status", "orders").replace("qx_orders_orc", "orders").replace("qx_nested", "embeddings").replace("qx_", "")


_NULLS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_custkey END AS custkey, CASE WHEN o_orderkey % 20 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders) AS n"
_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag"

# Predicates on B-trees
indexed("btree_eq", f"SELECT {_LINE} FROM qx_lineitem WHERE l_orderkey = 7", "orderkey")
indexed("btree_eq_literal_left", f"SELECT {_LINE} FROM qx_lineitem WHERE 7 = l_orderkey", "orderkey")
indexed("btree_in", f"SELECT {_LINE} FROM qx_lineitem WHERE l_orderkey IN (1, 2, 3, 39, 1000000)", "orderkey")
indexed("btree_in_set", f"SELECT {_LINE} FROM qx_lineitem WHERE l_orderkey IN ({', '.join(str(7 * i) for i in range(1, 31))})", "orderkey")
indexed("btree_range", f"SELECT {_LINE} FROM qx_lineitem WHERE l_orderkey > 100 AND l_orderkey <= 130", "orderkey")
indexed("btree_open_range", f"SELECT {_LINE} FROM qx_lineitem WHERE l_orderkey < 20", "orderkey")
indexed("btree_between", f"SELECT {_LINE} FROM qx_lineitem WHERE l_partkey BETWEEN 10 AND 12", "part_supp")
indexed("btree_or_same_col", f"SELECT {_LINE} FROM qx_lineitem WHERE l_orderkey = 5 OR l_orderkey BETWEEN 8 AND 12 OR l_orderkey < 3", "orderkey")
indexed("btree_desc", f"SELECT {_LINE} FROM qx_lineitem WHERE l_quantity >= 50", "quantity")
indexed("btree_composite", f"SELECT {_LINE} FROM qx_lineitem WHERE l_partkey = 15 AND l_suppkey < 60", "part_supp")
indexed("btree_composite_in", f"SELECT {_LINE} FROM qx_lineitem WHERE l_partkey = 15 AND l_suppkey IN (90, 3, 41, 7)", "part_supp")
indexed("btree_prefix", "SELECT c_custkey, c_name, c_mktsegment FROM qx_customer WHERE c_name LIKE 'Customer#00000001%' AND c_name > 'A'", "c_name")
indexed("btree_prefix_and_range", "SELECT o_orderkey, o_orderpriority FROM qx_orders WHERE o_orderpriority LIKE '1-%' AND o_orderpriority >= '1-U' AND o_orderkey < 400", "o_priority")
indexed("btree_prefix_or_range", "SELECT o_orderkey, o_orderpriority FROM qx_orders WHERE (o_orderpriority BETWEEN '1' AND '2' OR o_orderpriority LIKE '2-H%') AND o_orderkey < 400", "o_priority")
indexed("btree_timestamp_range", f"SELECT {_LINE} FROM qx_lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-03-03 00:00:00'", "shipdate")
indexed("btree_is_null", "SELECT o_orderkey, priority FROM qx_nulls WHERE custkey IS NULL", "n_cust")
indexed("btree_is_not_null", "SELECT o_orderkey, custkey FROM qx_nulls WHERE custkey IS NOT NULL AND custkey < 40", "n_cust")
indexed("btree_null_or_point", "SELECT o_orderkey, custkey FROM qx_nulls WHERE custkey IS NULL OR custkey = 22", "n_cust")
indexed("btree_null_and_point", "SELECT o_orderkey, custkey FROM qx_nulls WHERE custkey IS NULL AND custkey = 22 OR custkey = 28", "n_cust")
indexed("btree_composite_nulls", "SELECT o_orderkey, custkey FROM qx_nulls WHERE priority = '1-URGENT' AND custkey < 50", "n_both")
indexed("btree_full_key_string", "SELECT p_partkey, p_type, p_size FROM qx_part WHERE p_type LIKE 'ECONOMY%' AND p_type < 'ECONOMY C'", "p_type")
indexed("btree_full_scan_by_cost", "SELECT l_returnflag, count(*) AS n FROM qx_lineitem WHERE l_orderkey > 10 GROUP BY l_returnflag", "orderkey")
indexed("index_size_policy", f"SELECT {_LINE} FROM qx_lineitem WHERE l_orderkey = 9", "orderkey", index__file__policy="true", index__size__ratio="0.000001")

# Bitmaps, and several indexes at once
indexed("bitmap_eq", f"SELECT {_LINE} FROM qx_lineitem WHERE l_linenumber = 7", "linenumber")
indexed("bitmap_in", "SELECT p_partkey, p_size, p_brand FROM qx_part WHERE p_size IN (3, 17, 49)", "p_size")
indexed("bitmap_point_or_range", f"SELECT {_LINE} FROM qx_lineitem WHERE l_linenumber = 2 OR l_linenumber > 6", "linenumber")
indexed("bitmap_string", "SELECT l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM qx_lineitem WHERE l_returnflag = 'R' GROUP BY l_linestatus", "returnflag", index__statistics__policy="false")
indexed("bitmap_null", "SELECT o_orderkey, priority FROM qx_nulls WHERE priority IS NULL", "n_prio")
indexed("multi_index", f"SELECT {_LINE} FROM qx_lineitem WHERE l_partkey = 15 AND l_linenumber = 2", "part_supp", "linenumber", index__max__use="2")
indexed("multi_index_btrees", "SELECT o_orderkey, o_custkey, o_orderpriority FROM qx_orders WHERE o_custkey < 60 AND o_orderkey > 10 AND o_orderkey < 900", "o_custkey", "o_orderkey", index__max__use="2", index__statistics__policy="false")
indexed("index_choice", f"SELECT {_LINE} FROM qx_lineitem WHERE l_orderkey = 7 AND l_quantity > 1 AND l_partkey > 0", "part_supp", "quantity", "orderkey")

# What no index can do is left to Spark's filter
indexed("residual_cross_column_or", f"SELECT {_LINE} FROM qx_lineitem WHERE (l_orderkey = 7 OR l_partkey = 15) AND l_orderkey < 2000", "orderkey")
indexed("residual_not", f"SELECT {_LINE} FROM qx_lineitem WHERE NOT (l_linenumber = 1) AND l_orderkey IN (1, 2, 7)", "orderkey")
indexed("residual_suffix", "SELECT p_partkey, p_type FROM qx_part WHERE p_type LIKE '%LL' AND p_type LIKE 'SM%' AND p_type > 'S'", "p_type")
indexed("residual_expression", f"SELECT {_LINE} FROM qx_lineitem WHERE l_orderkey + 1 = 8 AND l_orderkey < 100", "orderkey")
indexed("residual_in_cast", f"SELECT {_LINE} FROM qx_lineitem WHERE l_orderkey IN (CAST('7' AS BIGINT), CAST('8' AS BIGINT))", "orderkey")

# Relational operators over indexed scans
indexed("join_indexed", "SELECT o.o_orderpriority AS priority, sum(l.l_quantity) AS qty, count(*) AS n FROM qx_lineitem l JOIN qx_orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_orderkey < 300 AND o.o_orderkey < 300 GROUP BY o.o_orderpriority", "orderkey", "o_orderkey")
indexed("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM qx_customer LEFT JOIN qx_orders ON c_custkey = o_custkey GROUP BY c_custkey", "o_custkey")
indexed("join_semi", "SELECT c_custkey, c_name FROM qx_customer WHERE EXISTS (SELECT 1 FROM qx_orders WHERE o_custkey = c_custkey AND o_orderkey < 200)", "o_orderkey")
indexed("join_anti", "SELECT c_custkey FROM qx_customer WHERE NOT EXISTS (SELECT 1 FROM qx_orders WHERE o_custkey = c_custkey AND o_custkey > 20)", "o_custkey")
indexed("join_self", "SELECT a.l_orderkey, count(*) AS n FROM qx_lineitem a JOIN qx_lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_orderkey < 50 AND b.l_linenumber = 1 GROUP BY a.l_orderkey", "orderkey")
indexed("union_indexed", f"SELECT {_LINE} FROM qx_lineitem WHERE l_orderkey = 7 UNION ALL SELECT {_LINE} FROM qx_lineitem WHERE l_orderkey = 39", "orderkey")
indexed("commented", f"-- qx_lineitem\nSELECT {_LINE} FROM qx_lineitem WHERE l_orderkey = 7", "orderkey")
indexed("join_range", "SELECT p_size, count(*) AS n FROM qx_part JOIN qx_supplier ON s_acctbal BETWEEN p_size * 100 AND p_size * 100 + 500 WHERE p_size IN (1, 5, 9) GROUP BY p_size", "p_size")
indexed("agg_indexed", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, avg(l_extendedprice) AS price, count(DISTINCT l_suppkey) AS suppliers FROM qx_lineitem WHERE l_orderkey BETWEEN 1 AND 500 GROUP BY l_returnflag, l_linestatus", "orderkey")
indexed("distinct", "SELECT DISTINCT l_suppkey, l_linenumber FROM qx_lineitem WHERE l_partkey BETWEEN 5 AND 9", "part_supp")
indexed("having", "SELECT l_partkey, sum(l_quantity) AS qty FROM qx_lineitem WHERE l_partkey < 30 GROUP BY l_partkey HAVING count(*) > 20", "part_supp")
indexed("cube", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM qx_lineitem WHERE l_orderkey < 1000 GROUP BY CUBE (l_returnflag, l_linestatus)", "orderkey")
indexed("rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM qx_lineitem WHERE l_orderkey < 1000 GROUP BY ROLLUP (l_returnflag, l_linestatus)", "orderkey")
indexed("grouping_sets", "SELECT l_linenumber, l_returnflag, count(*) AS n FROM qx_lineitem WHERE l_orderkey < 1000 GROUP BY GROUPING SETS ((l_linenumber), (l_returnflag), ())", "orderkey")
indexed("window_rank", "SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS rk, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM qx_lineitem WHERE l_orderkey IN (1, 2, 3, 4, 5, 6, 7)", "orderkey")
indexed("sort_limit", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM qx_lineitem WHERE l_orderkey < 400 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10", "orderkey")
indexed("union_all", "SELECT l_orderkey AS k FROM qx_lineitem WHERE l_orderkey < 20 UNION ALL SELECT o_orderkey AS k FROM qx_orders WHERE o_orderkey < 20", "orderkey", "o_orderkey")
indexed("intersect", "SELECT l_orderkey AS k FROM qx_lineitem WHERE l_orderkey < 500 INTERSECT SELECT o_orderkey AS k FROM qx_orders WHERE o_orderkey < 400", "orderkey", "o_orderkey")
indexed("except", "SELECT o_orderkey AS k FROM qx_orders WHERE o_orderkey < 500 EXCEPT SELECT l_orderkey AS k FROM qx_lineitem WHERE l_orderkey < 300", "orderkey", "o_orderkey")
indexed("scalar_functions", "SELECT o_orderkey, upper(substring(o_orderpriority, 3)) AS word, year(o_orderdate) AS y, round(o_totalprice / 7, 2) AS r, abs(o_custkey - 100) AS d, coalesce(nullif(o_orderstatus, 'O'), '-') AS s FROM qx_orders WHERE o_orderkey BETWEEN 1 AND 300", "o_orderkey")
indexed("subquery", "SELECT o_orderkey, o_totalprice FROM qx_orders WHERE o_orderkey < 300 AND o_totalprice > (SELECT avg(o_totalprice) FROM orders_all)".replace("orders_all", "qx_orders_orc"), "o_orderkey")
indexed("cte", "WITH big AS (SELECT l_orderkey, sum(l_quantity) AS qty FROM qx_lineitem WHERE l_orderkey < 300 GROUP BY l_orderkey) SELECT o_orderstatus, count(*) AS n, sum(qty) AS qty FROM big JOIN qx_orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus", "orderkey")
indexed("events_by_user", "SELECT event_type, count(*) AS n, max(value) AS top FROM qx_events WHERE user_id IN (3, 5, 8, 13) GROUP BY event_type", "e_user")
indexed("date_functions", "SELECT year(l_shipdate) AS y, month(l_shipdate) AS m, count(*) AS n FROM qx_lineitem WHERE l_orderkey < 700 GROUP BY year(l_shipdate), month(l_shipdate)", "orderkey")
indexed("nested_columns", "SELECT vec_id, label, embedding[{at}] AS first FROM qx_nested WHERE vec_id BETWEEN 10 AND 40".replace("{at}", "0"), "nested", oracle="SELECT vec_id, label, embedding[1] AS first FROM embeddings WHERE vec_id BETWEEN 10 AND 40")

# ORC and partitions
indexed("orc_scan", "SELECT o_orderstatus, count(*) AS n, sum(o_totalprice) AS total FROM qx_orders_orc GROUP BY o_orderstatus")
indexed("orc_indexed", "SELECT o_orderkey, o_custkey, o_orderpriority FROM qx_orders_orc WHERE o_orderkey BETWEEN 40 AND 60", "orc")
indexed("orc_count_without_columns", "SELECT count(*) AS n FROM qx_orders_orc", "orc")
indexed("parquet_count_without_columns", "SELECT count(*) AS n FROM qx_lineitem", "orderkey")
indexed("partition_pruning", "SELECT o_orderstatus, count(*) AS n FROM qx_orders_by_status WHERE o_orderstatus IN ('F', 'P') GROUP BY o_orderstatus")


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def _prepared(spark, sf_dir, tables, indexes=()) -> Fixture:
    f = fixture(spark, sf_dir)
    for t in tables:
        f.table(t)
    for i in indexes:
        f.index(IDX.get(i, i))
    return f


def _eight_files(spark, sf_dir) -> Fixture:
    """For queries whose result counts files: ``qx_lineitem`` is eight files, of the key alone, until the next query asks for its fixture."""
    f = _prepared(spark, sf_dir, ["qx_lineitem_keys"])
    f.engine.register("qx_lineitem", f"{f.folder}/qx_lineitem_keys")
    f.engine.sql(IDX["orderkey"])
    return f


@query("dataframe_api", f"SELECT {_LINE} FROM lineitem WHERE l_orderkey = 7 AND l_quantity > 5")
def _dataframe_api(spark, sf_dir):
    f = _prepared(spark, sf_dir, ["qx_lineitem"], ["orderkey"])
    with f.with_settings(**SMALL):
        return f.engine.table("qx_lineitem").where(F.col("l_orderkey") == 7).where("l_quantity > 5").select(*_LINE.split(", ")).df()


@query("row_reads_off", f"SELECT {_LINE} FROM lineitem WHERE l_orderkey IN (7, 8)")
def _row_reads_off(spark, sf_dir):
    """As in a store whose files only Spark opens: whole files that hold a key, then the filter."""
    f = _prepared(spark, sf_dir, ["qx_lineitem"], ["orderkey"])
    with f.with_settings(**SMALL, row__reads="false"):
        return f.engine.sql(f"SELECT {_LINE} FROM qx_lineitem WHERE l_orderkey IN (7, 8)")


@query("partition_spec", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 100")
def _partition_spec(spark, sf_dir):
    """An index on one partition: files of the others are read whole."""
    f = _prepared(spark, sf_dir, ["qx_orders_by_status"], ["CREATE OINDEX IF NOT EXISTS ps ON qx_orders_by_status (o_orderkey) PARTITION (o_orderstatus='F')"])
    with f.with_settings(**SMALL):
        return f.engine.sql("SELECT o_orderkey, o_orderstatus FROM qx_orders_by_status WHERE o_orderkey < 100")


def _appended(spark, sf_dir, name: str, refresh: bool) -> DataFrame:
    f = fixture(spark, sf_dir)
    path = f"{f.folder}/{name}"
    if name not in f.made:
        source = f.source("orders").select("o_orderkey", "o_custkey")
        with small_reads(spark):
            source.where("o_orderkey % 2 = 0").repartitionByRange(f.files("orders", 3), "o_orderkey").write.parquet(path)
        f.engine.register(name, path)
        f.engine.sql(f"CREATE OINDEX a_{name} ON {name} (o_custkey)")
        with small_reads(spark):
            source.where("o_orderkey % 2 = 1").repartitionByRange(f.files("orders", 2), "o_orderkey").write.mode("append").parquet(path)
        f.made.add(name)
        f.engine.register(name, path)
        if refresh:
            f.engine.sql(f"REFRESH OINDEX ON {name}")
            f.engine.sql(f"REFRESH OINDEX ON {name}")  # a second one finds nothing to do
    with f.with_settings(**SMALL):
        return f.engine.sql(f"SELECT o_orderkey, o_custkey FROM {name} WHERE o_custkey BETWEEN 20 AND 25")


@query("append_without_refresh", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 20 AND 25")
def _append(spark, sf_dir):
    return _appended(spark, sf_dir, "qx_appended", False)


@query("append_refresh", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey BETWEEN 20 AND 25")
def _append_refresh(spark, sf_dir):
    return _appended(spark, sf_dir, "qx_refreshed", True)


def _ddl_table(spark, sf_dir, name: str) -> Fixture:
    f = fixture(spark, sf_dir)
    if name not in f.made:
        f.source("nation").repartitionByRange(2, "n_nationkey").write.parquet(f"{f.folder}/{name}")
        f.made.add(name)
    f.engine.register(name, f"{f.folder}/{name}")
    for i in ("d1", "d2", "d3"):
        f.engine.sql(f"DROP OINDEX IF EXISTS {i} ON {name}")
    f.engine.sql(f"CREATE OINDEX d1 ON {name} (n_regionkey, n_name DESC)")
    f.engine.sql(f"CREATE SINDEX d2 ON {name} (n_regionkey) USING BITMAP")
    return f


@query("show_index", """SELECT * FROM (VALUES ('qx_nation', 'd1', 0, 'n_regionkey', 'A', 'BTREE', true), ('qx_nation', 'd1', 1, 'n_name', 'D', 'BTREE', true),
  ('qx_nation', 'd2', 0, 'n_regionkey', 'A', 'BITMAP', true)) AS t("table", key_name, seq_in_index, column_name, "collation", index_type, enabled)""")
def _show(spark, sf_dir):
    return _ddl_table(spark, sf_dir, "qx_nation").engine.sql("SHOW OINDEX FROM qx_nation")


@query("drop_index", """SELECT * FROM (VALUES ('qx_nation', 'd2', 0, 'n_regionkey', 'A', 'BITMAP', true)) AS t("table", key_name, seq_in_index, column_name, "collation", index_type, enabled)""")
def _drop(spark, sf_dir):
    f = _ddl_table(spark, sf_dir, "qx_nation")
    f.engine.sql("DROP OINDEX d1 ON qx_nation")
    return f.engine.sql("SHOW OINDEX IN qx_nation")


@query("disable_index", "SELECT * FROM (VALUES ('d1', false), ('d2', true)) AS t(key_name, enabled)")
def _disable(spark, sf_dir):
    f = _ddl_table(spark, sf_dir, "qx_nation")
    f.engine.sql("DISABLE OINDEX d1")
    f.engine.sql("DISABLE OINDEX d1")
    shown = f.engine.sql("SHOW OINDEX FROM qx_nation").select("key_name", "enabled").distinct()
    f.engine.sql("ENABLE OINDEX d1")
    return shown


@query("enable_index", "SELECT * FROM (VALUES ('d1', true), ('d2', false)) AS t(key_name, enabled)")
def _enable(spark, sf_dir):
    f = _ddl_table(spark, sf_dir, "qx_nation")
    f.engine.sql("DISABLE OINDEX d1")
    f.engine.sql("DISABLE OINDEX d2")
    f.engine.sql("ENABLE OINDEX d1")
    shown = f.engine.sql("SHOW OINDEX FROM qx_nation").select("key_name", "enabled").distinct()
    f.engine.sql("ENABLE OINDEX d2")
    return shown


@query("check_index_missing", "SELECT CAST(2 AS BIGINT) AS messages, true AS as_expected")
def _check_missing(spark, sf_dir):
    """The files of one of two indexes are gone: a message for each of the two data files."""
    f = _ddl_table(spark, sf_dir, "qx_nation_lost")
    _, roots, _, index = f.engine._index("qx_nation_lost", "d1")
    for g in index.generations:
        files.delete(spark, f"{f.engine.catalog.folder(roots, 'd1')}/data-{g}")
    said = f.engine.sql("CHECK OINDEX ON qx_nation_lost")
    return said.agg(F.count("*").alias("messages"), F.min(F.col("Analysis Result").startswith("Missing index:d1,\nindexColumn(s): n_regionkey,n_name, indexType: BTree\nfor Data File: ")).alias("as_expected"))


@query("refresh_vanished", "SELECT CAST(1 AS BIGINT) AS before, CAST(0 AS BIGINT) AS after")
def _refresh_vanished(spark, sf_dir):
    """A data file that is gone is missed until REFRESH forgets it."""
    f = fixture(spark, sf_dir)
    path = f"{f.folder}/qx_vanishing-{uuid.uuid4().hex[:8]}"
    parts = f.source("nation").repartitionByRange(2, "n_nationkey")
    parts.withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(path)
    f.engine.register("qx_vanishing", path)
    f.engine.sql("CREATE OINDEX v ON qx_vanishing (n_nationkey)")
    files.delete(spark, f"{path}/part=1")
    f.engine.register("qx_vanishing", path)
    before = f.engine.sql("CHECK OINDEX ON qx_vanishing").count()
    f.engine.sql("REFRESH OINDEX ON qx_vanishing")
    return f.engine.sql("CHECK OINDEX ON qx_vanishing").agg(F.lit(before).cast("long").alias("before"), F.count("*").alias("after"))


@query("scan_report_self_join", "SELECT 'SKIP' AS decision, 14 AS files UNION ALL SELECT 'USE_INDEX', 2")
def _scan_report_self_join(spark, sf_dir):
    """Each of the two places that name the table is decided by itself."""
    f = _eight_files(spark, sf_dir)
    with f.with_settings(**SMALL):
        f.engine.sql("SELECT a.l_orderkey FROM qx_lineitem a JOIN qx_lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_orderkey = 7 AND b.l_orderkey = 7")
        return f.engine.last_scan_report().groupBy("decision").agg(F.count("*").cast("int").alias("files"))


@query("check_index_clean", "SELECT 'x' AS \"Analysis Result\" WHERE false")
def _check_clean(spark, sf_dir):
    return _ddl_table(spark, sf_dir, "qx_nation").engine.sql("CHECK OINDEX ON qx_nation")


@query("check_index_without_index", "SELECT 1 AS messages, true AS as_expected")
def _check_without(spark, sf_dir):
    f = _prepared(spark, sf_dir, ["qx_supplier"])
    said = f.engine.sql("CHECK OINDEX ON qx_supplier")
    return said.agg(F.count("*").cast("int").alias("messages"), F.min(F.col("Analysis Result").startswith("Meta file not found in partition: ")).alias("as_expected"))


@query("scan_report", "SELECT 'SKIP' AS decision, 7 AS files UNION ALL SELECT 'USE_INDEX', 1")
def _scan_report(spark, sf_dir):
    """A key lies in one of eight files that its order cuts apart: seven are skipped by MINMAX."""
    f = _eight_files(spark, sf_dir)
    with f.with_settings(**SMALL):
        f.engine.sql("SELECT l_orderkey FROM qx_lineitem WHERE l_orderkey = 7")
        return f.engine.last_scan_report().groupBy("decision").agg(F.count("*").cast("int").alias("files"))


def _manifest(f: Fixture, table: str, index: str) -> DataFrame:
    _, roots, _, found = f.engine._index(table, index)
    return f.spark.read.parquet(found.manifest)


@query("stats_minmax", "SELECT min(l_orderkey) AS low, max(l_orderkey) AS high, CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS nulls FROM lineitem")
def _stats_minmax(spark, sf_dir):
    m = _manifest(_prepared(spark, sf_dir, ["qx_lineitem"], ["orderkey"]), "qx_lineitem", "l_ok")
    return m.agg(F.min("min0").alias("low"), F.max("max0").alias("high"), F.sum("rows").alias("n"), F.sum("nulls0").alias("nulls"))


@query("stats_cutpoints", """WITH keys AS (SELECT p_partkey AS k, count(*) AS n FROM part GROUP BY 1),
  c AS (SELECT k, row_number() OVER (ORDER BY k) AS nth, sum(n) OVER (ORDER BY k) AS upto, count(*) OVER () AS cnt FROM keys)
  SELECT k AS key, CAST(upto AS BIGINT) AS rows FROM c WHERE (nth - 1) % CAST(ceil(cnt / 5.0) AS BIGINT) = 0 OR nth = cnt""")
def _stats_cutpoints(spark, sf_dir):
    """Cut points of the distinct keys of a table in one file."""
    f = fixture(spark, sf_dir)
    if "qx_part_one" not in f.made:
        f.source("part").coalesce(1).write.parquet(f"{f.folder}/qx_part_one")
        f.made.add("qx_part_one")
    f.engine.register("qx_part_one", f"{f.folder}/qx_part_one")
    f.index("CREATE OINDEX IF NOT EXISTS one ON qx_part_one (p_partkey)")
    return _manifest(f, "qx_part_one", "one").select(F.explode("cuts").alias("c")).select("c.key", "c.rows")


def bloom_missing(entries: DataFrame, manifest: DataFrame, options) -> DataFrame:
    """``(missing)``: how many keys of files in ``entries(file, k0)`` have a bit that isn't set in their file's Bloom filter."""
    from . import statistics

    places = F.array(*[statistics._bloom_place([F.lit(1), F.col("k0")], s, options.bloom_bits) for s in range(options.bloom_hashes)])
    asked = entries.select("file", "k0", F.explode(places).alias("place"))
    asked = asked.select("file", "k0", F.expr("(place - 1) div 32768 + 1").alias("bucket"), F.expr("cast((place - 1) % 32768 as int)").alias("bit"))
    held = manifest.select("file", F.explode("bloom").alias("b")).select("file", "b.bucket", "b.bitmap")
    byte = "cast(conv(hex(substring(bitmap, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)"
    found = asked.join(held, ["file", "bucket"], "left").withColumn("set", F.expr(f"coalesce(shiftright({byte}, bit % 8) & 1, 0)"))
    return found.groupBy("file", "k0").agg(F.min("set").alias("set")).agg(F.coalesce(F.sum(1 - F.col("set")), F.lit(0)).cast("long").alias("missing"))


@query("stats_bloom", "SELECT count(DISTINCT p_type) AS keys, CAST(0 AS BIGINT) AS missing FROM part")
def _stats_bloom(spark, sf_dir):
    """All keys of the table are asked for, and none misses from the Bloom filter of a file that holds it."""
    f = _prepared(spark, sf_dir, ["qx_part"], ["p_type"])
    _, roots, _, index = f.engine._index("qx_part", "p_ty")
    entries = f.engine.entries(roots, index)
    missing = bloom_missing(entries, _manifest(f, "qx_part", "p_ty"), f.engine._options())
    return entries.agg(F.count_distinct("k0").alias("keys")).crossJoin(missing)  # one row each


@query("stats_sample", """SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS strange, true AS within FROM lineitem""")
def _stats_sample(spark, sf_dir):
    """Samples hold keys of their file only: about a twentieth of the rows, 24 where there are so many, and a thousand at most."""
    m = _manifest(_prepared(spark, sf_dir, ["qx_lineitem"], ["orderkey"]), "qx_lineitem", "l_ok")
    wanted = F.least(F.greatest(F.col("rows") * 0.05, F.least(F.col("rows"), F.lit(24))), F.lit(1000))
    strange = F.size(F.filter("sample", lambda x: ~x["k0"].between(F.col("min0"), F.col("max0"))))
    return m.agg(F.sum("rows").alias("n"), F.sum(strange).cast("long").alias("strange"), F.min(F.abs(F.size("sample") - wanted) < F.greatest(F.lit(24), wanted)).alias("within"))


@query("metrics", "SELECT 8 AS total_files, 7 AS skip_files, 1 AS hit_files, CAST(count(*) AS BIGINT) AS n FROM lineitem")
def _metrics(spark, sf_dir):
    """What one query adds: all rows lie in files that were skipped or used by index."""
    f = _eight_files(spark, sf_dir)
    before = f.engine.metrics.copy()
    with f.with_settings(**SMALL):
        f.engine.sql("SELECT l_orderkey FROM qx_lineitem WHERE l_orderkey = 7")
    m = f.engine.metrics - before
    return spark.createDataFrame([(m["total_files"], m["skip_files"], m["hit_files"], m["skip_rows"] + m["hit_rows"])], "total_files int, skip_files int, hit_files int, n long")


@query("file_topk", """SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) AS nth FROM orders) WHERE nth <= 5""")
def _file_topk(spark, sf_dir):
    """The first five keys of each file, where files hold keys of one remainder."""
    f = fixture(spark, sf_dir)
    if "qx_mod" not in f.made:
        f.source("orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 4).alias("m")).repartition(1).write.partitionBy("m").parquet(f"{f.folder}/qx_mod")
        f.made.add("qx_mod")
    f.engine.register("qx_mod", f"{f.folder}/qx_mod")
    f.index("CREATE OINDEX IF NOT EXISTS md ON qx_mod (o_orderkey)")
    return f.engine.file_top("qx_mod", "md", 5).select("o_orderkey", "o_custkey")


@query("key_limit", "SELECT o_orderstatus, CAST(least(count(*), 3) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
def _key_limit(spark, sf_dir):
    """At most three rows of each key, from a table in one file."""
    f = fixture(spark, sf_dir)
    if "qx_orders_one" not in f.made:
        f.source("orders").coalesce(1).write.parquet(f"{f.folder}/qx_orders_one")
        f.made.add("qx_orders_one")
    f.engine.register("qx_orders_one", f"{f.folder}/qx_orders_one")
    f.index("CREATE OINDEX IF NOT EXISTS kl ON qx_orders_one (o_orderstatus) USING BITMAP")
    return f.engine.key_limit("qx_orders_one", "kl", 3).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def _cached(spark, sf_dir, **settings) -> DataFrame:
    f = _prepared(spark, sf_dir, ["qx_customer"])
    text = "SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) AS total FROM qx_customer WHERE c_custkey > 10 GROUP BY c_mktsegment"
    with f.with_settings(**settings):
        return f.engine.sql(text)


_CUSTOMER_SQL = "SELECT c_mktsegment, count(*) AS n, sum(c_acctbal) AS total FROM customer WHERE c_custkey > 10 GROUP BY c_mktsegment"
query("cache_data", _CUSTOMER_SQL)(lambda spark, sf_dir: _cached(spark, sf_dir, parquet__data__cache="true"))
query("cache_binary", _CUSTOMER_SQL)(lambda spark, sf_dir: _cached(spark, sf_dir, parquet__binary__cache="true"))
query("cache_hot_tables", _CUSTOMER_SQL)(lambda spark, sf_dir: _cached(spark, sf_dir, parquet__data__cache="true", cache__table__list__enabled="true", cache__table__list="default.qx_customer;default.other"))
query("cache_off", _CUSTOMER_SQL)(lambda spark, sf_dir: _cached(spark, sf_dir, cache__enabled="false"))


@query("cache_stats", "SELECT CAST(count(*) AS BIGINT) AS n, true AS kept FROM customer WHERE c_custkey > 10")
def _cache_stats(spark, sf_dir):
    """The query reads from the cache, all of whose partitions are kept."""
    f = _prepared(spark, sf_dir, ["qx_customer"])
    with f.with_settings(parquet__data__cache="true"):
        df = f.engine.sql("SELECT c_custkey FROM qx_customer WHERE c_custkey > 10")
    read = "InMemoryTableScan" in df._jdf.queryExecution().executedPlan().toString()
    n = df.count()
    kept = f.engine.cache_stats().agg(((F.max("cached_partitions") > 0) & F.lit(read)).alias("kept"))
    return kept.select(F.lit(n).cast("long").alias("n"), "kept")


@query("cache_orc", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey > 10 GROUP BY o_orderpriority")
def _cache_orc(spark, sf_dir):
    f = _prepared(spark, sf_dir, ["qx_orders_orc"])
    with f.with_settings(orc__data__cache="true"):
        return f.engine.sql("SELECT o_orderpriority, count(*) AS n FROM qx_orders_orc WHERE o_orderkey > 10 GROUP BY o_orderpriority")


@query("cache_paths", "SELECT true AS allowed, false AS denied, 1 AS hits, 1 AS misses, count(*) AS n FROM region")
def _cache_paths(spark, sf_dir):
    f = fixture(spark, sf_dir)
    gate = PathGate(allow=r"region", deny=r"nation")
    path = f"{sf_dir}/region.parquet"
    for _ in range(2):
        df = gate.cache_paths(f.engine.cache, spark, "parquet", [path])
    allowed, denied = gate.allows(path), gate.allows(f"{sf_dir}/nation.parquet")
    n = df.agg(F.count("*").alias("n"))
    return n.select(F.lit(allowed).alias("allowed"), F.lit(denied).alias("denied"), F.lit(gate.hits).alias("hits"), F.lit(gate.misses).alias("misses"), "n")


@query("bucketed_join", "SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def _bucketed(spark, sf_dir):
    """Both sides bucketed by the join key: the join itself has no shuffle."""
    f = fixture(spark, sf_dir)
    tag = f.folder.rsplit("-", 1)[1][:8]
    for t, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        name = f"qb_{t}_{tag}"
        if name not in f.made:
            f.source(t).write.mode("overwrite").option("path", f"{f.folder}/{name}").bucketBy(8, key).sortBy(key).saveAsTable(name)
            f.made.add(name)
    return spark.sql(f"SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS qty FROM qb_lineitem_{tag} JOIN qb_orders_{tag} ON l_orderkey = o_orderkey GROUP BY o_orderpriority")


@query("dynamic_partition_pruning", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN (SELECT CASE WHEN r_regionkey = 1 THEN 'P' ELSE 'X' END FROM region WHERE r_regionkey = 1)")
def _dpp(spark, sf_dir):
    f = _prepared(spark, sf_dir, ["qx_orders_by_status"])
    f.source("region").createOrReplaceTempView("qx_region_all")
    return f.engine.sql("SELECT o.o_orderkey, o.o_orderstatus FROM qx_orders_by_status o JOIN (SELECT CASE WHEN r_regionkey = 1 THEN 'P' ELSE 'X' END AS s FROM qx_region_all WHERE r_regionkey = 1) r ON o.o_orderstatus = r.s")


@query("pandas_udf", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_orderkey < 50")
def _udf(spark, sf_dir):
    f = _prepared(spark, sf_dir, ["qx_lineitem"], ["orderkey"])

    @F.pandas_udf("double")
    def net(price, discount):
        return price * (1 - discount)

    with f.with_settings(**SMALL):
        return f.engine.sql("SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount FROM qx_lineitem WHERE l_orderkey < 50").select("l_orderkey", "l_linenumber", net("l_extendedprice", "l_discount").alias("net"))


@query("as_of_join", """SELECT e.event_id, max(p.event_id) AS purchase FROM (SELECT * FROM events WHERE user_id < 20) e
  LEFT JOIN (SELECT * FROM events WHERE user_id < 20 AND event_type = 'purchase') p ON p.user_id = e.user_id AND p.ts <= e.ts
    AND NOT EXISTS (SELECT 1 FROM events q WHERE q.user_id = e.user_id AND q.event_type = 'purchase' AND q.ts <= e.ts AND (q.ts > p.ts))
  GROUP BY e.event_id""")
def _as_of(spark, sf_dir):
    """The last purchase at or before each event, by one window over both."""
    f = _prepared(spark, sf_dir, ["qx_events"], ["e_user"])
    with f.with_settings(**SMALL):
        e = f.engine.sql("SELECT event_id, user_id, ts, event_type FROM qx_events WHERE user_id < 20")
    bought = F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))
    upto = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return e.select("event_id", F.max(bought).over(upto)["event_id"].alias("purchase"))


@query("pivot", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders WHERE o_orderkey < 2000 GROUP BY o_orderpriority")
def _pivot(spark, sf_dir):
    f = _prepared(spark, sf_dir, ["qx_orders"], ["o_orderkey"])
    with f.with_settings(**SMALL):
        df = f.engine.sql("SELECT o_orderpriority, o_orderstatus FROM qx_orders WHERE o_orderkey < 2000")
    counted = df.groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.count(F.lit(1)))
    return counted.select("o_orderpriority", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("qualified_name", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7")
def _qualified_name(spark, sf_dir):
    """A catalog table by its database's name."""
    f = fixture(spark, sf_dir)
    spark.sql(f"CREATE DATABASE IF NOT EXISTS quern_rows LOCATION '{f.folder}/database'")
    table = f"quern_rows.nation_{uuid.uuid4().hex[:8]}"
    f.source("nation").write.option("path", f"{f.folder}/{table}").saveAsTable(table)
    f.engine.sql(f"CREATE OINDEX k ON {table} (n_nationkey)")
    with f.with_settings(**SMALL):
        return f.engine.sql(f"SELECT n_nationkey, n_name FROM {table} WHERE n_nationkey = 7")


@query("insert_select", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (7, 39)")
def _insert_select(spark, sf_dir):
    """CREATE TABLE AS and INSERT read through the index."""
    f = _prepared(spark, sf_dir, ["qx_orders"], ["o_orderkey"])
    table = f"quern_made_{uuid.uuid4().hex[:8]}"
    with f.with_settings(**SMALL):
        f.engine.sql(f"CREATE TABLE {table} USING parquet LOCATION '{f.folder}/{table}' AS SELECT o_orderkey, o_custkey FROM qx_orders WHERE o_orderkey = 7")
        f.engine.sql(f"INSERT INTO {table} SELECT o_orderkey, o_custkey FROM qx_orders WHERE o_orderkey = 39")
    return spark.table(table)


@query("map_functions", """SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN value > 10 THEN 1 ELSE 0 END) AS BIGINT) AS high FROM events GROUP BY event_type""")
def _map_functions(spark, sf_dir):
    """Maps made, transformed, filtered and looked up."""
    e = fixture(spark, sf_dir).source("events")
    made = F.create_map(F.col("event_type"), F.col("value"), F.lit("other"), F.lit(0.0))
    high = F.map_filter(made, lambda k, v: v > 10)
    return e.select(F.map_keys(made)[0].alias("event_type"), F.size(high).alias("high")).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("high").alias("high"))


@query("json_functions", """SELECT CAST(props->>'$.k' AS INTEGER) AS k, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1""")
def _json_functions(spark, sf_dir):
    e = fixture(spark, sf_dir).source("events")
    k = F.from_json("props", "k int")["k"]
    same = F.get_json_object("props", "$.k").cast("int").eqNullSafe(k)
    return e.where(same).groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query("array_functions", """SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CAST(floor(x * 64) AS BIGINT))) AS BIGINT) AS total,
  CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS above FROM embeddings""")
def _array_functions(spark, sf_dir):
    """Higher-order functions: transform, filter, aggregate."""
    v = fixture(spark, sf_dir).source("embeddings")
    whole = F.transform("embedding", lambda x: F.floor(x * 64).cast("long"))
    return v.select("vec_id", F.aggregate(whole, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(F.filter("embedding", lambda x: x > 0)).alias("above"))


@query("pandas_udaf", "SELECT l_returnflag, CAST(max(l_linenumber) - min(l_linenumber) AS BIGINT) AS span FROM lineitem GROUP BY l_returnflag")
def _pandas_udaf(spark, sf_dir):
    """A grouped aggregate in Python over what Spark has aggregated by value already, so that no group is large."""
    span = F.pandas_udf(lambda v: int(v.max() - v.min()), "long", F.PandasUDFType.GROUPED_AGG)
    return fixture(spark, sf_dir).source("lineitem").select("l_returnflag", "l_linenumber").distinct().groupBy("l_returnflag").agg(span("l_linenumber").alias("span"))


@query("python_udtf", "SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation")
def _python_udtf(spark, sf_dir):
    """A table function in Python, joined laterally."""

    class Words:
        def eval(self, text: str):
            for w in text.split(" "):
                yield (w,)

    name = f"quern_words_{uuid.uuid4().hex[:8]}"
    spark.udtf.register(name, F.udtf(Words, returnType="word string"))
    fixture(spark, sf_dir).source("nation").createOrReplaceTempView(f"{name}_nation")
    return spark.sql(f"SELECT n_nationkey, word FROM {name}_nation, LATERAL {name}(n_name)")

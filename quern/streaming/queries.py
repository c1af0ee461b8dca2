"""Structured Streaming over the events table: windows, sessions, deduplication, late data.

Each query streams the table once (``availableNow``) into Parquet in the shared folder and returns
what is there: executors write it, and nothing is gathered on the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(source.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    # Watermarks need instants: the table's clock is taken in the session's zone, and results give it back.
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _clock(name: str):
    return F.col(name).cast("timestamp_ntz").alias("start")


def _run(df: DataFrame, mode: str) -> DataFrame:
    """What the stream has written: each batch replaces the one before (complete), or is kept under its number,
    so a batch that is run again writes the same place."""
    spark = df.sparkSession
    at = f"{files.workspace(spark)}/stream-{uuid.uuid4().hex[:12]}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={0 if mode == 'complete' else number}")

    q = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(f"{at}/rows").select(*[F.col(f"`{c}`") for c in df.columns]) if files.exists(spark, f"{at}/rows") else spark.createDataFrame([], df.schema)


def query(name: str, oracle: str):
    def add(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = oracle
        return f

    return add


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2")
def tumbling(spark, sf_dir):
    e = _stream(spark, sf_dir).withWatermark("ts", "1 day")
    return _run(e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "complete").select(_clock("window.start"), "event_type", "n", "total")


@query("stream_sliding", """SELECT time_bucket(INTERVAL '1 hour', ts) - (INTERVAL '1 hour') * k AS start, count(*) AS n
  FROM events, (VALUES (0), (1)) AS s(k) GROUP BY 1""")
def sliding(spark, sf_dir):
    e = _stream(spark, sf_dir).withWatermark("ts", "1 day")
    return _run(e.groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count("*").alias("n")), "complete").select(_clock("window.start"), "n")


@query("stream_session", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def session(spark, sf_dir):
    e = _stream(spark, sf_dir).withWatermark("ts", "1 day")
    return _run(e.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n")), "complete").select("user_id", _clock("session_window.start"), "n")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events")
def dedup(spark, sf_dir):
    """Once a user, type and day; the watermark lets go of days that are over."""
    e = _stream(spark, sf_dir).select("user_id", "event_type", F.window("ts", "1 day").alias("day"), "ts").withWatermark("ts", "1 day")
    return _run(e.dropDuplicates(["user_id", "event_type", "day"]), "append").select("user_id", "event_type", F.col("day.start").cast("timestamp_ntz").alias("day"))


@query("stream_late", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def late(spark, sf_dir):
    """Three files in turn: the events; the same ones three years older, which the watermark drops; and one far
    ahead, which lets all windows of the events go out (append mode)."""
    source = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"))
    at = f"{files.workspace(spark)}/late-{uuid.uuid4().hex[:12]}"
    shifts = ("ts", "ts - INTERVAL 1095 DAYS", "max(ts) + INTERVAL 100 DAYS AS ts")
    for shift in shifts:
        source.selectExpr(shift).coalesce(1).write.mode("append").parquet(at)
    e = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(at).withWatermark("ts", "1 hour")
    return _run(e.groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("n")), "append").select(_clock("window.start"), "n")


@query("stream_filter", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 50")
def filtered(spark, sf_dir):
    return _run(_stream(spark, sf_dir).where("event_type = 'purchase' AND value > 50").select("event_id", "user_id", "value"), "append")


@query("stream_static_join", "SELECT c_mktsegment, count(*) AS n FROM events JOIN customer ON user_id = c_custkey GROUP BY c_mktsegment")
def static_join(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    e = _stream(spark, sf_dir)
    return _run(e.join(c, F.col("user_id") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count("*").alias("n")), "complete")


@query("stream_state", "SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY user_id")
def state(spark, sf_dir):
    """Arbitrary state by user: what it holds when the stream ends is the batch aggregate."""
    import pandas as pd

    def update(key, batches, held):
        n, top = held.get if held.exists else (0, float("-inf"))
        for b in batches:
            n, top = n + len(b), max(top, float(b["value"].max()))
        held.update((n, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top": [top]})

    e = _stream(spark, sf_dir).select("user_id", "value")
    kept = e.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, top double", "n long, top double", "update", "NoTimeout")
    out = _run(kept, "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.max("top").alias("top"))
